"""Secret scans by an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text, its blob. The ledger is a Parquet table that only
grows: a row says which rules (name and version) were run on a blob, and what they found. A scan

1. addresses all versions, without shuffling a text;
2. takes from the ledger which of today's rules have seen which of these blobs; what is left are the unseen pairs;
3. reads one text of each blob that has unseen pairs and runs its unseen rules on it. A row is named by its place in the
   files; texts and the written list of rows meet in a join on that place, which no two rows share, so there is no hot key.
   Spark knows the list's size and broadcasts it if it is below its threshold, as it is where little is new;
4. appends one row a scanned blob to the ledger. A row is whole in itself, so what a lost append has left behind is
   neither wrong nor scanned again;
5. joins the findings of today's rules back to all versions. A hot blob has one row there; Spark can split the
   partition that holds its versions.

Places of matches follow from the lengths of the matches and of what lies between them, summed along the text, so
matches are found, counted and placed by SQL functions alone.

Defined results: null text is empty; null paths and versions are kept; repeated rows each get the findings; an empty
table gives an empty result; other columns are ignored. Places count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` of which group ``secret`` has ``least`` characters or more."""

    name: str
    version: int
    pattern: str
    secret: int = 0
    least: int = 1


# What the rules look for. Runs are matched from their least length on where that changes no result.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", secret=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("repo_token", 1, r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("url_password", 1, r"://[^\x20\x09-\x0D/:@]{1,64}:([^\x20\x09-\x0D/:@]{1,64})@", secret=1, least=4),
)
RULES = BASE_RULES + MORE_RULES

FOUND = "array<struct<start: long, end: long, rule: string, rule_version: int, secret_sha256: string>>"
LEDGER = f"blob binary, rules array<struct<rule: string, rule_version: int>>, findings {FOUND}"
_MATCHES = "array<struct<number: int, nth: int, before: int, chars: int, secret_sha256: string>>"


def placed(versions: DataFrame) -> DataFrame:
    """path, version, text, file, at: the last two tell rows apart. What isn't read from Parquet is written first."""
    columns = ["path", "version", "text"]
    try:
        return versions.select(*columns, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:  # no files behind it
        return cut(versions.select(*columns, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none if there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Of each match in order: the rule's number, the place among its matches, characters before and in it, the secret."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.secret))
    both = F.arrays_zip(found.alias("found"), secret.alias("secret"), F.split(text, rule.pattern, -1).alias("before"))
    each = F.transform(
        F.slice(both, 1, F.size(both) - 1),  # the last is what follows the last match
        lambda m, k: F.struct(
            F.lit(number).alias("number"), k.alias("nth"), F.char_length(m["before"]).alias("before"), F.char_length(m["found"]).alias("chars"),
            F.when(F.char_length(m["secret"]) >= rule.least, F.sha2(m["secret"], 256)).alias("secret_sha256"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), each).otherwise(F.array().cast(_MATCHES))


def found_in(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, findings of ``texts`` (blob, text, todo: numbers of the rules to run); blobs without findings have no row."""
    runs = [F.when(F.array_contains("todo", k), matches(F.col("text"), rule, k)).otherwise(F.array().cast(_MATCHES)) for k, rule in enumerate(rules)]
    each = texts.select("blob", F.explode(F.concat(*runs)).alias("m")).select("blob", "m.*")
    along = Window.partitionBy("blob", "number").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before").cast("long") + F.col("chars")).over(along)
    name, version = (F.element_at(F.array(*map(F.lit, v)), F.col("number") + 1) for v in ([r.name for r in rules], [r.version for r in rules]))
    finding = F.struct((F.col("end") - F.col("chars")).alias("start"), "end", name.alias("rule"), version.alias("rule_version"), "secret_sha256")
    return each.withColumn("end", end).where(F.col("secret_sha256").isNotNull()).groupBy("blob").agg(F.sort_array(F.collect_list(finding)).alias("findings"))


def _unseen(blobs: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` with ``todo``: the numbers of the rules whose version the ledger hasn't for the blob; at least one."""
    today = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules))
    number = F.array_position(today, F.col("seen")) - 1
    seen = (
        known.select("blob", F.explode("rules").alias("seen")).select("blob", number.cast("int").alias("number")).where("number >= 0")
        .groupBy("blob").agg(F.collect_set("number").alias("seen"))  # as many as there are rules
    )
    every = F.array(*(F.lit(k) for k in range(len(rules))))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<int>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).drop("seen").where(F.size("todo") > 0)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring ``ledger`` (a path) up to date with ``versions`` (path, version, text) and ``rules``, then return path,
    version, blob, findings for each of the versions; ``findings`` is empty where there are none, and is in the order of
    start, end and rule. Findings hold the digest of the secret, never the secret."""
    spark = versions.sparkSession
    rows = placed(versions).withColumn("text", F.coalesce("text", F.lit("")))
    addressed = cut(rows.select("path", "version", "file", "at", F.unhex(F.sha2("text", 256)).alias("blob")))
    blobs = addressed.groupBy("blob").agg(F.min(F.struct("file", "at")).alias("one")).select("blob", "one.*")
    todo = cut(_unseen(blobs, read_ledger(spark, ledger), rules))
    texts = rows.select("file", "at", "text").join(todo, ["file", "at"])
    names = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules))
    done = todo.join(found_in(texts, rules), "blob", "left").select(
        "blob", F.transform("todo", lambda k: F.element_at(names, k + 1)).alias("rules"), F.coalesce("findings", F.array().cast(FOUND)).alias("findings")
    )
    done.write.mode("append").parquet(ledger)
    return findings(addressed.select("path", "version", "blob"), read_ledger(spark, ledger), rules)


def findings(addressed: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``addressed`` (with column blob) and what the ledger holds of ``rules`` for it."""
    today = [F.struct(F.lit(r.name), F.lit(r.version)) for r in rules]
    held = F.filter("findings", lambda f: F.struct(f["rule"], f["rule_version"]).isin(*today))
    # two scans at once may both have met a blob: each finding counts once
    of_blob = ledger.select("blob", held.alias("held")).where(F.size("held") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("held")))).alias("findings"))
    none = F.array().cast(FOUND)
    return addressed.join(of_blob, "blob", "left").select(*(c for c in addressed.columns if c != "blob"), "blob", F.coalesce("findings", none).alias("findings"))


def joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of findings of ``rules``, by start, then rule as listed, comma-joined."""
    names = F.array(*(F.lit(r.name) for r in rules))
    kept = F.filter(found, lambda f: f["rule"].isin(*(r.name for r in rules)))
    keyed = F.transform(kept, lambda f: F.struct(f["start"].alias("start"), F.array_position(names, f["rule"]).alias("k"), F.concat_ws(":", f["rule"], f["start"], f["end"]).alias("said")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda x: x["said"]), ",")
