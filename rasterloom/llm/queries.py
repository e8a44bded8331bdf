"""Queries of this subpackage on the driver's tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, fill_in_middle, html_extract, lang_id, quality, secret_scan, simhash, suffix_dedup, toxicity, whitening
from ..plans.lineage import new_path

RANKS = "byte_bpe_multi_50k.tiktoken"
BOTH = "\\### Assistant: </turn> ok"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(folds: int, held: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", BOTH), (-7, 1, "assistant", BOTH)], "conv_id long, turn long, role string, text string")
    got = chat_format.format_conversations(chat_format.reply_tree(rows.unionByName(more)))
    turns = F.transform(chat_format.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = got.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("turn_spans")))
    return loss.select(
        "conv_id", F.size(chat_format.parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# the template adds 4 + 2 + 8 characters to a turn, a backslash to each control string and backslash in a text or role
OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14 + length(role) + length(text)
    + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)
    + length(role) - length(replace(role, ':', '')) AS n
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# an item of fewer than five words is one shingle, looked for among runs of as many words
OP4_SQL = r"""
WITH bw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(5, len(w)) AS k FROM bw WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bk))),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~fold(4, 2)).select("doc_id", "text", "lang"))
    return lang_id.score(docs, model, fold(4, 2).alias("held_out")).select("doc_id", "held_out", "lang_pred", "score", "accepted", "cross_entropy")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels").where(~fold(3, 1)))
    return quality.score(docs, model, fold(3, 1).alias("held_out")).select("doc_id", "held_out", "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~fold(3, 1)).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    model = toxicity.train(docs, labels, ("low_quality", "toxic"))
    got = toxicity.score(docs, model, fold(3, 1).alias("held_out"))
    return got.select("doc_id", "held_out", F.col("scores")[1].alias("score"), (F.col("scores")[1] >= 0.5).cast("int").alias("predicted"), F.col("scores")[0].alias("low_quality_score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"), outputs=False)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as first versions of paths, against a new ledger."""
    versions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    got = secret_scan.scan(versions, new_path(spark, "ledger"))
    counts = (F.size(F.filter("findings", lambda f: f["rule"] == kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex"))
    base, spans = secret_scan.joined(F.col("findings"), secret_scan.BASE_RULES), secret_scan.joined(F.col("findings"), secret_scan.RULES)
    return got.select(F.col("path").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


# the rules in RE2's spelling; a match begins after all matches before it and what lies between them
_RULES_SQL = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24), ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("repo_token", r"gh[opsru]_[A-Za-z0-9]{36,}", 0, 1), ("url_password", r"://[^\x20\x09-\x0D/:@]{1,64}:([^\x20\x09-\x0D/:@]{1,64})@", 1, 4),
]
_EACH_SQL = " UNION ALL ".join(
    f"SELECT doc_id, uid, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {group}) AS secret, "
    f"string_split_regex(t, '{p}') AS before FROM d WHERE regexp_matches(t, '{p}')"
    for k, (kind, p, group, least) in enumerate(_RULES_SQL)
)
OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, coalesce(text, '') AS t FROM documents),
each AS ({_EACH_SQL}),
m AS (SELECT uid, k, kind, least, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS found, unnest(secret) AS secret, unnest(before[:len(found)]) AS before FROM each),
p AS (SELECT *, sum(length(before) + length(found)) OVER (PARTITION BY uid, k ORDER BY i) AS stop FROM m),
s AS (SELECT uid, k, kind, stop - length(found) AS start, kind || ':' || (stop - length(found))::BIGINT || ':' || stop::BIGINT AS said FROM p WHERE length(secret) >= least),
g AS (SELECT uid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(said, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(said, ',' ORDER BY start, k) AS spans FROM s GROUP BY uid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (uid)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_exact_dedup, op3_html_extract, op4_decontaminate, op5_simhash, op6_lang_id, op7_bpe, op8_quality, op9_toxicity, op10_suffix_dedup, op11_secret_scan, op12_whitening, op13_fill_in_middle)
}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_decontaminate": OP4_SQL, "op11_secret_scan": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
