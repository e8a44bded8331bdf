"""Secret scans against Python's own matcher, and what the ledger holds after each scan."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import secret_scan as S

KEY, HEX = "AKIA" + "ABCDEFGH01234567", "0123456789abcdef01234567"
TEXTS = {
    1: f'token = "{HEX}" und Password: abcdef und passwd=abc und api_key=\'x/y+z.=\'',
    2: None,
    3: "",
    4: f"ж😀é {KEY}X AKIASHORT {HEX}{HEX} 0123456789abcdef0123456 AKIAAKIA{KEY}",
    5: f"secret:token:abcdefgh SECRET  :   \"{'k' * 300}\"; APIKEY=a-b-c-d",
    6: "-----BEGIN RSA PRIVATE KEY----- https://me:secret99@host ghp_" + "a1" * 20,
    7: "x" * 200_000 + f" {HEX} " + "word " * 50_000 + f"token: {HEX}",
    8: " ".join(f"{k:024x}" for k in range(3000)),
}


def spans(text, rules):
    found = []
    for k, r in enumerate(rules):
        flags = 0
        for m in re.finditer(r.pattern, text or "", flags):
            if len(m.group(r.secret)) >= r.least:
                found.append((m.start(), k, f"{r.name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, version int, text string")


def scanned(spark, ledger):
    return sorted((bytes(r.blob), x.rule, x.rule_version) for r in spark.read.parquet(ledger).collect() for x in r.rules)


def blob(text):
    return hashlib.sha256((text or "").encode()).digest()


def test_spans(spark, tmp_path):
    # the least lengths of runs are part of two patterns; the plain form is a run and a check of its length
    plain = tuple({"access": S.Rule("access", 1, r"AKIA[A-Z0-9]+", least=20), "hex": S.Rule("hex", 1, r"[0-9a-f]+", least=24)}.get(r.name, r) for r in S.RULES)
    df = versions(spark, [(str(k), 1, t) for k, t in TEXTS.items()]).withColumns({"blob": F.lit(1), "todo": F.lit("x"), "file": F.lit(2)})
    got = S.scan(df, str(tmp_path / "ledger")).select("path", S.joined(F.col("findings"), S.RULES).alias("all"), S.joined(F.col("findings"), S.BASE_RULES).alias("base"), "findings", "blob")
    rows = {r.path: r for r in got.collect()}
    for k, t in TEXTS.items():
        r = rows[str(k)]
        assert r["all"] == spans(t, plain) and r.base == spans(t, plain[:3]) and bytes(r.blob) == blob(t), k
    secrets = [x.secret_sha256 for x in rows["1"].findings if x.rule == "assign"]
    assert secrets == [hashlib.sha256(x.encode()).hexdigest() for x in (HEX, "abcdef", "x/y+z.=")]
    assert len(rows["8"].findings) == 3000 and {x.rule for x in rows["6"].findings} >= {"private_key", "url_password", "repo_token"}


def test_ledger_grows_by_what_is_new(spark, tmp_path):
    ledger, rules = str(tmp_path / "ledger"), S.BASE_RULES
    first = [("a", 1, TEXTS[1]), ("b", 1, TEXTS[1]), ("b", 1, TEXTS[1]), (None, None, TEXTS[4]), ("c", 1, None), ("d", 1, "")]
    got = S.scan(versions(spark, first), ledger, rules)
    assert got.count() == 6
    pairs = scanned(spark, ledger)
    assert pairs == sorted((blob(t), r.name, 1) for t in (TEXTS[1], TEXTS[4], "") for r in rules)
    # a second version, a copy under another path, and nothing else to scan
    second = first + [("a", 2, TEXTS[5]), ("e", 1, TEXTS[4])]
    got = {(r.path, r.version): len(r.findings) for r in S.scan(versions(spark, second), ledger, rules).collect()}
    assert scanned(spark, ledger) == sorted(pairs + [(blob(TEXTS[5]), r.name, 1) for r in rules])
    assert got[("e", 1)] == got[(None, None)] == len(spans(TEXTS[4], rules).split(",")) and got[("c", 1)] == 0
    before = len(scanned(spark, ledger))
    S.scan(versions(spark, second), ledger, rules)
    assert len(scanned(spark, ledger)) == before
    # one rule's new version is run on all blobs, the others aren't; findings of its old version count no more
    new = (S.Rule("assign", 2, r"(token) = (\S+)", secret=2, least=3),) + rules[1:]
    got = {(r.path, r.version): [x.rule_version for x in r.findings if x.rule == "assign"] for r in S.scan(versions(spark, second), ledger, new).collect()}
    assert len(scanned(spark, ledger)) == before + 4 and got[("a", 1)] == [2] and got[("a", 2)] == []
    old = S.findings(spark.createDataFrame([(bytearray(blob(TEXTS[1])),)], "blob binary"), S.read_ledger(spark, ledger), rules).first()
    assert len([x for x in old.findings if x.rule == "assign"]) == 3


def test_two_scans_at_once(spark, tmp_path):
    """A blob that two scans have met has its findings once."""
    ledger = str(tmp_path / "ledger")
    df = versions(spark, [("a", 1, TEXTS[1])])
    S.scan(df, ledger)
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "2")
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "2")
    once, twice = (S.scan(df, at).first().findings for at in (ledger, ledger + "2"))
    assert once == twice and len(once) == 4


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_files_and_empty_tables(spark, tmp_path, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)  # a broadcast list of rows, or a join
    path = str(tmp_path / "docs")
    versions(spark, [(str(k), 1, t) for k, t in TEXTS.items()]).repartition(3).write.parquet(path)
    got = S.scan(spark.read.parquet(path), str(tmp_path / "l1"))
    assert {r.path: r.said for r in got.select("path", S.joined(F.col("findings"), S.RULES).alias("said")).collect()} == {str(k): spans(t, S.RULES) for k, t in TEXTS.items()}
    assert S.scan(versions(spark, []), str(tmp_path / "l2")).count() == 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
