"""Fill-in-the-middle against a version that stores all units."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from rasterloom.llm import fill_in_middle as M


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_stored_units(spark):
    draw = random.Random(2)
    pieces = ["a", "bc", " ", "\n\t", "\x0b", "é", "😀", " ", "<", "<P", "S>", "<<", ">", "M", "\r\n "]
    texts = [None, "", " ", "\n\n", "one", " one ", "a <P> b", "<M>", "x<S", "<P", "end "] + ["".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(300)]
    texts += ["long text " * 60_000, "x" * 300_000, " " * 100_000]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(None, "no id here", "c"), (5, " one ", "c"), (5, " one ", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumn("form", F.lit(1)).repartition(3)
    for how in ({}, {"rate": 100, "spm": 30, "seed": 7}):
        got = M.fill_in_middle(df, **how).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        want = sorted(repr((k, *plain(k, t, **how), t or "")) for k, t, _ in rows)
        assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_one_iterator_is_advanced():
    """Places of all pairs of ranks; no more than one match is held."""
    text = " a bb  ccc\n d "
    ends = [0] + [m.end() for m in M.UNIT.finditer(text)]
    assert M.count_units(text) == len(ends) - 1 == 5
    assert all(M.cut_places(text, a, b) == (ends[a], ends[b]) for a in range(6) for b in range(a, 6))
