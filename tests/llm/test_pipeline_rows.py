"""The pipeline's stages decide per row: null doc_ids, repeated rows and repeated ids with different texts."""

import random
from collections import Counter

import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "which of these seven rivers reaches the northern sea before any other river does"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    words = [f"w{k}" for k in range(2000)]
    return [" ".join(draw.choice(words) for _ in range(80)) for _ in range(12)]


def rows(pairs):
    return [(i, t, "en", "s", len(t)) for i, t in pairs]


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_copies_rows(spark, texts):
    import corpus_pipeline as P

    t = texts
    given = [(1, t[0]), (1, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (2, t[3]), (2, t[4]), (0, t[4]), (None, t[0]), (5, t[5])]
    want = Counter([(1, t[0]), (None, t[1]), (None, t[2]), (2, t[3]), (0, t[4]), (5, t[5])])
    assert kept(P.exact_copies(spark, spark.createDataFrame(rows(given), ROWS).repartition(3), "")) == want


def test_near_copies_rows(spark, texts):
    import corpus_pipeline as P

    t, near = texts, [x + " more" for x in texts]
    given = [(1, t[0]), (1, near[0]), (None, t[1]), (None, t[2]), (3, near[2]), (2, t[3]), (2, t[4]), (0, near[4]), (7, t[5]), (7, t[5])]
    want = Counter([(None, t[1]), (3, near[2]), (2, t[3]), (0, near[4]), (7, t[5])])
    got = kept(P.near_copies(spark, spark.createDataFrame(rows(given), ROWS).repartition(3), ""))
    one = [k for k in got if k[0] == 1]  # of rows with one id either may stay
    assert len(one) == 1 and got - Counter(one) == want


def test_leaks_rows(spark, texts, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t, leaked = texts, [f"{x} {ITEM} {x}" for x in texts]
    given = [(None, t[0]), (None, leaked[1]), (1, t[2]), (1, leaked[2]), (2, t[3]), (2, t[3]), (3, leaked[4])]
    want = Counter([(None, t[0]), (1, t[2]), (2, t[3]), (2, t[3])])
    assert kept(P.leaks(spark, spark.createDataFrame(rows(given), ROWS), str(tmp_path))) == want


def test_run_against_brute_force(spark, texts, tmp_path):
    """All five stages on a fixture with planted copies, near copies, leaks, a strange language, null and repeated ids."""
    import hashlib

    import corpus_pipeline as P
    import public_tokenizers
    import tiktoken

    from rasterloom.llm import bpe

    draw = random.Random(3)
    a, b = ["the", "and", "of", "this", "that", "with", "thing", "from", "other"], ["der", "und", "nicht", "über", "größe", "straße", "auch", "schon"]
    say = lambda words: " ".join(draw.choice(words) + draw.choice(words) for _ in range(60))
    given = [(k, say(a if k % 2 else b), "en" if k % 2 else "de") for k in range(60)]
    given += [(100, given[3][1], "en"), (None, given[4][1].replace(" ", "\t"), "de"), (101, given[5][1] + " more", "en"), (None, say(a), "en"), given[7], given[7], (8, say(b), "de")]
    given += [(102, say(a) + f" {ITEM} " + say(a), "en"), (103, " ".join("".join(draw.choice("жщыэю") for _ in range(6)) for _ in range(50)), None), (104, None, "en"), (105, "", "en"), (106, "12 34", "en")]
    rows_ = [(i, t, lang, "s", len(t or "")) for i, t, lang in given]
    spark.createDataFrame(rows_, ROWS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ranks = bpe.load_ranks(public_tokenizers.path(P.RANKS))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = [(k, t) for k, t, _ in given[:60]] + [(None, given[63][1]), (8, given[66][1])]
    want = sorted((str(k), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in encoding.encode_ordinary(t))).hexdigest()) for k, t in kept)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in P.run(spark, str(tmp_path)).collect()) == want


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], ROWS)
    for name, stage in P.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert got.count() == 0 and (name == "tokens" or got.columns == empty.columns)
