"""Near copies by five-word Jaccard similarity against brute force; the pipeline's stage."""

import random

import pytest

from rasterloom.llm import simhash

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, least=0.8):
    """Root (least position) of each text by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    out = ["", None, "One two", "one  TWO", "one two three"]
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.randint(40, 300))]
        out.append(" ".join(base))
        for changed in (1, 2, 4, 8, 16):  # on both sides of the limit
            copy = list(base)
            for at in draw.sample(range(len(copy)), changed):
                copy[at] = "other"
            out.append(" ".join(copy))
    chain = [draw.choice(words) for _ in range(100)]
    for k in range(40):  # each is similar to the next, the first isn't to the last
        out.append(" ".join(chain))
        chain = chain[3:] + [draw.choice(words) for _ in range(3)]
    draw.shuffle(out)
    return out


def test_similar_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_components(texts)
    assert len(set(want)) < 0.6 * len(texts)
    for together, most in ((5, 64), (1, 64), (1, 2)):  # one segment a key: buckets of unlike texts, the second round and finer buckets
        got = {r.doc_id: r for r in simhash.similar_groups(df, together=together, most=most).collect()}
        assert [got[k].component_id for k in range(len(texts))] == want
        assert {k for k, r in got.items() if r.keep} == set(want)
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_near_copies_stage(spark, texts):
    import corpus_pipeline as P

    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    got = sorted(r.doc_id for r in P.near_copies(spark, df, "").collect())
    assert got == sorted(set(brute_components(texts)))


def test_segments_agree_as_texts_are_similar():
    """Of pairs with a given Jaccard similarity: the share of equal codeword indices, and of pairs that share a key."""
    import numpy as np

    draw, code, chosen = np.random.default_rng(3), simhash.Golay(), simhash.subsets(32, 5, 40)
    for similarity, least in ((0.95, 1.0), (0.9, 1.0), (0.8, 0.98)):
        found, agree = 0, []
        for _ in range(200):
            c = round(480 * similarity / (1 + similarity))
            base = draw.integers(0, 1 << 63, 480 - c, dtype=np.uint64)
            a, b = code.nearest(simhash.weighted_segments([np.unique(x) for x in (base[:240], np.concatenate([base[:c], base[240:]]))], 32))
            agree.append((a == b).mean())
            found += any((a == b)[k].all() for k in chosen)
        assert abs(np.mean(agree) - similarity) < 0.03 and found >= least * 200


@pytest.mark.parametrize("most", [64, 2])
def test_pairs_without_a_common_key_are_found(spark, texts, most):
    """One key only: most similar pairs share none; and texts with one long passage, which crowd its shingles."""
    draw = random.Random(5)
    words = [f"v{k}" for k in range(900)]
    passage = [draw.choice(words) for _ in range(60)]
    crowd = []
    for k in range(30):
        own = [draw.choice(words) for _ in range(draw.choice((10, 20, 200)))]
        crowd.append(" ".join(passage + own))
        if k % 3 == 0:
            own[-1] = "other"
            crowd.append(" ".join(passage + own))
    every = texts + crowd
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, keys=1, most=most).collect()}
    assert [got[k] for k in range(len(every))] == brute_components(every)


def test_broadcasts_stay_small(spark):
    """The driver holds no table that Spark takes for small by its file: ids take many times a file's size in memory."""
    from rasterloom.llm.common import small_broadcasts

    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for given, want in (("10485760b", "1m"), ("10m", "1m"), ("2g", "1m"), ("256k", "256k"), ("1048576", "1048576"), ("-1", "-1")):
        spark.conf.set(name, given)
        small_broadcasts(spark)
        assert spark.conf.get(name) == want
    spark.conf.set(name, "10m")
    simhash.similar_groups(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).count()
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before)
