"""Large groups of near copies: comparisons grow with the group, not with its square, and no link is lost."""

import random

import pytest

from rasterloom.llm import simhash

from test_near_copies import brute_components


def group(size):
    """One text with 0 to 9 of its 140 words changed: about half are similar to it, the others to no text."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [draw.choice(words) for _ in range(140)]
    out = []
    for k in range(size):
        copy = list(base)
        for at in draw.sample(range(140), k % 10):
            copy[at] = draw.choice(words)
        out.append(" ".join(copy))
    return out


def compared(spark, texts, monkeypatch, **how):
    """Components, and the number of pairs that were compared by parities or by sets."""
    made, cut, verified = [], simhash.cut, simhash._verified

    def counted(df):
        df = cut(df)
        if df.columns == ["u", "v"]:
            made.append(df.count())
        return df

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *more: verified(counted(pairs), *more))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, **how).collect()}
    monkeypatch.undo()
    return [got[k] for k in range(len(texts))], sum(made)


def test_comparisons_grow_with_a_group(spark, monkeypatch):
    small, large = group(150), group(600)
    (_, few), (got, many) = (compared(spark, x, monkeypatch) for x in (small, large))
    assert got == brute_components(large) and 100 < len(set(got)) < 450
    assert many < 8 * few and many < 40 * len(large)


@pytest.mark.parametrize("keys", [1, 40])
def test_groups_side_by_side(spark, monkeypatch, keys):
    """Two groups with a common half, and pairs of copies that share their changes and so are similar to each other only."""
    draw, texts = random.Random(9), group(200)
    for text in texts[9::20]:
        twin = text.split()
        twin[draw.randrange(140)] = "other"
        texts.append(" ".join(twin))
    half = texts[0].split()[:70]
    tail = [f"v{draw.randrange(400)}" for _ in range(70)]
    for k in range(60):
        copy = half + tail
        for at in draw.sample(range(140), k % 6):
            copy[at] = "other"
        texts.append(" ".join(copy))
    got, _ = compared(spark, texts, monkeypatch, keys=keys)
    assert got == brute_components(texts)
