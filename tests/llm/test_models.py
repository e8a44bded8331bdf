"""The fitted models against plain versions: Kneser-Ney by dictionaries, pair loss by its gradient, the chain by hand."""

import random

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import lang_id, linear, quality, toxicity


def plain_kneser_ney(texts, symbols, order=4):
    """P(gram) by the textbook's recursion over dictionaries; boundary is symbol 0. ``symbols``: of all languages."""
    table = lang_id.symbol_table()
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        kept, last = [], True
        for c in t.lower():
            s = int(table[ord(c)])
            if s or last:
                kept.append(s)
            last = s > 0
        for i in range(len(kept)):
            g = tuple(([0] * order + kept)[i + 1 : i + order + 1])
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order, 1, -1):
        for g in counts[k]:
            counts[k - 1][g[1:]] = counts[k - 1].get(g[1:], 0) + 1

    def p(g, k=order):
        if k == 0:
            return 1 / (symbols + 1)
        n = list(counts[k].values())
        d = n.count(1) / (n.count(1) + 2 * n.count(2)) if 1 in n else 0.5
        own = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:], k - 1)
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:], k - 1)

    return counts[order], p


def test_kneser_ney_by_dictionaries():
    a = ["the cat sat on the mat", "a cat and the dog", "that is the end, then"]
    b = ["der hund und die katze", "das ende ist da", "und dann der rest"]
    table = lang_id.symbol_table()
    parts = {}
    for name, texts in (("a", a), ("b", b)):
        g = np.concatenate([lang_id.grams([t], table)[0] for t in texts])
        parts[name] = np.unique(g, return_counts=True)
    m = lang_id.Models(parts)
    draw, symbols = random.Random(1), len({int(table[ord(c)]) for t in a + b for c in t})
    for j, texts in enumerate((a, b)):
        counts, p = plain_kneser_ney(texts, symbols)
        pack = lambda g: sum(s << (lang_id.BITS * (3 - i)) for i, s in enumerate(g))
        assert {pack(g): n for g, n in counts.items()} == dict(zip(parts["ab"[j]][0].tolist(), parts["ab"[j]][1].tolist()))
        letters = sorted({s for g in counts for s in g})
        some = list(counts)[:40] + [tuple(draw.choice([*letters, ord("z")]) for _ in range(4)) for _ in range(60)]
        other = plain_kneser_ney(b if j == 0 else a, symbols)[0]
        got = m.logs(np.array([pack(g) for g in some + list(other)[:20]], dtype=np.uint64))[:, j]
        assert np.allclose(got, [np.log(p(g)) for g in some + list(other)[:20]], atol=1e-5)


def test_limits_stand_between():
    e = np.array([[1.0, 3.0], [1.2, 3.1], [4.0, 2.0], [4.2, 2.1]])
    got = lang_id.limits(e, np.array([0, 0, 1, 1]))
    assert 1.2 < got[0] < 4.0 and 2.1 < got[1] < 3.0
    assert lang_id.limits(np.array([[1.0, 9.0], [1.1, 9.0]]), np.array([0, 0])).tolist()[1] == lang_id.limits(np.array([[1.0], [1.1]]), np.array([0, 0]))[0]


def test_pair_loss_is_least(spark):
    """At the learnt weights the logistic loss of the drawn pairs has no slope; the threshold is the quantile."""
    draw = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    table = [(k, " ".join(draw.choice(words[:40] if k % 3 else words[20:]) for _ in range(40))) for k in range(150)]
    table += [(0, "another text of a repeated id"), (None, "no id"), (500, None)]
    docs, labels = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(150)] + [(0, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    from rasterloom.llm.common import labelled_sample

    rows = labelled_sample(docs, labels.where("quality is not null"), ["quality"], 20_000).orderBy("doc_id").collect()
    assert len(rows) == 150 and len({r.doc_id for r in rows}) == 150
    x, y = np.array([quality.features(r.text) for r in rows]), np.array([r.quality for r in rows])
    z = ((x - model["mean"]) / model["scale"]).astype(np.float32)
    pairs, first = quality.preference_pairs(z, np.flatnonzero(y == 1), np.flatnonzero(y == 0), 60_000)
    slope = pairs.T @ (linear.sigmoid(pairs @ model["w"]) - first) + model["w"]
    assert np.abs(slope).max() < 1e-2 * len(pairs) ** 0.5
    assert abs(model["threshold"] - np.quantile(z @ model["w"], np.mean(y == 0))) < 1e-6
    got = {r.doc_id: r for r in quality.score(docs.where("doc_id > 0"), model).collect()}
    assert np.mean([got[k].predicted == (k % 3 > 0) for k in range(1, 150)]) > 0.95 and 0 <= got[500].score <= 1


def test_logistic_by_gradient_descent():
    draw = np.random.default_rng(0)
    x, weight = draw.normal(size=(5000, 4)), draw.random(5000)
    y = (draw.random(5000) < linear.sigmoid(x @ [1, -2, 0.5, 0] + 0.3)).astype(float)
    w, slow, padded = linear.logistic(x, y, 2.0, weight=weight), np.zeros(5), np.concatenate([x, np.ones((5000, 1))], axis=1)
    for _ in range(3000):
        slow -= 0.001 * (padded.T @ (weight * (linear.sigmoid(padded @ slow) - y)) + np.array([2.0] * 4 + [1e-6]) * slow)
    assert np.allclose(w, slow, atol=1e-4)


def test_chain_is_out_of_fold(spark, monkeypatch):
    """Each category is fitted without a fold to predict it, then on all; the second sees the first's probabilities."""
    draw = random.Random(4)
    table = [(k, " ".join(draw.choice(["fine", "good", "vile"] if k % 4 == 0 else ["fine", "good", "nice"]) for _ in range(20))) for k in range(200)]
    table += [(0, "a second text"), (1, "a third text")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0), int(k % 4 == 0)) for k in range(200)], "doc_id long, a int, b int")
    calls = []
    plain = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, l2: calls.append(x.shape) or plain(x, y, l2=l2))
    model = toxicity.train(docs, labels, ("a", "b"))
    rows = [n for n, _ in calls]
    assert len(calls) == 12 and sum(200 - n for n in rows[:5]) == 200 and rows[5] == rows[11] == 200
    assert len({w for _, w in calls[:6]}) == 1 and {w for _, w in calls[6:]} == {calls[0][1] + 1}
    one = docs.where("doc_id = 8")
    text = one.first().text
    x = (toxicity._vector(text, model["index"], model["lexicon"]) - model["mean"]) / model["scale"]
    first = x @ model["w"][0][:-1] + model["w"][0][-1]
    second = np.append(x, linear.sigmoid(first)) @ model["w"][1][:-1] + model["w"][1][-1]
    got = toxicity.score(one, model).first().scores
    assert np.allclose(got, linear.sigmoid(np.array([first, second]) - np.array(model["shift"])))
    again = toxicity.train(docs.repartition(7), labels.repartition(3), ("a", "b"))  # ties of repeated ids and the rows' order don't matter
    assert all(np.array_equal(p, q) for p, q in zip(model["w"], again["w"])) and model["shift"] == again["shift"]
    held = {r.doc_id: r.scores[1] for r in toxicity.score(docs.where("doc_id > 1"), model).select("doc_id", F.col("scores")).collect()}
    assert np.mean([(held[k] >= 0.5) == (k % 4 == 0) for k in range(2, 200)]) > 0.98


def test_calibration_counts_every_document(spark):
    """Limits and temperature follow all training documents: 600 plain ones of a language and ten of another wording."""
    draw = random.Random(6)
    words = {"a": ["the", "and", "thing", "with"], "b": ["der", "und", "nicht", "auch"]}
    rows = [(k, " ".join(draw.choice(words[x]) for _ in range(draw.randint(3, 30))), x) for k in range(1300) for x in ("ab"[k % 2],)]
    rows += [(None, " ".join(draw.choice(["zig", "qux", "vorp"]) for _ in range(4)), "a") for _ in range(10)] + [(1, None, "a"), (2, "7", "b"), (3, "the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = lang_id.train(df)
    known = [r for r in lang_id.score(df.where("lang is not null and text is not null"), model, "lang").collect() if r.lang_pred != "und"]
    e, right = np.array([r.entropies for r in known]), np.array(["ab".index(r.lang) for r in known])
    assert len(e) == 1310 and np.abs(model["limits"] - lang_id.limits(e, right)).max() <= 1 / 1024
    loss = {}
    for t in (1, 2, 5, 10, 20, 50, 100):
        z = -t * (e - e.min(axis=1, keepdims=True))
        loss[t] = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(e)), right]))
    assert model["temperature"] == min(loss, key=loss.get)
