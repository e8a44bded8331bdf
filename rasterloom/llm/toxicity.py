"""Toxicity by a classifier chain.

Categories are predicted one after another: the model of a category sees the text's features and the probabilities of
all earlier categories. In training these are out-of-fold: the sample is dealt into ``folds`` by doc_id's hash, and a
row's earlier probabilities come from models fitted on the other folds, as at prediction time the model never saw the
row. The final models are fitted on the whole sample.

Features: presence of the ``vocabulary`` words whose document frequencies differ most between a category's labels (by
their likelihood ratio), how many different words of a category's lexicon occur and how often (words seven times as
frequent in labelled documents as in others), and style features. Words are ASCII lower-cased and split at punctuation. The sample is at
most ``sample_rows`` labelled documents; every document is scored on its whole text. Each category's threshold gives
the best F1 on its out-of-fold probabilities; scores are shifted so that 0.5 is the threshold.

Defined results: null and empty texts have the features of the empty text; rows with a null label don't train; with
one kind of label a category's probability is that constant; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import labelled_sample, small_batches, words
from .linear import N_STYLE, logistic, sigmoid, style


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}
    for batch in batches:
        names = [c for c in batch if c != "text"]
        for row in batch.itertuples(index=False):
            some = set(words(row.text))
            for c in names:
                held.setdefault(f"{c}={getattr(row, c)}", Counter()).update(some)
    for key, counts in held.items():
        yield pd.DataFrame({"label": key, "word": [w.decode("utf-8", "replace") for w in counts], "n": list(counts.values())})


def _vector(text: str, index: dict[bytes, int], lexicon: np.ndarray) -> np.ndarray:
    n, m = len(index), len(lexicon)
    out = np.zeros(n + 3 * m + N_STYLE)
    tokens = words(text)
    some = index.keys() & set(tokens)
    if some:
        at = [index[w] for w in some]
        out[at] = 1.0
        if lexicon[:, at].any():
            counts = np.array([tokens.count(w) for w in some])
            out[n : n + m] = lexicon[:, at].sum(axis=1)
            out[n + m : n + 2 * m] = np.log1p(lexicon[:, at] @ counts)
            out[n + 2 * m : n + 3 * m] = out[n : n + m] > 0
    out[n + 3 * m :] = style(text)
    return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample_rows: int = 10_000, vocabulary: int = 400, folds: int = 5) -> dict:
    """categories: label columns (0 or 1) in chain order."""
    known = labels.dropna(subset=list(categories))
    sample = cut(labelled_sample(docs, known, list(categories), sample_rows))  # the documents are read once to train
    counts = cut(sample.select("text", *categories).mapInPandas(_word_counts, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")))
    totals = {f"{c}={r[0]}": r[1] for c in categories for r in sample.groupBy(c).count().collect()}
    index: dict[bytes, int] = {}
    lexicons: list[tuple[int, int]] = []
    lexicons_of: list[str] = []
    for c in categories:
        a, b = max(1, totals.get(f"{c}=1", 0)), max(1, totals.get(f"{c}=0", 0))
        p = counts.where(F.col("label") == f"{c}=1").select("word", F.col("n").alias("n1"))
        q = counts.where(F.col("label") == f"{c}=0").select("word", F.col("n").alias("n0"))
        both = p.join(q, "word", "full").select("word", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n0", F.lit(0)).alias("n0"))
        n1, n0, share = F.col("n1"), F.col("n0"), a / (a + b)
        term = lambda n, part: F.when(n > 0, n * F.log(n / ((n1 + n0) * part))).otherwise(0.0)
        ratio = ((n1 + 0.5) / a) / ((n0 + 0.5) / b)
        top = both.where(n1 + n0 >= 3).withColumn("ratio", ratio).orderBy(F.desc(term(n1, share) + term(n0, 1 - share)), "word").limit(vocabulary)
        for r in top.collect():
            index.setdefault(r.word.encode(), len(index))
            if r.ratio > 7:
                lexicons.append((len(lexicons_of), index[r.word.encode()]))
        lexicons_of.append(c)
    lexicon = np.zeros((len(categories), len(index)))
    for j, k in lexicons:
        lexicon[j, k] = 1.0

    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_vector(t, index, lexicon) for t in batch])

    got = sample.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(folds)).cast("int").alias("fold"), "doc_id", *categories, F.pandas_udf(features, "array<float>")("text").alias("f")).toArrow().sort_by("doc_id")  # ids are unique in a sample
    width = len(index) + 3 * len(categories) + N_STYLE
    n = got.num_rows
    x = got["f"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, width) if n else np.zeros((0, width))
    fold = got["fold"].to_numpy() if n else np.zeros(0, int)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if n else (np.zeros(width), np.ones(width))
    mean[: len(index)], scale[: len(index)] = 0.0, 1.0
    x = (x - mean) / scale
    model = {"index": index, "lexicon": lexicon, "mean": mean, "scale": scale, "categories": categories, "w": [], "shift": []}
    for c in categories:
        y = np.array(got[c].to_pylist(), dtype=np.float64)
        out = np.zeros(n)
        if n and 0 < y.sum() < n:
            for k in range(folds):
                own, rest = fold == k, fold != k
                if own.any() and 0 < y[rest].sum() < rest.sum():
                    w = logistic(x[rest], y[rest], l2=3.0)
                    out[own] = sigmoid(x[own] @ w[:-1] + w[-1])
                else:
                    out[own] = y[rest].mean() if rest.any() else y.mean()
            w = logistic(x, y, l2=3.0)
            order = np.argsort(-out, kind="stable")
            hits = np.cumsum(y[order])
            best = int(np.argmax(2 * hits / (np.arange(1, n + 1) + y.sum())))
            low = out[order[best]]
            high = out[order[best + 1]] if best + 1 < n else low  # the threshold stands between two rows
            t = float(np.clip((low + high) / 2, 1e-6, 1 - 1e-6))
            shift = float(np.log(t / (1 - t)))
        else:
            w, shift = np.zeros(x.shape[1] + 1), 0.0
            w[-1] = 30.0 if n and y.sum() else -30.0
            out[:] = sigmoid(w[-1:])
        model["w"].append(w)
        model["shift"].append(shift)
        x = np.concatenate([x, out[:, None]], axis=1)
    return model


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """Shifted probabilities (rows x categories) of feature rows."""
    x = (x - model["mean"]) / model["scale"]
    scores = []
    for w, shift in zip(model["w"], model["shift"]):
        z = x @ w[:-1] + w[-1]
        scores.append(sigmoid(z - shift))
        x = np.concatenate([x, sigmoid(z)[:, None]], axis=1)
    return np.stack(scores, axis=1)


def score(docs: DataFrame, model: dict, *keep: str | Column) -> DataFrame:
    """doc_id, columns ``keep``, and scores: one probability for each category, in chain order."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for batch in batches:
            out = []
            for at in range(0, len(batch), 512):
                x = np.stack([_vector(t, m["index"], m["lexicon"]) for t in batch.iloc[at : at + 512]])
                out += list(predict(x, m))
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", *keep, F.pandas_udf(run, "array<double>")(F.coalesce("text", F.lit(""))).alias("scores"))
