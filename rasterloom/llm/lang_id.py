"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased; a run of characters that are neither letters nor combining marks (vowel signs, accents) is one
boundary. Each letter and mark that occurs in training is a symbol of its own, of any script: they are numbered, the
most frequent first, so a symbol has 16 bits and a 4-gram 64. Letters that training hasn't seen share one symbol, as
would those past the 65,534th.

Training counts 4-grams per language over all training documents: tasks count what they hold, Spark adds up. Counts of
lower orders follow from the distinct 4-grams (continuation counts). Each language's interpolated probabilities are
worked out for all n-grams seen in any language and stored in *sorted hash arrays*: n-gram hashes in order, reached by
an index of their leading bits. N-grams that no language has seen back off with the stored interpolation weights.

A document goes to the language of the lowest cross-entropy per symbol. Rejection is calibrated on all training documents
with letters, scored once more: the limit of a language stands midway between the 99.9 % quantile of its own documents'
cross-entropy and the 0.1 % quantile of the other languages' documents under its model, where that is the greater (both
of cross-entropies rounded to 1/1024 nat, which tasks count). A language without such documents gets the widest limit
of the others, a single language one half above its quantile. The score is the posterior of the best language at the
temperature of least loss over the same documents, less where the limit is exceeded.

What the driver gathers is the distinct 4-grams of each language with their counts, packed in arrays of 16 bytes an entry:
it grows with the vocabulary of letter sequences (about 170 MB projected at 30 GB of text), not with the rows.

Defined results: null text and text without letters give ``und``, score 0, not accepted; rows with null lang aren't
trained on; without any training row every document is ``und``; ties go to the language that sorts first; empty tables
give empty results; other columns are ignored and repeated rows count as often as they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import small_batches

ORDER, BITS = 4, 16
_OTHER = (1 << BITS) - 1  # symbol of letters without a number
_HASH = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 18
_STEPS = 1024  # of cross-entropy a nat, in calibration
_TEMPERATURES = (1, 2, 5, 10, 20, 50, 100)


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, is a letter or a mark) of each code point; selectors of a variant aren't marks of a word."""
    letters, marks = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        letters[c], marks[c] = kind[0] == "L", kind in ("Mn", "Mc")
    marks[0xFE00:0xFE10] = marks[0xE0100:0xE01F0] = False
    return letters, letters | marks


def symbol_table(letters: np.ndarray | None = None) -> np.ndarray:
    """Symbol of each code point: 0 for what belongs to no word. ``letters``: code points in the order of their
    numbers; without them, a code point below U+FFFF is its own number."""
    table = np.where(_kinds()[1], np.uint16(_OTHER), np.uint16(0))
    codes = np.flatnonzero(_kinds()[1][:_OTHER]) if letters is None else letters[: _OTHER - 1]
    table[codes] = codes if letters is None else np.arange(1, len(codes) + 1)
    return table


def _letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = np.zeros(0x110000, dtype=np.int64)
    for batch in batches:
        texts = batch["text"].tolist()
        for s in groups(texts):
            some = np.bincount(np.frombuffer("\0".join(texts[s]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            n[: len(some)] += some
    codes = np.flatnonzero((n > 0) & _kinds()[1])
    yield pd.DataFrame({"code": codes, "n": n[codes]})


def letters_of(train: DataFrame) -> np.ndarray:
    """Code points of letters and marks over all rows of (lang, text), the most frequent first: at most as many as Unicode has."""
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text")
    found = rows.mapInPandas(_letters, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = found["code"].to_numpy(), found["n"].to_numpy()
    return codes[np.lexsort((codes, -n))]


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram ending at each symbol, number of symbols of each text, has letters). A text begins after a boundary."""
    joined = ("\0" * ORDER).join(texts).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # lower() can change a text's length, so boundaries are found again
    symbols = table[codes]
    ends = np.cumsum([len(t) if t.isascii() else len(t.lower()) for t in texts]) + ORDER * np.arange(len(texts))
    starts = np.append(0, ends[:-1] + ORDER)[: len(texts)]
    letter = symbols > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first is kept as boundary
    for k in range(ORDER):
        at = ends[:-1] + k
        keep[at] = False
    s = symbols.astype(np.uint64)
    sums = np.concatenate([[0], np.cumsum(keep)])
    counts = sums[ends] - sums[starts] if len(texts) else np.zeros(0, np.int64)
    kept = s[keep]
    place = np.cumsum(counts) - counts  # where each text begins among the kept symbols
    out = kept.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(kept), dtype=np.uint64)
        before[k:] = kept[:-k] if k < len(kept) else before[k:]
        for j in range(k):  # nothing is seen across a text's start
            at = place[counts > j] + j
            before[at] = 0
        out |= before << np.uint64(BITS * k)
    ls = np.concatenate([[0], np.cumsum(_kinds()[0][codes])])
    has = (ls[ends] - ls[starts]) > 0 if len(texts) else np.zeros(0, bool)
    return out, counts, has


def groups(texts: list[str]) -> Iterator[slice]:
    i = 0
    while i < len(texts):
        k, size = i, 0
        while k < len(texts) and (k == i or size + len(texts[k]) <= _AT_ONCE):
            size += len(texts[k])
            k += 1
        yield slice(i, k)
        i = k


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)


def count_grams(train: DataFrame, letters: np.ndarray) -> DataFrame:
    """lang, gram, n over all rows of (lang, text)."""
    numbers = train.sparkSession.sparkContext.broadcast(letters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = symbol_table(numbers.value)
        held: dict[str, list] = {}
        for batch in batches:
            for lang, some in batch.groupby("lang", sort=False)["text"]:
                texts = some.tolist()
                for s in groups(texts):
                    g = grams(texts[s], table)[0]
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(g, return_counts=True))
                    if len(parts) > 16:
                        held[lang] = [_added(parts)]
        for lang, parts in held.items():
            u, n = _added(parts)
            yield pd.DataFrame({"lang": lang, "gram": u.view(np.int64), "n": n})

    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Rows by key: hashes in sorted order, with an index by their leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = keys.astype(np.uint64) * _HASH  # odd multiplier: different keys have different hashes
        order = np.argsort(h)
        self.hashes, self.rows = np.append(h[order], np.uint64(0)), rows[order].astype(np.float32)
        bits = max(1, int(2 * len(h) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        lead = (h[order] >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, or -1."""
        h = keys * _HASH
        lead = (h >> self.shift).astype(np.int64)
        at = self.first[lead]
        hit = (self.hashes[at] == h) & (at < self.first[lead + 1])
        out = np.where(hit, at, np.int32(-1))
        open_ = np.flatnonzero(~hit)
        for step in range(1, self.most):
            if not len(open_):
                break
            k = at[open_] + step
            inside = k < self.first[lead[open_] + 1]
            open_, k = open_[inside], k[inside]
            hit = self.hashes[k] == h[open_]
            out[open_[hit]] = k[hit]
            open_ = open_[~hit]
        return out


class Models:
    """Kneser-Ney models of several languages; ``counts``: language -> (4-grams, counts)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        mask = [np.uint64((1 << (BITS * k)) - 1) for k in range(ORDER + 1)]
        tables: list[dict[int, tuple]] = []
        seen: list[list] = [[] for _ in range(ORDER + 1)]
        seen_context: list[list] = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            g, n = counts[lang]
            own = {}
            for k in range(ORDER, 0, -1):  # own[k]: k-grams and their (continuation) counts
                own[k] = (g, n)
                seen[k].append(g)
                seen_context[k].append(np.unique(g >> np.uint64(BITS)))
                if k > 1:
                    g, n = np.unique(g & mask[k - 1], return_counts=True)
            tables.append(own)
        letters = len(np.unique(np.concatenate(seen[1]))) if n_langs else 1
        self.floor = np.full(n_langs, -np.log(letters + 1), dtype=np.float32)
        self.arrays: dict[int, HashArray] = {}
        self.weights: dict[int, HashArray] = {}
        prob = {0: None}
        for k in range(1, ORDER + 1):
            if not n_langs:
                break
            union = np.unique(np.concatenate(seen[k]))
            contexts = np.unique(np.concatenate(seen_context[k]))
            rows, weights = np.zeros((len(union), n_langs)), np.zeros((len(contexts), n_langs))
            for j, own in enumerate(tables):
                g, n = own[k]
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = once / (once + 2 * twice) if once else 0.5
                ctx, first, of = np.unique(g >> np.uint64(BITS), return_index=True, return_inverse=True)
                total, kinds = np.bincount(of, weights=n), np.bincount(of)
                lam = np.ones(len(contexts))
                lam[np.searchsorted(contexts, ctx)] = d * kinds / total
                weights[:, j] = np.log(lam)
                lower = np.exp(self.floor[j]) if k == 1 else np.exp(prob[k - 1][1][np.searchsorted(prob[k - 1][0], union & mask[k - 1]), j])
                direct = np.zeros(len(union))
                direct[np.searchsorted(union, g)] = (n - d) / total[of]
                rows[:, j] = np.log(direct + lam[np.searchsorted(contexts, union >> np.uint64(BITS))] * lower)
            prob[k] = (union, rows)
            self.arrays[k], self.weights[k] = HashArray(union, rows), HashArray(contexts, weights)

    def logs(self, g: np.ndarray, k: int = ORDER) -> np.ndarray:
        """log P(last symbol | those before it) under each language."""
        if k == 0:
            return np.broadcast_to(self.floor, (len(g), len(self.langs)))
        at = self.arrays[k].find(g)
        out = self.arrays[k].rows[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            some = g[new]
            w = self.weights[k].find(some >> np.uint64(BITS))
            weight = np.where((w >= 0)[:, None], self.weights[k].rows[w], np.float32(0))
            out[new] = weight + self.logs(some & np.uint64((1 << (BITS * (k - 1))) - 1), k - 1)
        return out

    def cross_entropy(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, has letters)"""
        g, counts, has = grams(texts, table)
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(counts)
        if len(some) and self.langs:
            sums = np.add.reduceat(self.logs(g), (np.cumsum(counts) - counts)[some], axis=0)
            out[some] = -sums / counts[some][:, None]
        return out, has


def _entropies(model: dict, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages, has letters), in groups of bounded size."""
    parts, flags = [np.zeros((0, len(model["models"].langs)))], [np.zeros(0, bool)]
    for s in groups(texts):
        e, has = model["models"].cross_entropy(texts[s], table)
        parts.append(e)
        flags.append(has)
    return np.concatenate(parts), np.concatenate(flags)


def calibration_counts(train: DataFrame, model: dict) -> DataFrame:
    """model, own, bin, n: training documents by cross-entropy under each model (in ``_STEPS`` a nat), of the model's own
    language and of others. model -1: loss is the sum at temperature bin. Every document counts; tasks add up what they
    hold, so their rows follow the bins and not the documents."""
    held = train.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        table, langs = symbol_table(m["letters"]), m["models"].langs
        sums, losses = np.zeros((2 * len(langs), 0), dtype=np.int64), np.zeros(len(_TEMPERATURES))
        for batch in batches:
            e, has = _entropies(m, table, batch["text"].tolist())
            e, right = e[has], np.searchsorted(langs, batch["lang"].to_numpy(dtype=object)[has])
            if not len(e):
                continue
            bins = np.rint(e * _STEPS).astype(np.int64)
            of = 2 * np.arange(len(langs)) + (right[:, None] == np.arange(len(langs)))
            wide = max(sums.shape[1], int(bins.max()) + 1)
            sums = np.pad(sums, ((0, 0), (0, wide - sums.shape[1])))
            sums += np.bincount((of * wide + bins).ravel(), minlength=2 * len(langs) * wide).reshape(sums.shape)
            above = e - e.min(axis=1, keepdims=True)
            for k, t in enumerate(_TEMPERATURES):
                losses[k] += (np.log(np.exp(-t * above).sum(axis=1)) + t * above[np.arange(len(e)), right]).sum()
        of, at = np.nonzero(sums)
        yield pd.DataFrame({"model": of // 2, "own": of % 2 == 1, "bin": at, "n": sums[of, at], "loss": 0.0})
        yield pd.DataFrame({"model": -1, "own": False, "bin": _TEMPERATURES, "n": 0, "loss": losses})

    return train.mapInPandas(count, "model int, own boolean, bin int, n long, loss double").groupBy("model", "own", "bin").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def train(docs: DataFrame) -> dict:
    """A model from docs (text, lang)."""
    small_batches(docs.sparkSession)
    letters = letters_of(docs)
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = count_grams(docs, letters).toArrow()
    langs, of = rows["lang"].combine_chunks().dictionary_encode(), None
    if rows.num_rows:
        names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        gram, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        for j, x in sorted(enumerate(names), key=lambda k: k[1]):
            g, c = gram[of == j], n[of == j]
            order = np.argsort(g)
            counts[x] = (g[order], c[order])
    model = {"models": Models(counts), "letters": letters, "limits": np.full(len(counts), np.inf), "temperature": 50.0}
    if not counts:
        return model
    trained = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*counts)).select("lang", "text")
    found = cut(calibration_counts(trained, model))
    ends = found.where("model >= 0").groupBy("model", "own").agg(F.percentile("bin", F.array(F.lit(0.001), F.lit(0.999)), F.col("n")).alias("q")).collect()
    if ends:
        high, apart = np.full(len(counts), np.nan), np.full(len(counts), np.nan)
        for r in ends:
            (high if r.own else apart)[r.model] = r.q[1 if r.own else 0] / _STEPS
        model["limits"] = _between(high, apart)
        model["temperature"] = float(min((r.loss, r.bin) for r in found.where("model < 0").collect())[1])
    return model


def limits(e: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Greatest cross-entropy that each language accepts; e: documents x languages, right: their languages."""
    end = lambda x, q: np.quantile(x, q) if len(x) else np.nan
    high = [end(e[right == j, j], 0.999) for j in range(e.shape[1])]
    return _between(np.array(high), np.array([end(e[right != j, j], 0.001) for j in range(e.shape[1])]))


def _between(high: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Limits from the quantiles of a language's own documents and of the others, NaN where there are none."""
    out = np.maximum(high, (high + np.where(np.isnan(apart), 2 * high, apart)) / 2)
    return np.where(np.isnan(out), np.nanmax(out), out)


def score(docs: DataFrame, model: dict, *keep: str | Column) -> DataFrame:
    """doc_id, columns ``keep``, lang_pred, score, accepted, cross_entropy, entropies (by language, in sorted order)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        table = symbol_table(m["letters"])
        models, limits, t = m["models"], m["limits"], m["temperature"]
        for batch in batches:
            texts = batch.tolist()
            e, has = _entropies(m, table, texts)
            if not models.langs:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "accepted": False, "cross_entropy": 0.0, "entropies": [[]] * len(texts)})
                continue
            best = e.argmin(axis=1) if len(e) else np.zeros(0, np.int64)
            low = e[np.arange(len(e)), best]
            post = 1 / np.exp(-t * (e - low[:, None])).sum(axis=1)
            over = np.maximum(0, low - limits[best])
            yield pd.DataFrame({
                "lang_pred": np.where(has, np.array(models.langs, dtype=object)[best], "und"), "score": np.where(has, post * np.exp(-over), 0.0),
                "accepted": has & (over == 0), "cross_entropy": low, "entropies": list(e),
            })

    udf = F.pandas_udf(run, "lang_pred string, score double, accepted boolean, cross_entropy double, entropies array<double>")
    return docs.select("doc_id", *keep, udf(F.coalesce("text", F.lit(""))).alias("got")).select("doc_id", *[F.col(k) if isinstance(k, str) else k for k in keep], "got.*")
