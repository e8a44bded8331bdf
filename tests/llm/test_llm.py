"""Each operator against a brute-force version or a round trip, with nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import bpe, bwt, chat_format, decontaminate, exact_dedup, html_extract, lang_id, quality, simhash, suffix_dedup, toxicity
from rasterloom.operators.components import components

WORDS = ["the", "and", "of", "thing", "éa", "ö", "wh ", "x"]
DOCS = "doc_id long, text string"


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    shared, loop, out = prose(draw, 40), prose(draw, 30), []
    for i in range(90):
        t = prose(draw, draw.randint(0, 60))
        t = t[:40] + shared + t[40:] if i % 5 == 0 else t + loop * 2 if i % 7 == 0 else out[0][1] if i % 11 == 0 else t
        out.append((i if i % 13 else None, t))
    return out + [(5, None), (6, ""), (7, "a" * 1000), (7, "ab" * 500), out[10], out[10], (200, out[3][1] + "x"), (201, " a\t\nb "), (202, " a b ")]


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "####", "a</turn>\n", "\\", "#\\##", "", None, "<", "</turn", "\\\\c"]
    table = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", ":x", None, "a\\c:", "assistant", "user", "assistant", "user", "assistant"], nasty))]
    table += [(2, None, "user", "first"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    got = chat_format.format_conversations(chat_format.reply_tree(df))
    out = {r.conv_id: r for r in got.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("turn_spans")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in out[1].t] == [(r or "", t or "") for _, _, r, t in table[:10]]
    assert out[1].loss == "".join(t or "" for _, _, r, t in table[:10] if r == "assistant")
    assert [x.text for x in out[2].t] == ["first", "a", "b"] and set(out) == {1, 2}
    assert chat_format.format_conversations(chat_format.reply_tree(df.limit(0))).count() == 0


def test_chat_tree(spark):
    draw, table = random.Random(1), []
    for k in range(60):
        table.append((1, k, draw.randrange(k) if k else None, "user", f"m{k}", float(draw.randrange(5))))
    table += [(2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (3, 1, 99, "user", "orphan", None)]
    df = spark.createDataFrame(table, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.leaf_id): r for r in chat_format.format_conversations(df, top_k=3).withColumn("t", chat_format.parse(F.col("formatted"))).collect()}
    parent, score = {r[1]: r[2] for r in table[:60]}, {r[1]: r[5] for r in table[:60]}
    paths = {}
    for leaf in set(parent) - set(parent.values()):
        path, k = [], leaf
        while k is not None:
            path.append(k)
            k = parent[k]
        paths[leaf] = path[::-1]
    best = sorted(paths, key=lambda x: (-sum(score[k] for k in paths[x]), -len(paths[x]), x))[:3]
    assert {k[1] for k in got if k[0] == 1} == set(best) and not [k for k in got if k[0] == 2] and (3, 1) in got
    for leaf in best:
        assert [x.text for x in got[1, leaf].t] == [f"m{k}" for k in paths[leaf]]


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup(spark, rows, digest):
    """Also with a digest that collides: whole contents decide."""
    import re

    df = spark.createDataFrame(rows, DOCS).withColumn("d", F.lit(1)).repartition(3)
    got = exact_dedup.exact_dedup(df, **({"digest": digest} if digest else {})).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
    for sha in groups:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1 or not [i for i in groups[sha] if i is not None]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_html():
    w = html_extract.fit([])
    page = (
        '<html><body class="home"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies and many words here</p></div><div class="menu"><a href=x>One</a></div>'
        '<div class="content"><h2>Title &eacute;</h2><p>Hello <i>wor</i>ld.<br>Second   line<p>More &lt;text&gt; here<aside>side words</aside><form><input><p>sign up</form><p>Last words stay too.</p>'
        '<script>var a="<p>no</p>"</script><section class="comments"><p>First comment!</p></section></div><div class="sidebar"><p>Related stuff</p></div><footer><p>(c) 2020</p></footer></body></html>'
    )
    assert html_extract.extract(page, w) == "Title é Hello world. Second line More <text> here Last words stay too."
    assert html_extract.extract(None, w) == html_extract.extract("", w) == html_extract.extract("<p", w)[:0] == ""
    assert html_extract.extract("<p>" + "word " * 50_000, w).count("word") == 50_000


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b c</p></article>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract_pages(df).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "a b c", 5), (2, "", 0), (2, "", 0)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_decontaminate(spark):
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, text(draw.randint(3, 50))) for k in range(20)] + [(20, None), (None, text(9)), (21, ""), (23, "w1 W2, w3"), (24, "w7"), (25, "w5 w6")]
    phrase = text(8)
    items += [(30 + k, phrase + " " + text(6)) for k in range(8)]  # shingles that several items share
    items.append((22, items[4][1].upper()))
    docs = []
    for k in range(80):
        t = text(draw.randint(0, 200))
        if k % 4 == 0:
            item = items[draw.randrange(20)][1].split()
            if k % 8 == 0 and len(item) > 12:
                item[draw.randrange(len(item))] = "changed"
            t = t[: len(t) // 2] + ", " + "; ".join(item) + " " + t[len(t) // 2 :]
        docs.append((k, t))
    docs += [(90, None), (None, items[0][1]), docs[0], (91, items[5][1] * 3000), (92, "W1-w2 w3"), (93, "w5"), (94, phrase), (95, f"{phrase} {items[-1][1]} {items[-2][1]}")]
    import re

    def shingles(t, of=None):
        w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
        k = min(5, len(w)) if of is None else of
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w and k else set()

    def leaks(t, s):
        own = shingles(s)
        return own and len(shingles(t, len(next(iter(own)))) & own) >= 0.8 * len(own)

    want = {(d, i) for d, t in docs for i, s in items if d is not None and i is not None and leaks(t, s)}
    a, b = spark.createDataFrame(docs, DOCS).withColumn("rep", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    for most, common in ((64 << 20, 16), (0, 16), (64 << 20, 3)):
        got = decontaminate.contaminated(a, b, broadcast_bytes=most, common=common).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert decontaminate.contaminated(a.limit(0), b).count() == decontaminate.contaminated(a, b.limit(0)).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_keys():
    code, draw = simhash.Golay(), np.random.default_rng(0)
    words = draw.integers(0, 1 << 23, 500)
    assert (np.sort(code.near(words)[1][:500]) == np.sort(code.nearest(words))).all()
    at, key = code.near(words)
    held = [set(key[at == k].tolist()) for k in range(500)]
    assert all(len(s) in (1, 6) for s in held)
    for bit in range(23):  # words one bit apart: the nearest key of one is a key of the other
        near = code.nearest(words ^ (1 << bit))
        assert all(int(n) in s for n, s in zip(near, held))


@pytest.mark.parametrize("most", [256, 0])
def test_simhash_components(spark, rows, most):
    draw = random.Random(2)
    near = [draw.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        base = draw.choice(near)
        near.append(base ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 4))) & (2**64 - 1))
    fps = sorted(set(near))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    root = {f: f for f in signed}
    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                x, y = find(signed[i]), find(signed[j])
                root[max(x, y)] = min(x, y)
    got = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most))
    assert {r.node: r.root for r in got.collect()} == {f: find(f) for f in signed if sum(find(g) == find(f) for g in signed) > 1}
    if most:
        out = simhash.simhash_groups(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(0))).collect()
        assert len(out) == len(rows) and {(r.doc_id, r.fingerprint) for r in out} == {(i, f"{brute_fingerprint(t):016x}") for i, t in rows}
        assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_language(spark):
    draw = random.Random(4)
    a, b = ["straße", "und", "nicht", "größe"], ["que", "ción", "los", "niño"]
    table = [(k, " ".join(draw.choice(x) for _ in range(30)), lang) for k in range(60) for x, lang in ((a, "de"), (b, "es")) if k % 2 == (lang == "es")]
    table += [(100, None, "de"), (101, "12 34 !!", "de"), (102, "und nicht", None), (103, "", None), (104, "и то же " * 9, None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    model = lang_id.train(df)
    got = {r.doc_id: r for r in lang_id.score(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in table if i < 100) and got[102].lang_pred == "de"
    assert [got[k].lang_pred for k in (100, 101, 103)] == ["und"] * 3 and not got[104].accepted and all(0 <= r.score <= 1 for r in got.values())
    none = lang_id.train(df.limit(0))
    assert {r.lang_pred for r in lang_id.score(df, none).collect()} == {"und"} and lang_id.score(df.limit(0), model).count() == 0


def test_kneser_ney():
    """Probabilities of a context sum to one over the symbols seen, less what the floor gives to one that isn't."""
    table = lang_id.symbol_table()
    g, n = np.unique(lang_id.grams(["the cat sat on the mat", "a cat and the dog"], table)[0], return_counts=True)
    m = lang_id.Models({"x": (g, n)})
    symbols = np.unique(g & np.uint64((1 << lang_id.BITS) - 1))
    context = g[7] >> np.uint64(lang_id.BITS) << np.uint64(lang_id.BITS)
    total = np.exp(m.logs(context | symbols)[:, 0]).sum()
    unseen = np.exp(m.logs(np.array([context | np.uint64(ord("z"))]))[0, 0])
    assert abs(total + unseen - 1) < 1e-5


def test_bpe(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    codec, encoding = bpe.Codec(ranks, public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    odd = ["", "a" * 5000, "ab" * 3000, "日本語テキスト" * 100, " 　 x  y\n\n z", "=+-" * 900, "".join(draw.choice("abc") for _ in range(9000)), "🤷‍♀️🇩🇪" * 20, "I'll they've 123456789 \t\t"]
    odd += ["".join(chr(draw.choice([draw.randint(32, 126), draw.randint(0x80, 0x2FFF)])) for _ in range(draw.randint(0, 80))) for _ in range(100)]
    ids, counts = codec.encode(odd)
    at = 0
    for text, n in zip(odd, counts):
        assert ids[at : at + n].tolist() == encoding.encode_ordinary(text) and codec.decode(ids[at : at + n]).tobytes() == text.encode()
        at += n
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(0))
    got = bpe.encode_documents(df, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    assert bpe.digest_documents(df.limit(0), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, public.PATTERN)


def test_classifiers(spark):
    draw = random.Random(6)
    table, labels = [], []
    for k in range(400):
        words = [draw.choice(WORDS).strip() for _ in range(60)]
        toxic, good = k % 5 == 0, k % 3 > 0
        if toxic:
            words[10], words[30] = draw.choice(["vile", "nasty"]), "rotten"
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        table.append((k, text))
        labels.append((k, int(good), int(toxic)))
    table += [(900, None), (901, ""), (902, "x" * 200_000)]
    docs, known = spark.createDataFrame(table, DOCS).withColumn("f", F.lit(0)), spark.createDataFrame(labels + [(900, None, None), (0, None, 1)], "doc_id long, quality int, toxic int")
    train, held = known.where("doc_id % 4 <> 0"), {k: (g, t) for k, g, t in labels if k % 4 == 0}
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, train)).collect()}
    assert np.mean([got[k].predicted == g for k, (g, _) in held.items()]) > 0.98 and len(got) == len(table)
    model = toxicity.train(docs, train, ("quality", "toxic"))
    out = {r.doc_id: r.scores for r in toxicity.score(docs, model).collect()}
    assert np.mean([(out[k][1] >= 0.5) == t for k, (_, t) in held.items()]) > 0.98
    assert {r.score for r in quality.score(docs, quality.train(docs, train.limit(0))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, train.limit(0), ("toxic",))).count() == 0


def test_bwt_merge():
    draw = random.Random(1)
    strings = [bytes(draw.choice(b"abc ") for _ in range(draw.randint(0, 60))) for _ in range(30)]
    strings += [strings[3] + b"xx" + strings[5]] * 3
    for size in (40, 300, 10_000):
        for depth in (4, 8, 20):
            found = {}
            for k, s, o in zip(*bwt.repeated(strings, depth, size)):
                found.setdefault(k, []).append((int(s), int(o)))
            places = {}
            for i, s in enumerate(strings):
                for o in range(len(s) - depth + 1):
                    places.setdefault(s[o : o + depth], []).append((i, o))
            assert sorted(sorted(v) for v in found.values() if len(v) > 1) == sorted(v for v in places.values() if len(v) > 1)


@pytest.mark.parametrize("depth", [64, 100])
def test_suffix_dedup(spark, rows, depth):
    null = suffix_dedup.NULL_DOC
    seen, want = set(), {}
    # rows of one doc_id (7, null) and different texts are in the order of their texts' XXH64, signed
    place = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    for d, t in sorted({(null if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], place(r[1]))):
        b = t.encode()
        covered = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - depth + 1):
            if b[s : s + depth] in seen:
                covered[s : s + depth] = True
            seen.add(b[s : s + depth])
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~covered[:-1]])
        want[d, t] = (len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(rows, DOCS).withColumn("x", F.lit(0)).repartition(5)
    key = lambda i: null if i is None else i
    for spread in (4096, 8, 1):  # every repeated anchor is hot at 1
        out = suffix_dedup.suffix_dedup(df, depth, spread=spread).collect()
        assert len(out) == len(rows)
        assert {(key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == {(d, *v) for (d, _), v in want.items()}
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(df, 30)


def test_suffix_dedup_hot_passage(spark):
    """One passage in many documents, each with its own surroundings: no group holds more than the bound on pairs."""
    draw = random.Random(5)
    passage = prose(draw, 40).encode()[:140].decode("utf-8", "ignore")
    texts = ["".join(draw.choice("abcdef ") for _ in range(80)) + passage + "".join(draw.choice("abcdef ") for _ in range(80)) for _ in range(300)]
    size = len(passage.encode())
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    for spread in (4096, 10):
        got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df, spread=spread).collect()}
        assert got[0].n_removed == 0 and all(got[i].n_spans == 1 and size <= got[i].n_removed <= size + 12 for i in range(1, 300))
    raw = np.frombuffer(texts[0].encode(), np.uint8)
    _, place, first, last, _ = suffix_dedup.anchors(raw, np.zeros(1, np.int64), np.array([len(raw)]), 100)
    for p, f, e in zip(place.tolist(), first.tolist(), last.tolist()):
        content = raw[f : e + 100].tobytes()
        windows = [start + k for start, pair, _ in suffix_dedup._pairs(content, p - f, 100) for k in range(len(pair) - 99)]
        assert windows == list(range(e - f + 1))
        assert all(content[start : start + len(pair)] == pair for start, pair, _ in suffix_dedup._pairs(content, p - f, 100))


def test_pipeline(spark):
    """Each stage against a brute-force version of its decision on its own input."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(P.STAGES)
    spoken = steps["language"](spark, docs, sf)
    assert spoken.columns == docs.columns and spoken.count() >= 0.98 * docs.count()
    once = steps["exact_copies"](spark, docs, sf)
    assert once.count() == docs.select(exact_dedup.normalised(F.col("text"))).distinct().count()
    # the stage's rule is five words and a similarity of 0.8, all pairs of whole texts
    from test_near_copies import brute_components

    given = once.select("doc_id", "text").orderBy("doc_id").collect()
    left = sorted(r.doc_id for r in steps["near_copies"](spark, once, sf).collect())
    assert left == sorted({given[k].doc_id for k in brute_components([r.text for r in given])}) and len(left) < len(given)
    assert P.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_exact_dedup_plan(spark, rows):
    """Texts of unrepeated digests aren't shuffled: below the first exchange of texts is the tasks' own aggregation, over
    rows that a broadcast has filtered. Without the broadcast the result is the same; a hot digest too."""
    hot = rows + [(1000 + k, "hot  text") for k in range(300)] + [(5000, "hot text")]
    df = spark.createDataFrame(hot, DOCS).repartition(6)
    full = df.select("doc_id", exact_dedup.normalised(F.col("text")).alias("t")).withColumn("d", F.sha2("t", 256))
    first = full.groupBy("d").count().where("count > 1").select("d")
    plan = exact_dedup.combined(full, first, 10, 64, 64 << 20)._jdf.queryExecution().executedPlan().toString()
    texts = [i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning(" in line and " t#" in line]
    below = plan.splitlines()[texts[-1] + 1 :]
    assert "Aggregate" in below[0] and "partial_" in "".join(below[:2]) and any("BroadcastHashJoin" in x and "LeftSemi" in x for x in below)
    key = lambda df: sorted(map(str, df.collect()))
    once = key(exact_dedup.exact_dedup(df))
    assert once == key(exact_dedup.exact_dedup(df, broadcast_bytes=0)) == key(exact_dedup.exact_dedup(df, salts=1))
    assert sum("group_size=301" in r for r in once) == 301
