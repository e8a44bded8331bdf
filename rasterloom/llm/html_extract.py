"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read once as words and tags. A word scores its probability of being main text less a constant, given where it
stands: the names of the open elements, the words of their classes, ids and roles (and what long ones begin with), the
nearest block, and three facts of structure. One is whether it stands beyond the innermost wrapper, an element that holds
the page's first heading (outside of headers, menus and other parts) and over half of its paragraph words (of an ``article`` or ``main``, a seventh; without a wrapper,
before the heading); one, whether all words of its block are links; one, whether it stands in one of several sibling
elements of one kind that hold a text beside another line, an author's or a date's, and no heading: entries of readers. A tag scores the log of the share of such tags that stand in main texts,
times a constant, times the probability that its place isn't main text: an item of a list in an article costs next to
nothing, one of a menu its full price. Tags are always negative. One linear scan finds the contiguous region of the
greatest sum: the main text. (Both constants are those that extract the prior pages best.) A block element whose words
have a negative sum is left out of the region (an advert in the middle); within the wrapper it costs the scan nothing, so a
short paragraph after it isn't lost. Class names are features whose weights are learnt; no element goes for its class
alone. A wrapper's class says nothing about its parts and is no feature.

Weights are fitted to labelled pages by logistic regression: those of the table that mark their article up (one
``article`` or ``main`` element, which is hidden from their own features, so what is learnt is how articles look without
the mark), and prior pages that ``prior_pages`` builds by rule. At most ``sample_pages`` marked pages (by page_id's
hash) are read, and their ``vocabulary`` most frequent features kept; both bound what the classifier is fitted to and
nothing else. Everything else covers every page whole.

Defined results: null and empty html give an empty text, as does a page without any word that scores above zero;
unclosed elements end with what holds them, stray end tags are ignored, a tag that never ends is dropped as browsers
do; a ``header`` inside the article belongs to it, so its headline stays; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored. Reading is linear in the page's length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import logistic, sigmoid

# HTML element names by what they are.
RAW = "script style textarea title iframe xmp noembed noframes"
UNSEEN = frozenset("head template noscript svg math canvas object audio video select datalist".split())
HEAD_PARTS = frozenset("title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p li td th dd dt blockquote pre figcaption caption summary".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOILERPLATE = "nav header footer aside form button dialog menu fieldset label".split()
ENTRY = frozenset("li dd div article section aside blockquote".split())
# Names that sites give to parts of pages, for the prior pages.
CONTENT_NAMES = "content article post entry story main body text prose document page single".split()
OTHER_NAMES = (
    "ad adv advert advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar side aside footer foot header masthead topbar comment "
    "discussion reply respond cookie consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendation "
    "popular trending breadcrumb pagination pager widget toolbar skip copyright legal disclaimer hidden complementary contentinfo search dialog"
).split()

TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>{'|'.join(RAW.split())})(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?P<close>>|\Z)|(?P<text>[^<]++|<)""",
    re.S | re.I,
)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def named(attrs: str) -> tuple[str, ...]:
    """Features of a start tag's class, id and role words (without a plural's s), or ".hidden"."""
    found = []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden":
            found += [".hidden"] if key == "hidden" or value.lower() == "true" else []
        else:
            for w in SPLIT.split(value):
                if w and not w.isdigit():
                    w = (w[:-1] if len(w) > 2 and w[-1] == "s" else w).lower()
                    found += ["." + w] + (["." + w[:7] + "~"] if len(w) >= 7 else [])
    return tuple(found)


def tokens(page: str) -> list[list]:
    """[value, end, features] of each token: the decoded text and 0; or a start tag's name, where its element ends and
    its features; or "/name" and 0 of an end tag. Text that isn't shown has no token."""
    out: list[list] = []
    open_: list[tuple[str, list]] = []
    at: dict[str, list[int]] = {}  # places in open_ by name
    blocks: list[int] = []
    unseen = 0

    def close(k: int) -> None:
        nonlocal unseen
        while len(open_) > k:
            name, token = open_.pop()
            token[1] = len(out)
            at[name].pop()
            unseen -= name in UNSEEN
            if blocks and blocks[-1] == len(open_):
                blocks.pop()

    def top() -> str:
        return open_[blocks[-1]][0] if blocks else ""

    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is not None:
            if not m["close"]:
                break
            name = name.lower()
            if m["end"]:
                k = at[name][-1] if at.get(name) else -1
                if k >= 0 and not (name in INLINE and blocks and blocks[-1] > k):
                    close(k)
                    out.append(["/" + name, 0, ()])
                continue
            if at.get("head") and name not in HEAD_PARTS:
                close(at["head"][-1])
            if name in ENDS_P and top() == "p":
                close(blocks[-1])
            while name in ITEMS and (top() == "p" or top() in ITEMS[name]):
                last = top()
                close(blocks[-1])
                if last == ITEMS[name][-1] and last != "dd":
                    break
            token = [name, len(out) + 1, (name, *named(m["attrs"]))]
            out.append(token)
            if name not in VOID and not (m["attrs"].endswith("/") and name in UNSEEN):
                at.setdefault(name, []).append(len(open_))
                if name not in INLINE:
                    blocks.append(len(open_))
                open_.append((name, token))
                unseen += name in UNSEEN
        elif m["text"] is not None and not unseen:
            out.append([html_lib.unescape(m["text"]) if "&" in m["text"] else m["text"], 0, None])
    close(0)
    return out


def entries(seq: list[list], size: list[int], nearest: list[int]) -> set[int]:
    """Start tags of sibling elements of one kind that each hold a text beside another line, and no heading. ``nearest``: the start
    tag of each token's nearest block."""
    direct: Counter = Counter()
    for n, k in zip(size, nearest):
        if n:
            direct[k] += n
    kinds: dict[int, set] = {}  # of an element the kinds of blocks in it that hold words
    heads = np.concatenate([[0], np.cumsum([bool(t[2]) and t[0] in HEADINGS for t in seq])]).tolist()
    for k in direct:
        if k >= 0:
            kinds.setdefault(nearest[k - 1] if k else -1, set()).add(seq[k][2])
    alike: dict[tuple, list[int]] = {}
    for k, held in kinds.items():
        if k < 0 or seq[k][0] not in ENTRY or heads[min(seq[k][1], len(seq))] > heads[k]:
            continue
        if len(held) >= 2 and {f[0] for f in held} != {"dt", "dd"} or direct[k]:
            alike.setdefault((nearest[k - 1] if k else -1, seq[k][2]), []).append(k)
    return {k for same in alike.values() if len(same) >= 2 for k in same}


def places(seq: list[list], hide: int = -1) -> tuple[list[int], list[tuple[str, ...]], tuple[int, int]]:
    """(number of the place of each token, features of each place, the innermost wrapper's span). ``hide``: a start tag
    without features."""
    size = [0 if f is not None else len(v.split()) for v, _, f in seq]
    stack: list[tuple[int, int]] = []
    block, nearest, in_block = [], [], [("html", -1)]
    link, free, linked = 0, set(), set()  # where the open link ends; blocks with words outside of links, and in links
    for i, (v, end, f) in enumerate(seq):  # the nearest block of each token
        while stack and stack[-1][0] <= i:
            stack.pop()
            in_block.pop()
        if f and v not in INLINE and v not in VOID:
            stack.append((end, i))
            in_block.append((v, i))
        block.append(in_block[-1][0])
        nearest.append(in_block[-1][1])
        if f and v == "a":
            link = end
        elif size[i]:
            (free if i >= link else linked).add(nearest[-1])
    sums = np.concatenate([[0], np.cumsum([n if b in PARAGRAPH else 0 for n, b in zip(size, block)])]).tolist()
    # the first heading that isn't a part's own; of a header only within an article or main
    heads: dict[str, int] = {}
    other, article = 0, 0  # where an open part, an open article ends
    for i, (v, end, f) in enumerate(seq):
        if f:
            article = max(article, end) if v in ("article", "main") and i >= other else article
            other = max(other, end) if v in BOILERPLATE and not (v == "header" and i < article) else other
            if v in ("h1", "h2", "p"):
                heads.setdefault(v if i >= other else v + " of a part", i)
    heading = next((heads[h] for h in ("h1", "h2", "p", "h1 of a part", "h2 of a part", "p of a part") if h in heads), -1)
    wrappers = {}
    for i, (v, end, f) in enumerate(seq):
        if f and v not in VOID and i <= heading < end:
            held = sums[min(end, len(seq))] - sums[i]
            if 2 * held > sums[-1] or v in ("article", "main") and i != hide and 7 * held > sums[-1]:
                wrappers[i] = min(end, len(seq))
    inner = max((i for i in wrappers if seq[i][0] not in INLINE and seq[i][0] not in PARAGRAPH and seq[i][0] not in HEADINGS and seq[i][0] not in ("html", "body")), default=-1)
    core = (inner, wrappers[inner]) if inner >= 0 else (heading if heading >= 0 and seq[heading][0] != "p" else 0, len(seq))
    repeated = entries(seq, size, nearest)
    active: Counter = Counter()
    held: list[tuple[int, tuple[str, ...]]] = []
    number: dict[tuple[str, ...], int] = {}
    where, now, told = [], (), ()
    changed = True
    for i, (v, end, f) in enumerate(seq):
        while held and held[-1][0] <= i:
            for x in held.pop()[1]:
                active[x] -= 1
                if not active[x]:
                    del active[x]
            changed = True
        if f and i != hide and v not in VOID:
            wrapper = i in wrappers
            own = () if v in ("html", "body") else f[:1] if wrapper else f
            if v in BOILERPLATE and ("article" in active or "main" in active):
                own = ("in>" + v, *own[1:])
            elif v == "article" and not wrapper:
                own = (("part>" if core[0] <= i < core[1] else "other>") + v, *own[1:])
            if i in repeated:
                own = (*own, ">entry")
            active.update(own)
            held.append((end, own))
            changed = True
        facts = (">" + block[i], *((">linked",) if nearest[i] in linked and nearest[i] not in free else ()), *(() if core[0] <= i < core[1] else (">beyond",)))
        if changed or facts != told:
            now, told, changed = (*facts, *sorted(active)), facts, False
        where.append(number.setdefault(now, len(number)))
    return where, list(number), core if inner >= 0 else (0, 0)


WORDS = "one of the many words that a text of this kind would have in it at this place"


def prior_pages() -> list[str]:
    """Labelled pages by rule: content under each usual name, other parts under each of theirs, beside and inside it.

    An attribute ``data-main`` or ``data-rest`` labels what an element holds, up to the next of them inside."""
    links = "".join(f"<li><a href=x>{w}</a></li>" for w in WORDS.split()[:6])
    text = f"<h1>{WORDS[:30]}</h1><p>{WORDS} <a href=x>one link</a> {WORDS}</p><h2>{WORDS[:20]}</h2><p>{WORDS}<br>{WORDS}</p><ul><li>{WORDS}</li></ul>"
    more = f"<blockquote><p>{WORDS}</p></blockquote><table><tr><td>{WORDS}</td></tr></table><pre>{WORDS}</pre><figure><figcaption>{WORDS}</figcaption></figure><dl><dt>one</dt><dd>{WORDS}</dd></dl>"
    pages = []
    for k, name in enumerate(OTHER_NAMES + BOILERPLATE):
        content = CONTENT_NAMES[k % len(CONTENT_NAMES)]
        kind = "div section aside div ul".split()[k % 5]
        tag = f'{kind} class="{name}"' if k < len(OTHER_NAMES) else name
        kind = tag.split()[0]
        inner = links if kind == "ul" else WORDS[:20] if k % 4 == 3 else f"{WORDS[:40]}<p>{WORDS}</p>"
        other = f"<{tag} data-rest>{inner}<a href=x>{WORDS[:10]}</a></{kind}>"
        if name in ("comment", "reply", "discussion", "respond", "related", "recommended", "popular", "trending"):
            other += f'<section class="{name}s" data-rest><h2>{WORDS[:10]}</h2><article class="{name if k % 2 else "card"}"><p>{WORDS} {WORDS}</p></article></section>'
        holder = ("article", f'div class="{content}"', "main", f'section id="{content}"', f'article class="{content}"', "div")[k % 6]
        holder_end = holder.split()[0]
        head = f"<header><h1>{WORDS[:30]}</h1><p>{WORDS}</p></header>" if holder_end in ("article", "main") else ""
        tail = more if k % 4 < 3 else f"<p>{WORDS[:18]}</p>"
        inside = f"{head}{text}{other if k % 2 else ''}{tail}"
        if k % 3 == 1:  # paragraphs without p
            inside = f"{head}{re.sub('(</?)p>', r'\1div>', text)}{other if k % 2 else ''}{tail}"
        if k % 5 == 4:
            inside = f"<div>{inside}</div>"
        body = f"<{holder} data-main>{inside}</{holder_end}>"
        pages.append(
            f"<html><body><header><h2><a href=x>{WORDS[:8]}</a></h2>{WORDS[:20]}</header><nav><ul>{links}</ul></nav>{'' if k % 2 else other}{body}"
            f"<div>{WORDS[:20]}<a href=x>one</a></div><footer>{WORDS[:30]}<p>{WORDS}</p><ul>{links}</ul></footer></body></html>"
        )
    short = lambda tag, n: "".join(f"<{tag}>{w}</{tag}>" for w in (WORDS.split() * 20)[:n])
    entry = [
        lambda k: f'<div class="{k}x"><b>{WORDS[:3]}</b><p>{WORDS}</p></div>', lambda k: f'<li class="{k}x"><div>{WORDS[:8]}</div><p>{WORDS} {WORDS}</p></li>',
        lambda k: f"<article><span>{WORDS[:3]}</span><time>{WORDS[4:10]}</time><p>{WORDS[:40]}</p></article>", lambda k: f'<div><p class="{k}a">{WORDS[:8]}</p><p>{WORDS}</p></div>',
    ]
    for k in range(48):  # lists and tables of short items with a short end; entries of readers under names that say nothing
        several = f"<h1>{WORDS[:20]}</h1><p>{WORDS}</p>" + (f"<ul>{short('li', 3 + 9 * (k % 5))}</ul>", f"<table><tr>{short('td', 3)}</tr><tr>{short('td', 3)}</tr></table>", f"<ol>{short('li', 30)}</ol><dl>{short('dt', 2)}{short('dd', 2)}</dl>")[k % 3] + f"<p>{WORDS[:14]}</p>"
        read = f'<{"section" if k % 2 else "div"} id="q{k}w" data-rest>{"<h2>" + WORDS[:8] + "</h2>" if k % 3 else ""}{"".join(entry[k % 4](f"q{k}") for _ in range(2 + k % 4 * 3))}</{"section" if k % 2 else "div"}>'
        holder = ("article", "div", "main", f'div class="q{k}z"')[k // 2 % 4]
        body = f"<{holder} data-main>{several}{read if k % 3 == 0 else ''}</{holder.split()[0]}>{read if k % 3 else ''}"
        pages.append(f"<html><body><div class=q{k}h data-rest><ul>{links}</ul></div>{body}<footer>{WORDS[:30]}</footer></body></html>")
    for k, (name, holder) in enumerate((n, h) for n in BOILERPLATE for h in ("article", "main", "div")):  # each inside each
        part = f"<{name} data-rest>{f'<ul>{links}</ul>' if k % 2 else f'{WORDS[:30]}<a href=x>{WORDS[:10]}</a>'}</{name}>"
        after = "section" if k % 2 else "div"
        after = f'<{after} class="q{k}y"><p>{WORDS}</p>' + f"<p>{WORDS}</p>" * (k % 3) + f"</{after}>"
        pages.append(f"<html><body><{holder} data-main>{text}{part if k % 4 < 2 else ''}<p>{WORDS}</p>{part if k % 4 > 1 else ''}</{holder}>{after}</body></html>")
    pages += [f"<span data-main>{WORDS}</span>", f"<b data-main>{WORDS}</b>", f"<html><body data-main>{WORDS}<br>{WORDS}</body></html>"] * 4  # text without any part
    for name in CONTENT_NAMES:  # lists of articles
        some = "".join(f"<article><h2>{WORDS[:20]}</h2><p>{WORDS} {WORDS}</p></article>" for _ in range(4))
        pages.append(f'<html><body><nav><ul>{links}</ul></nav><div class="{name}" data-main>{some}</div><footer>{WORDS}</footer></body></html>')
    return pages


def _marked(seq: list[list]) -> tuple[int, list[int]] | None:
    """(the start tag that marks the article, label of each token: 1, 0, or -1 for parts of it that may not be main text)."""
    for mark in ("article", "main"):
        begin = [i for i, t in enumerate(seq) if t[2] and t[0] == mark]
        if len(begin) == 1:
            break
    else:
        return None
    label = [0] * len(seq)
    a, b = begin[0], min(seq[begin[0]][1], len(seq))
    label[a:b] = [1] * (b - a)
    for i in range(a + 1, b):
        if seq[i][2] and seq[i][0] in BOILERPLATE:
            end = min(seq[i][1], b)
            label[i:end] = [-1] * (end - i)
    return a, label


def _prior_labels(page: str) -> tuple[list[list], list[int]]:
    """Tokens of a prior page without its label attributes, and their labels."""
    seq = tokens(re.sub(r"data-(main|rest)", r'id="data-\1"', page))
    label, stack = [], []
    for i, t in enumerate(seq):
        while stack and stack[-1][0] <= i:
            stack.pop()
        if t[2]:
            got = 1 if ".main" in t[2] and ".data" in t[2] else 0 if ".rest" in t[2] else None
            if got is not None:
                stack.append((t[1], got))
                t[2] = tuple(x for x in t[2] if x != ".data" and x != (".main" if got else ".rest"))
        label.append(stack[-1][1] if stack else 0)
    return seq, label


def examples(seq: list[list], label: list[int], hide: int = -1, named: bool = True) -> list[tuple[str, str, float, float]]:
    """(kind, features of a place or name of a tag, weight inside, weight outside). A page's words inside and outside
    have a weight of one each, as have its tags; with ``named`` half of it more."""
    where, kinds, _ = places(seq, hide)
    word, tag = np.zeros((len(kinds), 2)), {}
    for i, (w, y) in enumerate(zip(where, label)):
        if y < 0:
            continue
        if seq[i][2] is None:
            word[w, 1 - y] += len(seq[i][0].split())
        elif i != hide:
            tag.setdefault(seq[i][0].lstrip("/"), [0.0, 0.0])[1 - y] += 1
    word /= np.maximum(word.sum(axis=0), 1)
    total = np.maximum(np.sum([v for v in tag.values()], axis=0) if tag else np.zeros(2), 1)
    rows = [("word", " ".join(k), *map(float, v)) for k, v in zip(kinds, word) if v.any()]
    if named:  # once more without what is known of the wrapper, so that names count where structure says nothing
        rows += [("word", " ".join(f for f in k.split() if f != ">beyond"), i / 2, o / 2) for _, k, i, o in rows]
    return rows + [("tag", k, float(v[0] / total[0]), float(v[1] / total[1])) for k, v in sorted(tag.items())]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page in batch["html"]:
            seq = tokens(page)
            got = _marked(seq)
            if got:
                rows += examples(seq, got[1], got[0])
        yield pd.DataFrame(rows, columns=["kind", "name", "inside", "outside"])


def learn(pages: DataFrame, sample_pages: int = 500, vocabulary: int = 2000) -> dict:
    """The model of ``fit`` from the pages that mark their article up and the prior pages."""
    some = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    labelled = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).join(F.broadcast(some.distinct()), "page_id", "left_semi")
    counts = labelled.select("html").mapInPandas(_counted, "kind string, name string, inside double, outside double")
    rows = counts.groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return fit(sorted((r.kind, r.name, round(r.inside, 6), round(r.outside, 6)) for r in rows), vocabulary)


def fit(rows: list[tuple[str, str, float, float]], vocabulary: int = 2000) -> dict:
    """Weights of features and tags, and the two constants of the scan."""
    held: dict[tuple[str, str], np.ndarray] = {}
    prior = prior_pages()
    for page in prior:
        seq, label = _prior_labels(page)
        for kind, name, i, o in examples(seq, label, named="<div class=q" not in page and 'class="q' not in page):
            held.setdefault((kind, name), np.zeros(2))[:] += np.array([i, o]) * 20
    for kind, name, i, o in rows:
        held.setdefault((kind, name), np.zeros(2))[:] += (i, o)
    word = {tuple(k[1].split()): v for k, v in held.items() if k[0] == "word"}
    often: Counter = Counter()
    for k, v in word.items():
        for f in k:
            often[f] += float(v.sum())
    index = {f: j for j, (f, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:vocabulary])}
    x = np.zeros((2 * len(word), len(index)))
    y, weight = np.zeros(2 * len(word)), np.zeros(2 * len(word))
    for r, (k, v) in enumerate(sorted(word.items())):
        some = [index[f] for f in k if f in index]
        x[2 * r, some] = x[2 * r + 1, some] = 1
        y[2 * r], weight[2 * r], weight[2 * r + 1] = 1, v[0], v[1]
    w = logistic(x, y, l2=0.002, weight=weight)
    tag = {k[1]: float(np.log((v[0] + 0.01) / (v.sum() + 0.02))) for k, v in held.items() if k[0] == "tag"}
    model = {"word": {f: float(w[j]) for f, j in index.items()}, "base": float(w[-1]), "tag": tag, "other": float(np.log(0.5))}
    tried = [model | {"less": less, "scale": scale} for less in (0.5, 0.4, 0.3, 0.2, 0.1) for scale in (0.5, 0.2, 0.1, 0.05)]
    got = [float(np.mean([_agreement(page, m) for page in prior])) for m in tried]
    return next(m for m, f1 in zip(tried, got) if f1 >= max(got) - 0.003)  # the strictest of about the best


def _agreement(page: str, model: dict) -> float:
    """F1 of a prior page's words."""
    seq, label = _prior_labels(page)
    size = np.array([len(t[0].split()) if t[2] is None else 0 for t in seq])
    kept = np.zeros(len(seq), dtype=bool)
    kept[main_text(seq, model)] = True
    return 2 * size[kept & (np.array(label) == 1)].sum() / (size[kept].sum() + size[np.array(label) == 1].sum())


def maximal(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches (begin, end) in order, in linear time (the best of them is the best stretch of all)."""
    left: list[float] = []  # sum before each stretch
    right: list[float] = []  # sum at its end
    span: list[tuple[int, int]] = []
    back: list[int] = []  # the last stretch before it of a lesser sum before
    total = 0.0
    for i, s in enumerate(scores):
        low, total = total, total + s
        if s <= 0:
            continue
        begin = i
        while True:
            j = len(span) - 1
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= total:
                break
            begin, low = span[j][0], left[j]
            del left[j:], right[j:], span[j:], back[j:]
        left.append(low)
        right.append(total)
        span.append((begin, i + 1))
        back.append(j)
    return span


def scored(seq: list[list], model: dict) -> tuple[list[float], list[float], tuple[int, int]]:
    """(score, score of its words alone) of each token, and the innermost wrapper's span."""
    where, kinds, core = places(seq)
    weight, tag = model["word"], model["tag"]
    odds = np.array([model["base"] + sum(weight.get(f, 0.0) for f in k) for k in kinds])
    chance = sigmoid(odds)
    word, doubt = (chance - model["less"]).tolist(), (1 - chance).tolist()
    words = [word[w] * len(t[0].split()) if t[2] is None else 0.0 for t, w in zip(seq, where)]
    return [s if t[2] is None else model["scale"] * tag.get(t[0].lstrip("/"), model["other"]) * doubt[w] for t, s, w in zip(seq, words, where)], words, core


def region(scores: list[float]) -> tuple[int, int]:
    """The stretch of the greatest sum, the first of equals; empty if no score is positive."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return max(maximal(scores), key=lambda s: sums[s[1]] - sums[s[0]], default=(0, 0))


def foreign(seq: list[list], words: list[float]) -> dict[int, int]:
    """Block elements whose words have a negative sum, outermost ones: start tag to end."""
    sums = np.concatenate([[0.0], np.cumsum(words)]).tolist()
    found, i = {}, 0
    while i < len(seq):
        value, stop, f = seq[i]
        if f and value not in INLINE and value not in ("html", "body") and sums[min(stop, len(seq))] < sums[i]:
            found[i] = i = min(stop, len(seq))
        else:
            i += 1
    return found


def main_text(seq: list[list], model: dict) -> list[int]:
    """Tokens of the main text."""
    scores, words, core = scored(seq, model)
    out = foreign(seq, words)
    for i, stop in out.items():
        if core[0] < i < core[1]:
            scores[i:stop] = [0.0] * (stop - i)
    i, end = region(scores)
    kept = []
    while i < end:
        kept.append(i)  # of what is left out the tag alone: it parts what stands around it
        i = min(out[i], end) if i in out else i + 1
    return kept


def extract(page: str | None, model: dict) -> str:
    """Main text of one page."""
    if not page:
        return ""
    seq, parts = tokens(page), []
    for i in main_text(seq, model):
        value, _, f = seq[i]
        if f is None:
            parts.append(value)
        elif value.lstrip("/") not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract_pages(pages: DataFrame, model: dict | None = None, sample_pages: int = 500) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    w = model or learn(pages, sample_pages)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, w) for p in batch], dtype=object)

    text = F.pandas_udf(run, "string")(F.coalesce("html", F.lit("")))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
