"""Main text of pages: the scan against all intervals, wrong turns that must not come back, hostile markup, quality."""

import html
import random
import re
import time

import pandas as pd
import pytest

from rasterloom.llm import html_extract as H

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def model():
    return H.fit([])


def test_region_is_the_best_of_all_intervals():
    draw = random.Random(1)
    for _ in range(300):
        scores = [draw.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(draw.randint(0, 25))]
        n = len(scores)
        best = max([sum(scores[i:j]) for i in range(n) for j in range(i, n + 1)], default=0)
        a, b = H.region(scores)
        assert sum(scores[a:b]) == max(best, 0) and (best > 0 or a == b)
        spans = H.maximal(scores)
        for (i, j), after in zip(spans, [*spans[1:], (n, n)]):  # every part of a maximal stretch is worth less, no longer one is better
            assert j <= after[0] and scores[i] > 0 and scores[j - 1] > 0
            assert all(sum(scores[i:k]) > 0 and sum(scores[k:j]) > 0 for k in range(i + 1, j))


CASES = {
    '<div class="container with-sidebar"><h1>Head line</h1><p>article words are here</p></div>': "Head line article words are here",
    '<body><article><h1>T</h1><p>main words of the text</p><p>and more</p></article><section class="comments"><article class="comment"><p>I think so too</p></article></section></body>': "T main words of the text and more",
    '<body><main><h1>T</h1><p>main words of the text</p><p>and more</p></main><aside class="related"><article class="card"><p>teaser</p></article></aside></body>': "T main words of the text and more",
    "<body><article><header><h1>Headline</h1></header><p>main words of the text</p><p>and more</p></article></body>": "Headline main words of the text and more",
    '<body><div class="main-content"><h1>T one</h1><p>Para one is here.</p><div class="advert">Buy this now please</div><p>Para two.</p></div><ol class="comment-list"><li class="comment"><p>Nice</p></li></ol></body>': "T one Para one is here. Para two.",
    "<main><h1>A</h1><p>x y z</p><form><label>Name</label><input><button>Send it</button></form></main>": "A x y z",
    '<body><div class="notice">Read this notice</div><div id="content"><p>No heading on this page.</p><p>But text.</p></div></body>': "No heading on this page. But text.",
    "<head><title>t</title><p>no head end": "no head end",
    "just text": "just text",
    "<!-- a --><!--><p>x &amp; y&nbsp;z<!-- open": "x & y z",
    "<p>a<script>b</script >c</p><textarea>no</textarea>": "ac",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(model, page):
    assert H.extract(page, model) == CASES[page]


@pytest.mark.parametrize("page", ["<a" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<script>" * 50_000, "<b><div>" * 30_000 + "</b>" * 30_000, '<a x="' * 50_000, "<a =" + " " * 200_000, "<" * 100_000, "</ " * 100_000])
def test_hostile_markup_is_linear(model, page):
    began = time.process_time()
    H.extract(page, model)
    assert time.process_time() - began < 4


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?(?:b|i|a)(?: [^>]*)?>", "", inner))).split())


def test_pages_and_what_the_scan_is_worth(model):
    """The marked article is found whole without training on the table; without the scan it isn't."""
    pages = pd.read_parquet(PAGES).html
    pages = [p for p in pages if re.search(r"<article>.*</article>", p, re.S)]
    right = whole = 0
    for p in pages:
        right += H.extract(p, model) == article(p)
        seq = H.tokens(p)
        whole += " ".join("".join(t[0] if t[2] is None else " " for t in seq).split()) == article(p)
    assert right >= 0.98 * len(pages) and whole == 0


def test_learning_is_from_the_marked_pages(spark, model):
    """A class that stands for boilerplate on the table's pages is learnt as such; nulls, repeats and clashing names."""
    page = '<html><body><div class="xyzzy">one two three four</div><article><h1>Head</h1><div class="inner">text text text text</div></article></body></html>'
    df = spark.createDataFrame([(k, "u", page) for k in range(40)] + [(50, None, None), (50, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as inside")
    got = H.learn(df)
    assert got["word"][".xyzzy"] < -1 < model["word"].get(".xyzzy", 0.0)
    out = {r.page_id: r.text for r in H.extract_pages(df, got).collect()}
    assert out[0] == "Head text text text text" and out[50] == ""
    assert H.extract_pages(df.limit(0)).count() == 0


def items(tag, n, each):
    return f"<{tag}>{''.join(each.format(f'item{k}') for k in range(n))}</{tag}>"


NAV, FOOTER = "<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav>", "<footer>Copyright by someone</footer>"
SHORT = {"ul": "<li>{}</li>", "ol": "<li>{}</li>", "table": "<tr><td>{}</td></tr>", "dl": "<dt>{}</dt>"}


@pytest.mark.parametrize("n", [2, 10, 20, 40, 200])
@pytest.mark.parametrize("holder", ["article", "div", 'div class="kfzq"', "main"])
def test_short_items_and_what_follows_stay(model, n, holder):
    """Lists and tables of one-word items are kept whole, and so is a short end after them."""
    for tag, each in SHORT.items():
        page = f"<html><body>{NAV}<{holder}><h1>The heading here</h1><p>This is a paragraph of the article with some words in it.</p>{items(tag, n, each)}<p>The closing words.</p></{holder.split()[0]}>{FOOTER}</body></html>"
        want = f"The heading here This is a paragraph of the article with some words in it. {' '.join(f'item{k}' for k in range(n))} The closing words."
        assert H.extract(page, model) == want, tag


BODY = "<h1>The heading here</h1><p>This is a paragraph of the article with some words in it.</p><p>And there is another one, of about the same length as that.</p>"
TEXT = "The heading here This is a paragraph of the article with some words in it. And there is another one, of about the same length as that."
ENTRIES = [
    "".join(f"<div class=e><b>{who}</b><p>{what}</p></div>" for who, what in (("Ann", "I think so too, thanks for this."), ("Bob", "No, this is not how it works at all."))),
    "<ol>" + "".join(f"<li><div>{who} said</div><p>{what}</p></li>" for who, what in (("Ann", "I think so too, thanks for this."), ("Bob", "No, not at all."), ("Cy", "Yes."))) + "</ol>",
    "".join(f"<article><a href=x>{who}</a> <time>today</time><p>{what} {what} {what}</p></article>" for who, what in (("Ann", "I think so too, thanks for this."), ("Bob", "No, this is not how it works at all."))),
]


@pytest.mark.parametrize("part", ['section id="commentlist"', 'div id="disqus_thread"', 'div class="user-responses"', 'section class="remarks"', 'div class="xqzt"'])
@pytest.mark.parametrize("kind", range(3))
def test_entries_of_readers_go_by_structure(model, part, kind):
    """Inside and after the article, whatever their class; a single one after it, too."""
    readers = f"<{part}>{ENTRIES[kind]}</{part.split()[0]}>"
    one = f"<{part}><p>I think so too, thanks for this.</p></{part.split()[0]}>"
    for inside, after in ((readers, ""), ("", readers), ("", one)):
        for holder in ("article", 'div class="kfzq"'):
            assert H.extract(f"<html><body>{NAV}<{holder}>{BODY}{inside}</{holder.split()[0]}>{after}{FOOTER}</body></html>", model) == TEXT


def test_sections_and_loose_lists_are_no_entries(model):
    for part in ("".join(f"<section><h2>Part {k}</h2><p>words of the part number {k}</p></section>" for k in range(4)), "<ul>" + "<li><p>words of an item</p></li>" * 5 + "</ul>", "<table>" + "<tr><th>name</th><td>value</td></tr>" * 6 + "</table>"):
        want = " ".join(re.sub("<[^>]+>", " ", BODY + part).split())
        assert H.extract(f"<html><body>{NAV}<article>{BODY}{part}</article>{FOOTER}</body></html>", model) == want


def random_pages(n=60):
    """Pages whose class words say nothing: (page, main text)."""
    draw = random.Random(9)
    name = lambda: "".join(draw.choice("bcdfghklmnpqrstvwxz") for _ in range(6))
    say = lambda k: " ".join(draw.choice("time year people way day man thing woman life child world school state family".split()) for _ in range(k))
    pages = []
    for k in range(n):
        paragraphs = [say(draw.randint(3, 60)) for _ in range(draw.randint(2, 9))]
        head, advert, teaser = say(5), say(draw.randint(4, 25)), [say(draw.randint(5, 30)) for _ in range(3)]
        holder = ("article", f'div class="{name()}"', "main", f'section id="{name()}"')[k % 4]
        inner = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs[:-1]) + (f"<aside class={name()}>{advert}</aside>" if k % 2 else "") + f"<p>{paragraphs[-1]}</p>"
        menu = "".join(f'<div class="{name()}"><a href=x>{say(1)}</a></div>' for _ in range(8))
        side = f'<div class="{name()}">' + "".join(f"<div><h3><a href=x>{t[:20]}</a></h3><p>{t}</p></div>" for t in teaser) + "</div>"
        if k % 5 == 4:  # no part holds the article: menus and a stray line before and after it
            lines = lambda n: "".join(f"<p><a href=x>{say(2)}</a></p>" for _ in range(n))
            pages.append((f"<html><body>{lines(4)}<p>{say(4)}</p>{lines(9)}<h1>{head}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}{lines(9)}<p>{say(4)}</p>{lines(4)}</body></html>", " ".join([head, *paragraphs])))
            continue
        before, after = (side, "") if k % 3 == 0 else ("", side)
        pages.append((f'<html><body><div class="{name()}">{menu}</div>{before}<{holder}>{inner}</{holder.split()[0]}>{after}<div class="{name()}">{say(6)} <a href=x>{say(2)}</a></div></body></html>', " ".join([head, *paragraphs])))
    return pages


def agreement(found):
    """Precision and recall of words over pages."""
    from collections import Counter

    hit = sum(sum((Counter(got.split()) & Counter(want.split())).values()) for got, want in found)
    return hit / max(1, sum(len(got.split()) for got, _ in found)), hit / sum(len(want.split()) for _, want in found)


def test_what_scan_and_labels_are_worth(monkeypatch):
    """Without class names: the scan alone removed, and the labels of marked pages alone removed, each change texts."""
    pages = random_pages()
    rows = []
    for page, _ in pages[:30]:
        seq = H.tokens(page)
        if (got := H._marked(seq)) is not None:
            rows += H.examples(seq, got[1], got[0])
    learnt, prior = H.fit(rows), H.fit([])
    test = pages[30:]
    whole = [(H.extract(p, learnt), want) for p, want in test]
    precision, recall = agreement(whole)
    print("random class words: precision", precision, "recall", recall)
    assert precision > 0.9 and recall > 0.97
    without_labels = [(H.extract(p, prior), want) for p, want in test]
    monkeypatch.setattr(H, "region", lambda scores: (0, len(scores)))
    without_scan = [(H.extract(p, learnt), want) for p, want in test]
    changed = [sum(a != b for (a, _), (b, _) in zip(whole, other)) for other in (without_labels, without_scan)]
    print("changed without labels, scan:", changed, agreement(without_labels), agreement(without_scan))
    assert changed[1] > 0
