"""Language identification tells languages of one script apart, whatever the script."""

import random

import pytest

from rasterloom.llm import lang_id

SCRIPTS = {
    "cyrillic": (["что", "это", "было", "когда", "человек", "который", "ещё", "время"], ["було", "який", "їхній", "людина", "ще", "коли", "цього", "є"]),
    "devanagari": (["है", "नहीं", "और", "लेकिन", "किताब", "मैंने"], ["आहे", "नाही", "आणि", "पण", "पुस्तक", "मला"]),
    "beyond the BMP": (["".join(chr(0x1E922 + k) for k in w) for w in ((0, 1, 2), (3, 4, 5), (1, 3))], ["".join(chr(0x1E922 + k) for k in w) for w in ((9, 8, 7), (6, 12, 11), (8, 10))]),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_one_script(spark, script):
    draw = random.Random(4)
    a, b = SCRIPTS[script]
    say = lambda words: " ".join(draw.choice(words) for _ in range(30))
    table = [(k, say(a if k % 2 else b), "a" if k % 2 else "b") for k in range(120)]
    block = sorted({c for w in a + b for c in w})
    noise = [(200 + k, " ".join("".join(draw.choice(block) for _ in range(5)) for _ in range(30)), None) for k in range(10)]
    df = spark.createDataFrame(table + noise, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.score(df, lang_id.train(df.where("doc_id < 80"))).collect()}
    assert all(got[k].lang_pred == lang and got[k].accepted for k, _, lang in table)
    assert not any(got[k].accepted for k, _, _ in noise)


def test_symbols():
    """Letters keep apart, marks belong to words, signs don't; texts of marks alone have no letters."""
    import numpy as np

    letters = np.array([ord(c) for c in "абвकि"])
    table = lang_id.symbol_table(letters)
    assert [int(table[c]) for c in letters] == [1, 2, 3, 4, 5] and table[ord(" ")] == table[0xFE0F] == 0 and table[ord("z")] == lang_id._OTHER
    assert lang_id.grams(["कि", "ि", "❤️"], table)[2].tolist() == [True, False, False]
