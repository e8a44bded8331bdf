"""Fill-in-the-middle transformation by a streaming matcher in two passes.

The first pass counts a text's units; the two cut ranks follow from the document's digest and that count; the second pass
advances a lazy match iterator to the first rank and on to the second. One match is held at a time, never an array of
units, so a text of any length costs the text itself and what is put out. Documents are independent: no shuffle.

Defined results: null text is empty; a null doc_id has the digest of ``<seed>:``; repeated rows each get a row; an empty
table gives an empty result; other columns are ignored. A text that holds one of the markers stays plain, so a
marker of the output always is one of its own, and ``restored`` is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Units (white space and the word that follows it, or white space at the end) and the three markers.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def cut_places(text: str, first: int, second: int) -> tuple[int, int]:
    """Where ``first`` and ``second`` units end (first <= second); one iterator is advanced to both."""
    matches, places = UNIT.finditer(text), [0]
    for units in (first, second - first):
        last = deque(islice(matches, units), maxlen=1)
        places.append(last[0].end() if last else places[-1])
    return places[1], places[2]


def transformed(text: str, doc_id: object, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    n = count_units(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = cut_places(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output. ``rate`` of 100 documents are cut; of
    those ``spm`` of 100 put the suffix first."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):  # outputs of a few texts at a time
                part = batch.slice(at, 64)
                rows = [transformed(t.as_py(), i.as_py(), seed, rate, spm) for i, t in zip(part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT))], ["doc_id", *RESULT.names])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    parts = F.split(output, "<[PSM]>", -1)  # what stands before the first marker is empty
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
