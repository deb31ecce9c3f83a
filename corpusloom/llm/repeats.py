"""Passages that occur more than once in a corpus, found by seed and extend, and the texts without them.

1. Seeds. Of the grams of `gram` words in each window of `window` words the least hash (the last of equal ones) is the window's anchor, so
   equal windows have equal anchors at equal places (winnowing). Neighbouring windows with one anchor form a cell: the anchor, and the
   stretch of words that its windows cover.
2. Join. Cells are joined on their anchors' hashes with the anchors that occur more than once; all other cells go.
3. Extend. A cell whose whole stretch, left and right of the anchor, occurs again at an equal anchor is repeated in all its windows. Where an
   anchor has stretches that differ, each of them is extended from the anchor to the left by a words and to the right by the rest of
   the window, for every a; an extension that two stretches share is a repeat. So no pair of occurrences is ever made: a passage in
   thousands of documents costs a row an occurrence.
4. Repeated windows that follow each other are merged into maximal repeats, which then are cut out.

A stretch is known by two 64-bit hashes, of its anchor and of all its words, and a text by two as well. Texts that are equal are worked on once, and each is shuffled once: it is
stored in buckets of its key, to which all that is found about it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bucketed, materialize, shuffle_partitions
from corpusloom.llm.shingles import GOLDEN, PIECE, mix64, word_hashes

YIELD_CHARS = 2_000_000  # of text in one batch of results
KEY = ["t1", "t2"]  # of a text
CELLS = "h long, c long, t1 long, t2 long, first int, n int"
EXTENSIONS = "h long, a int, w long, c long, t1 long, t2 long, start int, single boolean"


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(x * GOLDEN + y)


class _Windows:
    """Of the words of some texts in a row: hashes of grams and windows, and each window's anchor."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.window, self.gram = window, gram
        words, self.size = word_hashes(texts, lower=False)
        self.begin = np.cumsum(self.size) - self.size
        self.levels = [words]  # hashes of 2 ** j words from each place on
        while 2 ** len(self.levels) <= window and len(self.levels[-1]) > 2 ** (len(self.levels) - 1):
            step = 2 ** (len(self.levels) - 1)
            self.levels.append(_pair(self.levels[-1][:-step], self.levels[-1][step:]))
        count = np.maximum(self.size - window + 1, 0)
        self.owner = np.repeat(np.arange(len(texts)), count)  # text of each window
        self.start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.begin[self.owner]

    def stretch(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of stretches of words; two overlapping ones of 2 ** j words cover each."""
        length = np.broadcast_to(np.asarray(length), begin.shape)
        out = np.empty(len(begin), np.uint64)
        level = np.minimum(np.floor(np.log2(length)).astype(np.int64), len(self.levels) - 1)
        for j in np.unique(level):
            mine, step = level == j, 2**j
            at, table = begin[mine], self.levels[j]
            least = table[at]
            for k in range(step, int(length[mine].max()), step):  # a second one as a rule, more if windows are long
                least = _pair(least, table[at + np.minimum(k, length[mine] - step)])
            out[mine] = mix64(least + length[mine].astype(np.uint64))
        return out

    def anchors(self) -> np.ndarray:
        """Place of each window's anchor."""
        grams = self.stretch(np.arange(len(self.levels[0]) - self.gram + 1), self.gram)
        least, place, have, want = grams, np.arange(len(grams)), 1, self.window - self.gram + 1
        while have < want:
            add = min(have, want - have)
            later = least[add:] <= least[:-add]
            least, place = np.where(later, least[add:], least[:-add]), np.where(later, place[add:], place[:-add])
            have += add
        self.grams = grams
        return place[self.start]

    def cells(self) -> tuple[np.ndarray, ...]:
        """(text, anchor's hash, stretch's hash, first window, windows) of each cell, windows counted in their text."""
        if not len(self.start):
            return (np.empty(0, np.int64),) * 5
        anchor = self.anchors()
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        n = np.diff(np.append(new, len(anchor)))
        first, at, owner = self.start[new], anchor[new], self.owner[new]
        c = _pair(self.stretch(first, self.window + n - 1), (at - first).astype(np.uint64))
        return owner, self.grams[at].astype(np.int64), c.astype(np.int64), first - self.begin[owner], n


def _pieces(pdf: pd.DataFrame) -> Iterator[tuple[slice, list[bytes]]]:
    """Rows with their texts in UTF-8, about PIECE bytes at a time."""
    begin, held, out = 0, 0, []
    for i, t in enumerate(pdf["text"]):
        out.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
        held += len(out[-1])
        if held >= PIECE or i == len(pdf) - 1:
            yield slice(begin, i + 1), out
            begin, held, out = i + 1, 0, []


def _cells(window: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, texts in _pieces(pdf):
                owner, h, c, first, n = _Windows(texts, window, gram).cells()
                keys = {k: pdf[k].to_numpy()[rows][owner] for k in KEY if k in pdf}
                yield pd.DataFrame({"h": h, "c": c} | (keys | {"first": first.astype(np.int32), "n": n.astype(np.int32)} if keys else {}))

    return run


def _extensions(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            begin, held, texts = 0, 0, []
            for i in range(len(batch)):
                texts.append((column["text"][i].as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= PIECE or i == len(batch) - 1:
                    yield _extended({k: c.slice(begin, len(texts)) for k, c in column.items()}, _Windows(texts, window, gram))
                    begin, held, texts = i + 1, 0, []

    return run


def _extended(column: dict[str, pa.Array], found: _Windows) -> pa.RecordBatch:
    """All windows of the open cells of some texts, each as an extension of its anchor."""
    cells = column["cells"].flatten()
    first, n, single = (pc.cast(cells.field(k), pa.int64()).to_numpy() for k in ("first", "n", "single"))
    owner = np.repeat(np.arange(len(found.size)), column["cells"].value_lengths().to_numpy())
    owner_cells, h, c, first_of, _ = found.cells()
    where = np.searchsorted(owner_cells * 2**32 + first_of, owner * 2**32 + first)  # cells come in this order
    of = np.repeat(np.arange(len(first)), n)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    place = start + found.begin[owner[of]]
    a = found.anchors()[np.searchsorted(found.start, place)] - place
    keys = [column[k].to_numpy()[owner[of]] for k in KEY]
    data = [h[where][of], a.astype(np.int32), found.stretch(place, found.window).astype(np.int64), c[where][of], *keys, start.astype(np.int32), single[of] > 0]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=[x.split()[0] for x in EXTENSIONS.split(", ")])


def text_key(column: str = "text") -> list[Column]:
    """Two independent hashes that stand for a text."""
    return [F.xxhash64(column).alias("t1"), F.xxhash64(F.lit(17), F.col(column)).alias("t2")]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, text, copies): each text once, in buckets of its key, so that what is found about texts is joined to them without shuffling them again."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    once = rows.select(*text_key(), "text").groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return bucketed(once, "texts", KEY, shuffle_partitions(spark))


def repeated_windows(once: DataFrame, *, window: int = 35, gram: int = 8) -> DataFrame:
    """Per text (t1, t2) of distinct texts that holds windows which other texts hold too, or which it holds twice: found array<struct<start, n>>, n such windows
    from word start on."""
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    texts = once.filter(F.length("text") >= 2 * window - 1).select("text", *KEY)
    anchors = texts.select("text").mapInPandas(_cells(window, gram), "h long, c long")
    shared = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("times > 1")
    shared = materialize(shared.select("h", (F.col("lo") != F.col("hi")).alias("differ")), "anchors")
    met = materialize(texts.mapInPandas(_cells(window, gram), CELLS).join(shared, "h"), "met")
    cell = F.struct("t1", "t2", "first", "n")
    stretches = materialize(met.filter("differ").groupBy("h", "c").agg((F.count(F.lit(1)) == 1).alias("single"), F.min(cell).alias("at")), "stretches")
    whole = met.filter("differ").join(stretches.filter("not single").select("h", "c"), ["h", "c"], "left_semi")
    spans = met.filter("not differ").union(whole).select(*KEY, F.col("first").alias("start"), "n")

    opened = stretches.groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(F.collect_list(F.struct("at.first", "at.n", "single")).alias("cells"))  # no more than a text has
    extended = materialize(texts.join(opened, KEY).mapInArrow(_extensions(window, gram), EXTENSIONS), "extensions")
    again = extended.groupBy("h", "a", "w").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h", "a", "w")
    ends = extended.filter("single").join(again, ["h", "a", "w"], "left_semi").select(*KEY, "start", F.lit(1).alias("n"))
    return spans.union(ends).groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("found"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            begin, chars, removed, total, kept, spans = 0, 0, [], [], [], []

            def out(begin=begin, column=column):
                lists = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                return pa.RecordBatch.from_arrays([*(column[k].slice(begin, len(kept)) for k in KEY), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=[*KEY, "n_words", "n_removed", "repeats", "kept_text"])

            for k in range(len(batch)):
                text = column["text"][k].as_py() or ""
                words = text.encode().split()  # parts at \x20 and \x09-\x0D
                total.append(len(words))
                found, start, n, merged = column["found"][k].values, np.empty(0, np.int64), np.empty(0, np.int64), []
                if column["copies"][k].as_py() > 1 and len(words) >= window:  # all windows of a text that stands twice
                    start, n = np.array([0]), np.array([len(words) - window + 1])
                elif found is not None and len(found):
                    start, n = (found.field(i).to_numpy().astype(np.int64) for i in range(2))
                if len(start):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n, -1)
                    windows = np.diff(np.concatenate([[0], np.cumsum(change) > 0, [0]]).astype(np.int8))  # maximal runs of repeated windows
                    lo, hi = np.flatnonzero(windows == 1), np.flatnonzero(windows == -1) + window - 1
                    merged = [{"start": a, "length": b - a} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi, -1)
                    words = [w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x]
                removed.append(total[-1] - len(words))
                spans.append(merged)
                kept.append(b" ".join(words))
                chars += len(text)
                if chars > YIELD_CHARS:
                    yield out(begin)
                    begin, chars, removed, total, kept, spans = k + 1, 0, [], [], [], []
            yield out(begin)

    return run


def remove_repeats(docs: DataFrame, *, window: int = 35, gram: int = 8, kept: Column | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, repeats array<struct<start, length>> (the maximal repeats: words from 0) and
    kept_text, the words outside them joined by one space. kept: a column made of kept_text that is wanted instead of it, such as a hash.

    A word goes if a window of `window` consecutive words that covers it also starts anywhere else in the corpus, the same text included;
    all is judged on the input. Words are parted by \\x20 and \\x09-\\x0D and not changed. Null, empty and blank texts have no words and an empty
    kept_text. Two rows are two texts, also when they are equal or have one doc_id: repeated rows of `window` words or more lose all words. A null doc_id is
    kept, other columns are ignored, whatever their names, and an empty table gives an empty one. A text of any length is worked on whole; memory is linear in it.
    """
    once = distinct_texts(docs)
    found = once.join(repeated_windows(once, window=window, gram=gram), KEY, "left").select(*KEY, "text", "copies", "found")
    cut = found.mapInArrow(_cut(window), "t1 long, t2 long, n_words long, n_removed long, repeats array<struct<start:long,length:long>>, kept_text string")
    cut = cut.select(*KEY, "n_words", "n_removed", "repeats", F.col("kept_text") if kept is None else kept)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *text_key())
    return rows.join(cut, KEY).drop(*KEY)
