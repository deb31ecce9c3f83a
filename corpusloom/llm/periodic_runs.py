"""Periodic runs in texts: maximal stretches of words that repeat with a smallest period.

Each text is worked on by itself, so nothing is shuffled. Within a text:

1. A run of at least m words and two periods has each of its words in a gram of ceil(m / 2) words that occurs again in the same text
   (one period further on or back). So only stretches of words that such grams cover can hold runs, and no run reaches beyond one.
2. Of each stretch and of its reversal Ukkonen's algorithm builds the suffix tree. An Euler tour with minima over ranges answers
   lowest common ancestors, and thus longest common extensions (LCE) in both directions, in constant time.
3. The longest Lyndon word at every place, under the order of the words and under the opposite order, is a candidate for a root;
   every run has such a root. Candidates are extended in both directions by LCE and kept if they span two periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mix64

YIELD_CHARS = 2_000_000  # of text in one batch of results
BLOCK = 16  # places a block of the range minima


class SuffixTree:
    """Ukkonen's suffix tree of numbers >= 1, closed by a 0 that occurs nowhere else; memory is linear in their count."""

    def __init__(self, numbers: list[int]):
        s = [*numbers, 0]
        n, width = len(s), max(s) + 1
        start, end, link = [0], [0], [0]
        edge: dict[int, int] = {}  # node * width + first number of the edge
        node = first = length = waiting = 0
        for i, c in enumerate(s):
            inner = 0  # the inner node made last, which still lacks its suffix link
            waiting += 1
            while waiting:
                if not length:
                    first = i
                key = node * width + s[first]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    at = start[child]
                    span = min(end[child], i + 1) - at
                    if length >= span:  # walk down
                        first += span
                        length -= span
                        node = child
                        continue
                    if s[at + length] == c:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    made = len(start)
                    start += [at, i]
                    end += [at + length, n]
                    link += [0, 0]
                    edge[key] = made
                    edge[made * width + c] = made + 1
                    start[child] = at + length
                    edge[made * width + s[at + length]] = child
                    if inner:
                        link[inner] = made
                    inner = made
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = i - waiting + 1
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        self.child = np.fromiter(edge.values(), np.int64, len(edge))
        self.parent, self.number = np.divmod(keys, width)
        self.span = np.array(end) - np.array(start)
        self.n = n

    def tour(self, opposite: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(place of each suffix in a depth-first tour, depth at which the tour turned before each place). Children come by the order of
        their numbers, or by the opposite order; the closing 0 is first in both."""
        number = np.where(self.number == 0, 0, -self.number) if opposite else self.number
        if opposite:
            number[self.number == 0] = number.min() - 1
        order = np.lexsort((-number, self.parent))  # reversed, as a stack gives the last first
        child = self.child[order].tolist()
        bounds = np.searchsorted(self.parent[order], np.arange(len(self.span) + 1)).tolist()
        span = self.span.tolist()
        depth, turned, place = [0] * len(span), [], [0] * self.n
        stack, above = [0], [0]
        while stack:
            v, turn = stack.pop(), above.pop()
            here = turn + span[v]
            depth[v] = here
            lo, hi = bounds[v], bounds[v + 1]
            if lo == hi:
                place[self.n - here] = len(turned)
            else:
                stack += child[lo:hi]
                above += [here] * (hi - lo)
            turned.append(turn)
        return np.array(place), np.array(turned)


class RangeMinima:
    """Least value of any range in constant time: minima within blocks from both their ends, and over 2 ** k blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full((blocks, BLOCK), np.iinfo(np.int64).max)
        self.values.ravel()[: len(values)] = values
        self.to_here = np.minimum.accumulate(self.values, axis=1).ravel()
        self.from_here = np.minimum.accumulate(self.values[:, ::-1], axis=1)[:, ::-1].ravel()
        self.over = [self.values.min(axis=1)]
        while 2 ** len(self.over) <= blocks:
            last, step = self.over[-1], 2 ** (len(self.over) - 1)
            self.over.append(np.minimum(last[:-step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo..hi], both ends included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.from_here[lo], self.to_here[hi])
        inside = np.flatnonzero(a == b)
        if len(inside):
            x, y = lo[inside], hi[inside]
            least = np.full(len(inside), np.iinfo(np.int64).max)
            flat = self.values.ravel()
            for k in range(BLOCK):
                least = np.minimum(least, flat[np.minimum(x + k, y)])
            out[inside] = least
        between = np.flatnonzero(b - a > 1)
        if len(between):
            x, y = a[between] + 1, b[between]
            level = np.floor(np.log2(y - x)).astype(np.int64)
            for k in np.unique(level):
                mine = level == k
                table = self.over[k]
                out[between[mine]] = np.minimum(out[between[mine]], np.minimum(table[x[mine]], table[y[mine] - 2**k]))
        return out


def _lyndon(place: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next suffix that is smaller."""
    rank, n = place.tolist(), len(place) - 1
    out, wait = np.empty(n, np.int64), [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[wait[-1]] > r:
            wait.pop()
        out[i] = wait[-1] - i
        wait.append(i)
    return out


def runs_of(numbers: list[int], min_words: int) -> np.ndarray:
    """All runs (start, length, period) of at least min_words numbers (>= 1) and two periods; sorted, each once."""
    n = len(numbers)
    tree = SuffixTree(numbers)
    place, turned = tree.tour()
    opposite = tree.tour(opposite=True)[0]
    del tree
    place_back, turned_back = SuffixTree(numbers[::-1]).tour()
    ahead, back = RangeMinima(turned), RangeMinima(turned_back)

    def lce(minima: RangeMinima, where: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = where[i], where[j]
        return minima.least(np.minimum(x, y) + 1, np.maximum(x, y))

    found = []
    for p in (_lyndon(place), _lyndon(opposite)):
        i = np.arange(n)
        end = i + p + lce(ahead, place, i, i + p)
        begin = i - lce(back, place_back, n - i, n - i - p)
        good = (end - begin >= 2 * p) & (end - begin >= min_words)
        found.append(np.stack([begin, end - begin, p], axis=1)[good])
    found = np.concatenate(found)
    return found[np.sort(np.unique(found, axis=0, return_index=True)[1])] if len(found) > 1 else found


def _stretches(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Maximal stretches of words covered by grams that occur more than once in the text."""
    rolled = np.zeros(len(ids) - gram + 1, np.uint64)
    for j in range(gram):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - gram + 1 + j])
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return []
    again = np.zeros(len(ids) + 1, np.int64)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    at = np.unique(at)
    again[at] += 1
    np.add.at(again, at + gram, -1)
    edges = np.diff(np.concatenate([[0], (np.cumsum(again) > 0).astype(np.int8)]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def word_runs(words: list[bytes], min_words: int = 12) -> np.ndarray:
    """All runs (start, length, period) of the words, by start, then period."""
    if len(words) < max(2, min_words):
        return np.empty((0, 3), np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    found = [np.empty((0, 3), np.int64)]
    for lo, hi in _stretches(ids, -(-max(2, min_words) // 2)):
        if hi - lo >= min_words:
            numbers = (np.unique(ids[lo:hi], return_inverse=True)[1] + 1).tolist()
            found.append(runs_of(numbers, min_words) + np.array([lo, 0, 0]))
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(words: list[bytes], g: int) -> list[bytes]:
    """The words with a periodic tail: from place a = g % n on with the period 1 + floor((n - a) / (3 + g % 8))."""
    n = len(words)
    if not n:
        return words
    a = g % n
    root = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * (-(-(n - a) // len(root))))[: n - a]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _work(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids, begin, chars, found, kept = column["doc_id"], 0, 0, [], []
            for k, g in enumerate(column["tail"].to_pylist()):
                text = column["text"][k].as_py() or ""
                words = text.encode().split()  # parts at \x20 and \x09-\x0D
                if g is not None:
                    words = planted(words, g)
                runs = word_runs(words, min_words)
                if len(runs):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                    words = [w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x]
                found.append(runs)
                kept.append(b" ".join(words))
                chars += len(text) + 24 * len(runs)
                if chars > YIELD_CHARS:
                    yield _batch(ids.slice(begin, len(kept)), found, kept)
                    begin, chars, found, kept = k + 1, 0, [], []
            yield _batch(ids.slice(begin, len(kept)), found, kept)

    return run


def _batch(ids: pa.Array, found: list[np.ndarray], kept: list[bytes]) -> pa.RecordBatch:
    flat = np.concatenate([np.empty((0, 3), np.int64), *found])
    structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], names=["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, min_words: int = 12, tail: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, runs array<struct<start, length, period>> (words from 0; by start, then period) and collapsed,
    the words left, joined by one space, after each run has lost what follows its first period.

    Words are parted by \\x20 and \\x09-\\x0D. A run has a smallest period q and at least max(min_words, 2 * q) words, and no word beside it
    keeps the period. Null, empty and blank texts have no runs and an empty collapsed text; repeated rows give equal rows, a null doc_id is
    kept, other columns are ignored, and an empty table gives an empty one. A text is worked on whole in one task; memory is linear in its
    stretches of repeated grams (about 500 bytes a word). tail names a column of numbers: where it isn't null the text is given a
    periodic tail first (see planted), for measuring what is found.
    """
    rows = docs.select("doc_id", "text", (F.col(tail) if tail else F.lit(None)).cast("long").alias("tail"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_work(min_words), f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def runs_query(docs: DataFrame) -> DataFrame:
    """Digest of the runs of every document; one in ten, by a hash of its id, is given a periodic tail first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs(docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("tail_")), tail="tail_")
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
