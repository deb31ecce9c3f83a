"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its inner s-mers stands at its first or last place. That
depends on the k-mer alone, not on its neighbours, so an edit elsewhere never changes which k-mers of an untouched passage
are chosen; and among neighbouring k-mers one is always chosen within k - s places. The chosen k-mers, with their places, are
the anchors of a text. Its fingerprint has all of them, in the order of their places, so it grows with the text. Two fingerprints
are matched by place: what counts is the longest run of common anchors that stand in the same order in both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import corpus_size, parts_for
from corpusloom.llm.shingles import mix64

K, S = 16, 5
YIELD_CHARS = 4_000_000  # of fingerprints in one frame
MOST_RANGES = 20_000  # of ids; what the driver knows is one row a range. A range is read in order, so its size is no matter of memory


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers; a text shorter than k is one anchor at place 0; none for an empty one."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = min(k, n)
    s = min(s, k)
    power = np.uint64(0x9E3779B97F4A7C15)

    def rolled(width: int) -> np.ndarray:
        h = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            h *= power
            h += cp[j : n - width + 1 + j]
        return mix64(h)

    inner = rolled(s)
    span = k - s + 1  # inner places in a k-mer
    least, have = inner, 1
    while have < span:  # minimum over windows, by doubling
        add = min(have, span - have)
        least = np.minimum(least[: len(least) - add], least[add:])
        have += add
    m = n - k + 1
    places = np.flatnonzero((inner[:m] == least) | (inner[span - 1 : span - 1 + m] == least))
    codes = np.full(len(places), k, np.uint64)
    for j in range(k):
        codes *= power
        codes += cp[places + j]
    return places, mix64(codes)


def fingerprint(text: str) -> str:
    """12 hex digits an anchor, in the order of places: 10 of the hash, 2 of the distance from the anchor before (of the first, from
    the start; it is k - s at most). Empty for an empty text."""
    places, hashes = closed_syncmers(text)
    out = np.empty((len(places), 6), np.uint8)
    out[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5] = np.diff(places, prepend=0)
    return out.tobytes().hex()


def anchors(mark: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of 40 bits) of a fingerprint."""
    raw = np.frombuffer(bytes.fromhex(mark), np.uint8).reshape(-1, 6)
    hashes = np.zeros((len(raw), 8), np.uint8)
    hashes[:, 3:] = raw[:, :5]
    return np.cumsum(raw[:, 5], dtype=np.int64), hashes.view(">u8").ravel().astype(np.int64)


def in_order(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence: exact, repeated values too."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    x, y = x[np.isin(x, y)].tolist(), y[np.isin(y, x)].tolist()
    if not x or not y:
        return head + tail
    times = Counter(x)
    where: dict[int, list[int]] = {}
    if sum(times[v] for v in y) <= max(len(x), len(x) * len(y) // 256):  # few pairs: an increasing subsequence of their places
        for i in range(len(x) - 1, -1, -1):
            where.setdefault(x[i], []).append(i)
        ends: list[int] = []
        for v in y:
            for i in where[v]:
                if not ends or i > ends[-1]:
                    ends.append(i)
                else:
                    ends[bisect_left(ends, i)] = i
        return head + tail + len(ends)
    masks: dict[int, int] = {}  # many: a row of the table in one number, bit by bit
    for v in times:
        where[v] = []
    for i, v in enumerate(x):
        where[v].append(i)
    for v, at in where.items():
        bits = np.zeros(at[-1] + 1, np.uint8)
        bits[at] = 1
        masks[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(x)) - 1
    row = full
    for v in y:
        hit = row & masks[v]
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(x) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """Share of the anchors of both that are matched in order (matched / (anchors of a + anchors of b - matched)); 1 for two empty fingerprints, 0 if one is."""
    if a == b:
        return 1.0
    both = in_order(anchors(a)[1], anchors(b)[1])
    return both / (len(a) // 12 + len(b) // 12 - both)


def _ranges(ids: DataFrame, parts: int) -> list[int]:
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    return sorted(set(cuts or []))


def fingerprint_documents(docs: DataFrame, *, range_bytes: int = 12 << 20) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's,
    by ascending doc_id (null first; equal ids by text), after the last the first; of a single document that is itself. A null
    text counts as empty.

    Ids are cut into ranges of about equal counts, MOST_RANGES at most. A document goes to its range and, if it is the first of one, also to the
    range before, so every range can find the next of each of its documents; a range is read in order, holding two texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count, size = corpus_size(rows)
    cuts = _ranges(rows.select("doc_id"), min(parts_for(spark, size, range_bytes), max(1, count), MOST_RANGES))
    shared = spark.sparkContext.broadcast(np.array(cuts, np.float64))  # one number a range

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, ids.fillna(-np.inf).to_numpy(np.float64), side="right")
        return pd.Series(at).astype("int32")

    ranged = rows.withColumn("range", range_of("doc_id"))
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id"), F.sha2("text", 256).alias("key"))).alias("first")).collect()}
    order = sorted(firsts)
    before = {order[i]: order[i - 1] for i in range(len(order))}  # of the first range: the last
    if not order:
        return spark.createDataFrame([], OUT.replace("doc_id string", "doc_id long"))
    heads = spark.createDataFrame([(r, before[r], firsts[r]["doc_id"], firsts[r]["key"]) for r in order], "range int, before int, first_id long, first_key string")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.sha2("text", 256) == F.col("first_key"))
    both = ranged.join(F.broadcast(heads), "range").withColumn("to", F.when(is_first, F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")))))
    sent = both.select("doc_id", "text", F.inline("to"))
    walked = sent.repartitionById(max(order) + 1, F.col("range")).sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), F.sha2("text", 256))
    walked = walked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_walk, OUT)  # pandas would make doubles of longs with nulls
    return walked.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


OUT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by range, in each the own documents in order, then the first of the next range (more than once if rows repeat)."""
    held: tuple | None = None  # range, doc_id, text, fingerprint of the document that waits for its next

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for pdf in batches:
        out, chars = [], 0
        for rng, extra, doc_id, text in zip(pdf["range"], pdf["extra"], pdf["doc_id"], pdf["text"], strict=True):
            if extra and (held is None or held[0] != rng):
                continue  # a repeated row of the next range's first
            mark = fingerprint(text)
            if held is not None and held[0] == rng:
                _, own_id, own, own_mark = held
                take = len(own) // 4
                edited = own[: len(own) - take] + text[:take]
                edited_mark = fingerprint(edited)
                out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                chars += len(own_mark) + len(edited_mark)
                if chars > YIELD_CHARS:
                    yield frame(out)
                    out, chars = [], 0
            held = None if extra else (rng, doc_id, text, mark)
        yield frame(out)
