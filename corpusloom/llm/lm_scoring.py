"""Language-model scoring with a weighted backoff automaton trained on the corpus itself.

The model. States are the empty context and every n-gram of up to order - 1 tokens seen in training. A state has an arc for
each token seen after it, and a failure arc to the state of its context without the first token. With c the training counts
and keep(n) = smoothing * n ** -decay for a context seen n times, arcs and failure arcs carry

    p(w | h) = (1 - keep(c(h))) * c(hw) / c(h) + keep(c(h)) * p(w | shorter h)        arc, when c(hw) > 0
    keep(c(h))                                                                        failure arc
    p(w) = (c(w) + 1) / (N + V + 1)                                                   arcs of the empty context

(Jelinek-Mercer smoothing whose weight depends on the context's count), so each state's probabilities sum to one over the V
known tokens and one unknown. A text is read once from left to right: the state carried is the longest known suffix of what
was read; a missing arc is replaced by failure arcs until an arc is found.

How it is distributed. The model grows with the corpus, so no task holds it. Texts are dealt to blocks of about block_bytes.
A block turns its n-grams into sorted hashes with training counts and sends each slice of the hash range as one packed row
to the bucket of that slice; a bucket adds up the counts over all blocks and returns to every block the totals of precisely
the n-grams it asked for. From these the block builds the part of the automaton that its own texts can enter, with states,
arcs and failure arcs, and walks it. An n-gram that is frequent everywhere is one entry per block, so no bucket is hot.
Nothing but two totals passes through the driver. Hashes have as many bits as keep the share of n-grams that meet another
one's hash below 2 ** -18 at the corpus's size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import corpus_size, materialize, parts_for, shuffle_partitions
from corpusloom.llm.shingles import hash_texts, mix64

SEGMENT = 512  # tokens that a lane of the walk reads
SPARE_BITS = 18
BUCKET_GRAMS = 3 << 20  # n-grams that a bucket adds up at once
START, END = mix64(np.array([1, 2], np.uint64))


def sort_places(keys: np.ndarray) -> np.ndarray:
    """np.argsort: leading bits are sorted together with the place; the few that differ further down only are put right."""
    low = max(1, int(len(keys) - 1).bit_length())
    drop = max(0, int(keys.max(initial=0)).bit_length() + low - 64)
    packed = ((keys >> np.uint64(drop)) << np.uint64(low)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    place = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    if drop:
        packed >>= np.uint64(low)
        ordered = keys[place]
        for top in np.unique(packed[1:][ordered[1:] < ordered[:-1]]):
            run = slice(*np.searchsorted(packed, [top, top + np.uint64(1)]))
            place[run] = place[run][np.argsort(ordered[run], kind="stable")]
    return place


class Packer:
    """Numbers as byte planes, compressed."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=1)

    def pack(self, values: np.ndarray) -> bytes:
        values = np.ascontiguousarray(values, np.min_scalar_type(int(values.max(initial=0))))
        return bytes([values.itemsize]) + self.compressor.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8), data[0]
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(f"u{width}").ravel()


class Block:
    """The tokens of a block of texts, each text between START and END, and the n-grams that end at each token."""

    def __init__(self, texts, order: int, bits: int):
        hashes, sizes = hash_texts(texts)
        self.order, self.bits = order, bits
        self.size = sizes + 2  # with START and END
        self.starts = np.cumsum(self.size) - self.size
        self.place = np.arange(self.size.sum()) - np.repeat(self.starts, self.size)
        token = np.empty(len(self.place), np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.starts] = inner[self.starts + self.size - 1] = False
        token[inner] = hashes
        token[self.starts], token[self.starts + self.size - 1] = START, END
        self.token = token

    def grams(self):
        """For each order from 1: the places where such an n-gram ends, and its keys, of `bits` bits, of which the last tells single tokens but START."""
        h, back = self.token, self.token
        for k in range(1, self.order + 1):
            if k > 1:
                back = np.concatenate([back[:1], back[:-1]])
                h = mix64(h * np.uint64(0x100000001B3) + mix64(back + np.uint64(k)))
            keys = (h >> np.uint64(64 - self.bits)) & np.uint64(2**64 - 2)
            if k == 1:
                keys |= (self.place > 0).astype(np.uint64)
            ends = np.flatnonzero(self.place >= k - 1)
            yield ends, keys[ends]

    def counts(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of all orders, and how often each is in the texts trained on."""
        weight = np.repeat(training.astype(np.uint64), self.size)
        both = np.concatenate([(keys << np.uint64(1)) | weight[ends] for ends, keys in self.grams()])
        both.sort()
        keys = both >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(both & np.uint64(1), first)


class Automaton:
    """The part of the automaton that the texts of a block can enter.

    Node x is an n-gram of the block, in the order of the keys: as a state if it is shorter than `order` and was seen in training, and as
    an arc to it from the state of all its tokens but the last, on the last. node[k][i] is the n-gram of k tokens that ends at place i of
    the block; that without its first token, node[k - 1][i], is where the failure arc of node[k][i] leads.
    """

    def __init__(self, block: Block, total: np.ndarray, n: int, v: int, smoothing: float, decay: float):
        parts = list(block.grams())
        keys = np.concatenate([keys for _, keys in parts])
        at = sort_places(keys)
        ordered = keys[at]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        node = np.empty(len(keys), np.int32)
        node[at] = np.cumsum(new)
        if len(total) != int(new.sum()) + 1:
            raise ValueError("totals are not those of this block")
        self.node = np.zeros((block.order + 1, len(block.token)), np.int32)
        start = 0
        for k, (ends, _) in enumerate(parts, 1):
            self.node[k, ends] = node[start : start + len(ends)]
            start += len(ends)
        self.block, self.total = block, total
        keep = smoothing * np.maximum(total, 1.0) ** -decay
        self.failure = np.log10(keep)
        prob = (total + 1.0) / (n + v + 1.0)
        self.base = np.log10(prob)
        for k in range(2, block.order + 1):
            ends = parts[k - 1][0]
            arc, state, shorter = self.node[k, ends], self.node[k - 1, ends - 1], self.node[k - 1, ends]
            c = total[state]
            prob[arc] = np.where(c > 0, (1 - keep[state]) * total[arc] / np.maximum(c, 1.0) + keep[state] * prob[shorter], prob[shorter])
        self.arc = np.log10(prob)

    def walk(self) -> np.ndarray:
        """log10 of each text's probability. Texts are read in segments, all in lockstep, each lane carrying its state, which is told by the length of
        its context. A state depends on the order - 1 tokens read last, so a lane first reads these without counting them."""
        block, order = self.block, self.block.order
        cuts = -(-(block.size - 1) // SEGMENT)
        owner = np.repeat(np.arange(len(cuts)), cuts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = block.starts[owner] + 1 + SEGMENT * part
        length = np.minimum(block.starts[owner] + block.size[owner] - begin, SEGMENT)
        lanes = np.argsort(-length, kind="stable")
        owner, begin, length, part = owner[lanes], begin[lanes], length[lanes], part[lanes]
        open_lanes = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
        seen = self.total[self.node] > 0  # orders x places; where an n-gram would reach before START it isn't asked for
        state = np.where((part == 0) & seen[1, begin - 1], min(1, order - 1), 0)  # START has been read
        score = np.zeros(len(begin))
        for step in range(1 - order, SEGMENT):
            n = open_lanes[max(step, 0)]
            if not n:
                break
            i, s, logp = begin[:n] + step, state[:n], np.zeros(n)
            here = (part[:n] > 0) if step < 0 else np.ones(n, bool)
            i = np.where(here, i, begin[:n])
            for k in range(order - 1, 0, -1):
                fail = here & (s == k) & ~seen[k + 1, i]
                logp[fail] += self.failure[self.node[k, i[fail] - 1]]
                s[fail] -= 1
            if step >= 0:
                score[:n] += logp + self.arc[self.node[s + 1, i]]
            s[here] = np.minimum(s + seen[s + 1, i], order - 1)[here]
        return np.bincount(owner, weights=score, minlength=len(block.size))


def _ask(order: int, bits: int, buckets: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = Block(pdf["text"], order, bits).counts(~pdf["held_out"].to_numpy(bool))
        bounds = [(b << bits) // buckets & ~1 for b in range(buckets)]  # even, so that differences keep the mark of single tokens
        edges = [*np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)]
        packer, rows = Packer(), []
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if hi > lo:
                rows.append((key[0], b, packer.pack(np.diff(keys[lo:hi], prepend=np.uint64(bounds[b]))), packer.pack(counts[lo:hi])))
        return pd.DataFrame(rows, columns=["block", "bucket", "grams", "counts"])

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Training totals of one slice of the n-grams, over all blocks."""
    grams = [np.cumsum(unpack(g), dtype=np.uint64) for g in pdf["grams"]]
    sizes = np.array([len(g) for g in grams])
    keys = np.concatenate(grams)
    single = (keys & np.uint64(1)) > 0
    at = sort_places(keys)
    ordered = keys[at]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.concatenate([unpack(c).astype(np.uint64) for c in pdf["counts"]])
    sums = np.add.reduceat(counts[at], first)
    total = np.empty(len(keys), np.uint64)
    total[at] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    words = sums[single[at[first]]]
    packer, ends = Packer(), np.cumsum(sizes)
    out = pdf[["block", "bucket"]].copy()
    out["totals"] = [packer.pack(total[e - s : e]) for e, s in zip(ends, sizes, strict=True)]
    lead = np.arange(len(out)) == 0
    out["known"], out["tokens"] = np.where(lead, int((words > 0).sum()), 0), np.where(lead, int(words.sum()), 0)
    return out


def _score(order: int, bits: int, n: int, v: int, smoothing: float, decay: float):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return pd.DataFrame(columns=names)
        total = np.concatenate([unpack(t).astype(np.float64) for t in answers.sort_values("bucket")["totals"]])
        block = Block(docs["text"], order, bits)
        model = Automaton(block, total, n, v, smoothing, decay)
        word = model.node[1]
        tokens = block.place > 0
        add = lambda x: np.add.reduceat(np.where(tokens, x, 0), block.starts)
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].array,
                "held_out": docs["held_out"].array,
                "n_tokens": block.size - 1,
                "n_known": add((total[word] > 0).astype(np.int64)),
                "train_tokens": n,
                "base_score": add(model.base[word]),
                "score": model.walk(),
            }
        )

    return run


def score_texts(docs: DataFrame, *, order: int = 3, smoothing: float = 0.9, decay: float = 0.1, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows where held_out is false. Null and empty texts are one END token. Repeated rows count each time and
    are each returned; null ids are no document's. Ids of any integer type come back as they are. An empty table gives an
    empty result. Other columns are ignored. block_bytes sizes the unit of work; it doesn't change scores.
    """
    own = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out")  # a long column with nulls would become doubles in pandas
    spark = docs.sparkSession
    rows, size = corpus_size(docs)
    blocks = parts_for(spark, size, block_bytes)
    grams = order * (size // 4 + 2 * rows + 1)
    bits = min(62, math.ceil(math.log2(grams)) + SPARE_BITS)
    buckets = max(shuffle_partitions(spark), math.ceil(grams / BUCKET_GRAMS))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    asked = dealt.groupBy("block").applyInPandas(_ask(order, bits, buckets), "block int, bucket int, grams binary, counts binary")
    totals = asked.groupBy("bucket").applyInPandas(_total, "block int, bucket int, totals binary, known long, tokens long")
    totals = materialize(totals, "ngram-totals")
    n, v = (int(x) for x in totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first())
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = totals.select("block", "bucket", "totals").repartitionById(blocks, F.col("block"))
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(order, bits, n, v, smoothing, decay), schema)
    return scored.withColumn("doc_id", F.col("doc_id").cast(own))
