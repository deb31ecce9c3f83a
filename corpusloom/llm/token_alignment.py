"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the token pairs that it links.

Both tokenizers' tokens are laid over the bytes of a text. Each token start finds the other side's covering token by an as-of merge; the union of both
directions is the set of overlapping tokens, and where two of them end at one byte, a group ends. Tokens of one group are linked.

No token of a byte-level BPE goes on from other characters into white space, and of a piece vocabulary only those do that end a word with a
known few characters (as a carriage return). So a text is cut before each stretch of white space that follows other characters and doesn't
begin with one of these few; likewise between a word of A-Z and a sign such as a comma, where no token has both. Each distinct piece of a batch of documents is encoded and merged once, keyed by the piece, and documents are put together from
pieces. Where a space is among the few, whole texts are the pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize, small

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SLICE_CHARS = 1_000_000  # of text worked on at once
MOST_PIECES = 200_000  # kept from slice to slice
ENCODED_AT_ONCE = 4096  # pieces; what the tokenizer says of each is large
#: Unicode white space, as both tokenizers see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
JOINED = re.compile(f"[^{SPACE}]([{SPACE}])")


def piece_pattern(joined: set[str], signs: str = "") -> re.Pattern | None:
    """Pieces of a text, cut before white space that follows other characters and isn't of `joined`, and, after a first word of A-Z and a-z, before one of `signs`;
    None if a space is of joined."""
    if " " in joined:
        return None
    on = f"(?:[{re.escape(''.join(sorted(joined)))}][{SPACE}]*[^{SPACE}]*)*" if joined else ""
    word = f"[{SPACE}]*[A-Za-z]++(?=[{re.escape(signs)}])|" if signs else ""
    return re.compile(f"{word}[{SPACE}]*[^{SPACE}]+{on}|[{SPACE}]+")


#: How a byte-level BPE with its usual pre-tokenizer splits texts before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """A byte-level BPE from a tokenizers JSON file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        letters = _byte_letters()
        self.bytes = [b""] * self.model.get_vocab_size(with_added_tokens=True)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        split = json.loads(self.model.to_str())
        self.quick = self._ranked(split["model"]["merges"])
        self.parts = split.get("normalizer") is None and (split.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and split["pre_tokenizer"].get("use_regex", True)

    def _ranked(self, merges: list) -> tiktoken.Encoding | None:
        """An encoder that takes ids for ranks of merges, several times as quick: the same if the file's merges make ids in ascending order."""
        ids = {b: i for i, b in enumerate(self.bytes)}
        letters = _byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [ids.get(bytes(letters[c] for c in "".join(pair))) for pair in pairs]
        if None in made or any(b <= a for a, b in zip(made, made[1:], strict=False)) or sorted(b for b, i in ids.items() if i < 256) != sorted(bytes([x]) for x in range(256)):
            return None
        ranks = {self.bytes[i]: i for i in [*range(256), *made]}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        if self.quick:
            return list(map(self.quick.encode_ordinary, pieces))
        batches = (self.model.encode_batch_fast(pieces[i : i + ENCODED_AT_ONCE], add_special_tokens=False) for i in range(0, len(pieces), ENCODED_AT_ONCE))
        return [e.ids for batch in batches for e in batch]


class PieceTokens:
    """A SentencePiece BPE; it puts a space before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]
        self.lead = self.model.encode("x")
        self.signs = "".join(c for c in ",.;:!?" if not any(re.search(rb"[A-Za-z]" + re.escape(c.encode()), b) for b in self.bytes))
        self.joined = {c for b in self.bytes for c in JOINED.findall(b.decode("utf-8", "ignore"))} if len(self.lead) == 1 else {" "}

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Of pieces; a lead that no token crosses takes the space that the model adds, where the piece doesn't begin with just one."""
        out: list[list[int]] = [[]] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:2] not in ("", " ")]
        other = [i for i, p in enumerate(pieces) if not (p[0] == " " and p[1:2] not in ("", " "))]
        for i, ids in zip(plain, self.model.encode([pieces[i][1:] for i in plain], num_threads=1), strict=True):
            out[i] = ids
        for i, ids in zip(other, self.model.encode(["x" + pieces[i] for i in other], num_threads=1), strict=True):
            out[i] = ids[1:] if ids[:1] == self.lead else []
        return out

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with a space."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@cache
def _tokenizers(byte_bpe: str, piece_bpe: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(byte_bpe), PieceTokens(piece_bpe)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Tokens a and b (piece, start, end, token: a number of its own; sorted by start, of which no two pieces share any) to overlapping ones: token_a,
    token_b, end_a, end_b."""
    a, b = (x.rename(columns={"end": f"end_{s}", "token": f"token_{s}"}) for x, s in ((a, "a"), (b, "b")))
    of_a = pd.merge_asof(a, b, on="start", by="piece")
    of_b = pd.merge_asof(b, a.assign(start_a=a["start"]), on="start", by="piece")
    of_b = of_b[of_b["start"] != of_b["start_a"]]  # tokens that start together are met already
    return pd.concat([x[["token_a", "token_b", "end_a", "end_b"]] for x in (of_a, of_b)])


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of each distinct id of a group."""
    key, times = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each range, one range after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


class Aligned:
    """What is known of distinct pieces: tokens, groups and links of each."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.a, self.b = _tokenizers(byte_bpe, piece_bpe)
        self.parts = piece_pattern(self.b.joined, self.b.signs) if self.a.parts else None
        self.lengths = [np.array(list(map(len, v.bytes)), np.int64) for v in (self.a, self.b)]
        plain = list(map(str, range(max(len(self.a.bytes), len(self.b.bytes)))))
        self.written = np.array([x + end for end in ",|;\n" for x in plain], object)  # an id and the sign behind it
        self.known = len(plain)
        self.of: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.of.clear()
        self.good = np.empty(0, bool)
        self.sizes = np.empty((0, 4), np.int64)  # tokens of a, of b, groups, links
        self.shown: list[str] = []
        self.links = np.empty(0, np.int64)  # how many links a piece has in code and times
        self.code = np.empty(0, np.int64)  # a << 32 | b of each link
        self.times = np.empty(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, tokens = [self.a.encode(pieces), self.b.encode(pieces) if self.parts else self.b.encode_whole(pieces)], []
        good = np.ones(len(pieces), bool)
        for k, v in enumerate((self.a, self.b)):
            count = np.fromiter(map(len, ids[k]), np.int64, len(raw))
            flat = np.fromiter(chain.from_iterable(ids[k]), np.int64, count.sum())
            bounds = np.concatenate([[0], np.cumsum(self.lengths[k][flat])])[np.concatenate([[0], np.cumsum(count)])]
            if (np.diff(bounds) != length).any() or b"".join(map(v.bytes.__getitem__, flat.tolist())) != b"".join(raw):
                good &= np.fromiter((b"".join(map(v.bytes.__getitem__, x)) == r for x, r in zip(ids[k], raw, strict=True)), bool, len(raw))
            tokens.append((flat, count))
        base = np.cumsum(np.where(good, length, 0))  # end of each good piece; the others are left out
        sides = []
        for (flat, count), lengths in zip(tokens, self.lengths, strict=True):
            keep = np.repeat(good, count)
            flat, piece = flat[keep], np.repeat(np.arange(len(raw)), count)[keep]
            end = np.cumsum(lengths[flat])
            sides.append((flat, pd.DataFrame({"piece": piece, "start": end - lengths[flat], "end": end, "token": np.arange(len(flat))})))
        (ids_a, a), (ids_b, b) = sides
        both = overlaps(a, b)
        ends = np.unique(both.loc[both["end_a"] == both["end_b"], "end_a"].to_numpy(np.int64))
        group_a, group_b = (np.searchsorted(ends, x["end"].to_numpy()) for x in (a, b))
        which = np.flatnonzero(good)
        piece_of = which[np.searchsorted(base[which], ends)] if len(ends) else ends
        per_a, per_b = (np.bincount(g, minlength=len(ends)) for g in (group_a, group_b))
        # links of a group: each distinct id of a with each of b
        ga, xa, na = _counted(group_a, ids_a)
        gb, xb, nb = _counted(group_b, ids_b)
        many = np.bincount(gb, minlength=len(ends))
        left = np.repeat(np.arange(len(ga)), many[ga])
        right = _ranges((np.cumsum(many) - many)[ga], many[ga])
        sums = [np.bincount(piece_of, w, len(raw)).astype(np.int64) for w in (per_a, per_b, np.ones(len(ends)), per_a * per_b)]
        # groups as text: the tokens of a and of b of each group in order, each with the sign behind it
        order = np.lexsort((np.concatenate([np.zeros(len(ids_a)), np.ones(len(ids_b))]), np.concatenate([group_a, group_b])))
        sign = np.zeros(len(order), np.int64)
        last = np.cumsum(per_a + per_b) - 1
        sign[last - per_b] = 1
        sign[last] = 2
        if len(ends):
            sign[last[np.append(np.diff(piece_of) != 0, True)]] = 3
        text = "".join(self.written[sign * self.known + np.concatenate([ids_a, ids_b])[order]].tolist()).split("\n")
        shown = [""] * len(raw)
        for i, x in zip(which.tolist(), text, strict=False):
            shown[i] = x
        self.of.update(zip(pieces, range(len(self.good), len(self.good) + len(raw)), strict=True))
        self.shown += shown
        self.good = np.concatenate([self.good, good])
        self.sizes = np.concatenate([self.sizes, np.stack(sums, axis=1)])
        self.links = np.concatenate([self.links, np.bincount(piece_of[ga[left]], minlength=len(raw))])
        self.code = np.concatenate([self.code, xa[left] << 32 | xb[right]])
        self.times = np.concatenate([self.times, na[left] * nb[right]])

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links a text), groups as text, and of all texts: owner, pair, times."""
        if len(self.of) > MOST_PIECES:
            self.clear()
        cut = [(self.parts.findall(" " + t) if self.parts else [" " + t]) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)) - self.of.keys()
        if new:
            self.learn(list(new))
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(self.of.__getitem__, chain.from_iterable(cut)), np.int64, count.sum())
        owner = np.repeat(np.arange(len(texts)), count)
        whole = np.bincount(owner, ~self.good[flat], len(texts)) == 0
        ends = np.cumsum(count).tolist()
        names = list(map(self.shown.__getitem__, flat.tolist()))
        shown = [";".join(names[e - n : e]) if w else "" for e, n, w in zip(ends, count.tolist(), whole.tolist(), strict=True)]
        keep = whole[owner]
        owner, flat, times = _counted(owner[keep], flat[keep])
        sizes = np.stack([np.bincount(owner, self.sizes[flat, k] * times, len(texts)).astype(np.int64) for k in range(4)], axis=1)
        rep = self.links[flat]
        at = _ranges((np.cumsum(self.links) - self.links)[flat], rep)
        owner, code, times = np.repeat(owner, rep), self.code[at], self.times[at] * np.repeat(times, rep)
        order = np.argsort((owner * len(self.a.bytes) + (code >> 32)) * len(self.b.bytes) + (code & 0xFFFFFFFF))
        owner, code, times = owner[order], code[order], times[order]
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        return sizes, shown, owner[first], code[first], np.add.reduceat(times, first) if len(first) else times


def _align(byte_bpe: str, piece_bpe: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligned(byte_bpe, piece_bpe)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size = np.cumsum([0, *pc.fill_null(pc.utf8_length(texts), 0).to_pylist()])[:-1] // SLICE_CHARS
            for c in np.unique(size):
                lo, hi = np.searchsorted(size, [c, c + 1]).tolist()
                sizes, shown, owner, code, times = known.documents(texts.slice(lo, hi - lo).to_pylist())
                parts = [pa.array((x).astype(np.int32)) for x in (code >> 32, code & 0xFFFFFFFF)] + [pa.array(times)]
                links = pa.StructArray.from_arrays(parts, names=["a", "b", "times"])
                offsets = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *[pa.array(sizes[:, k]) for k in range(4)], pa.array(shown, pa.string()), pa.ListArray.from_arrays(offsets, links)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    return run


def align_tokens(docs: DataFrame, *, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids in order) and links
    array<struct<a, b, times>>, each pair of ids that a group of the text links, with its occurrences.

    Text and a space before it are encoded without special tokens, whose strings are plain text. Null and empty texts, and those whose
    bytes either tokenizer doesn't give back, have no tokens: zeros, '' and an empty array. Repeated rows give equal rows, a null doc_id is kept, other columns are
    ignored, and an empty table gives an empty one. Memory is linear in a text's tokens but for stretches without a common end of tokens,
    whose distinct ids are paired. Both files must be at their paths on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_align(byte_bpe, piece_bpe), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,times:long>>")


def pair_counts(links: DataFrame) -> DataFrame:
    """links (a, b: distinct in each document) to a, b, n (documents) and best (no pair of this a has more)."""
    counts = materialize(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(small(top), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_query(docs: DataFrame, *, broadcast_pairs: int = 1_000_000, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Digest of every document's alignment, with how common its links are in the corpus. Pairs are as many as both vocabularies allow at
    most; they are broadcast if they are counted to be broadcast_pairs or fewer, else joined by shuffling."""
    row = fresh("row", docs)
    aligned = align_tokens(docs, byte_bpe=byte_bpe, piece_bpe=piece_bpe)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    known = materialize(aligned.withColumn("groups_sha256", digest).drop("groups").withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = small(materialize(pair_counts(known.select(F.inline("links")).select("a", "b")), "counts"), broadcast_pairs)
    own = [row, "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    linked = known.filter(F.size("links") > 0).select(*own, F.inline("links")).join(counts, ["a", "b"])
    linked = linked.groupBy(*own).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    alone = known.filter(F.size("links") == 0).select(*own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return linked.union(alone).select(*own[1:6], "n_best", "count_sum", "groups_sha256")
