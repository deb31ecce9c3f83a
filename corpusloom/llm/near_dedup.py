"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Stages, all distributed:

1. One pass over the texts makes each document's shingle set, its SuperMinHash signature and, from that, one key per band.
   Documents with equal sets (exact copies among them) become one class, by a groupBy with partial aggregation, so a
   group of thousands of copies is one row from here on.
2. Classes that share a band key form a bucket. A bucket is never turned into all its pairs: its members are compared with
   one pivot. Where that leaves a bucket in several components, further rounds take other pivots; for the documents of the
   buckets that are in several components even then, an exact prefix-filtered join finds the pairs to compare, so no link
   that a bucket could show is lost.
3. Every comparison is confirmed on the full shingle sets.
4. Links are grouped by union-find: a forest inside each partition first, then contraction of the forests' roots.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, small
from corpusloom.llm.shingles import GOLDEN, mix64, shingle_sets


def super_minhash(values: np.ndarray, owner: np.ndarray, n_owners: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n_owners x m) of the sets given as hashed values with the index of their owner.

    Element x proposes rank j plus a fraction to slot p_j(x), where p(x) is a random permutation of the m slots drawn step by
    step (Fisher-Yates); a slot keeps the least proposal. Ranks of an element are thus correlated: each slot gets one rank.
    All elements of a set take step j together; once every slot of a set is below j + 1, later steps can't change it and the
    set stops early.
    """
    big = np.uint64(m) << np.uint64(32)
    sig = np.full(n_owners * m, big, np.uint64)
    picks: list[np.ndarray] = []
    for j in range(m):
        x = mix64(values + np.uint64(int(GOLDEN) * (j + 1) % 2**64))
        pick = np.uint64(j) + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32))
        pick = pick.astype(np.int64)
        slot = pick.copy()
        for i in range(j - 1, -1, -1):  # where the swaps of the earlier steps have taken the value from
            slot[slot == picks[i]] = i
        np.minimum.at(sig, owner * m + slot, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        picks.append(pick)
        open_sets = sig.reshape(n_owners, m).max(axis=1) >= (np.uint64(j + 1) << np.uint64(32))
        going = open_sets[owner]
        if not going.any():
            break
        if not going.all():
            values, owner, picks = values[going], owner[going], [p[going] for p in picks]
    return sig.reshape(n_owners, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]) * GOLDEN
    for r in range(rows.shape[2]):
        key = mix64(key + rows[:, :, r])
    return key.astype(np.int64)


def _batches(pdf: pd.DataFrame, shingle_words: int, most: int = 300_000) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Rows with their shingle sets, so many at a time as have about `most` characters times eight."""
    size = pdf["text"].str.len().fillna(0).to_numpy() // 8 + 1
    cut = np.cumsum(size) // most
    for c in np.unique(cut):
        rows = slice(*np.searchsorted(cut, [c, c + 1]).tolist())
        yield rows, shingle_sets(pdf["text"].iloc[rows], shingle_words)


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signatures(shingle_words: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, sets in _batches(pdf, shingle_words):
                n = np.array([len(s) for s in sets])
                sig = super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), bands * rows)
                keys = band_keys(sig, bands)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[part].array, "n_shingles": n, "set_key": [_set_key(s) for s in sets], "bands": [k if c else k[:0] for k, c in zip(keys, n, strict=True)]})

    return run


def _sets(shingle_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, sets in _batches(pdf, shingle_words):
                yield pd.DataFrame({"node": pdf["doc_id"].iloc[part].array, "set_key": [_set_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (a, b) in enumerate(zip(pdf["set_a"], pdf["set_b"], strict=True)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one batch: each node with the least node of its tree."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        yield pd.DataFrame({"a": list(parent), "b": [find(x) for x in parent]}, dtype="int64").query("a != b")


def connected_components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """links (a, b) to (node, comp): comp is the least node reachable. Nodes without links are absent.

    Each partition turns its links into a forest. Then, round by round, every root hooks onto the neighbour that comes first in an order that a hash
    draws anew for each round, and jumps to where that one hooks; what is left of the links is expressed by roots. Whatever the shape of
    a component, a chain of ascending ids too, a fixed share of its roots is expected to go in each round, so rounds grow with the logarithm of its size.
    rounds gets the number of links left after each round.
    """
    edges = materialize(links.mapInPandas(_forest, "a long, b long"), "links")
    label = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")), "labels")
    for turn in itertools.count():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        up = materialize(first.select(F.col("a").alias("comp"), F.least("first", place("a"))["id"].alias("up")), "parents")
        over = small(up.select(F.col("comp").alias("up"), F.col("up").alias("top")))  # the parent's parent
        up = materialize(up.join(over, "up", "left").select("comp", F.coalesce("top", "up").alias("up")), "parents")
        label = materialize(label.join(small(up), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        a, b = (small(up.select(F.col("comp").alias(c), F.col("up").alias(f"{c}_up"))) for c in ("a", "b"))
        edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        edges = materialize(edges.filter("a <> b").distinct(), "links")
        if rounds is not None:
            rounds.append(edges.count())
        if edges.isEmpty():
            least = label.groupBy("comp").agg(F.min("node").alias("least"))
            return label.join(small(least), "comp").select("node", F.col("least").alias("comp"))


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among left (node, comp, n), of different components, by prefix filtering, which is exact.

    With one order of all shingles, rarest first, two sets can only be similar enough if they share one of their first
    n - ceil(percent * n / 100) + 1, and if what follows a shared place is long enough for the rest of the intersection. So
    documents that share no more than a common passage, whose shingles come last, don't meet.
    """
    rows = sets.join(small(materialize(left, "left")), "node").mapInPandas(_unpacked, "node long, comp long, n long, h array<long>").select("node", "comp", "n", F.explode("h").alias("h"))
    rows = materialize(rows, "shingles")
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h", "f")
    # a shingle of one component only is rarer than all others: as a place it counts, as a meeting point not
    shared = rows.join(common, "h").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("hs"))
    shared = shared.withColumn("skip", F.col("n") - F.size("hs")).withColumn("prefix", F.expr(f"n - int(ceil({percent} * n / 100.0)) + 1"))
    met = shared.select("node", "comp", "n", "skip", F.posexplode(F.expr("slice(hs, 1, int(greatest(prefix - skip, 0)))")).alias("i", "x"))
    met = materialize(met.select("node", "comp", "n", (F.col("skip") + F.col("i")).alias("at"), F.col("x.h").alias("h")), "prefixes")
    other = met.select("h", *[F.col(c).alias(f"{c}_2") for c in ("node", "comp", "n", "at")])
    enough = F.expr(f"(100 + {percent}) * (least(n - at, n_2 - at_2)) >= {percent} * (n + n_2) and 100 * least(n, n_2) >= {percent} * greatest(n, n_2)")
    return met.join(other, "h").filter("node < node_2 and comp <> comp_2").filter(enough).select(F.col("node").alias("a"), F.col("node_2").alias("b"))


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["node", "comp", "n"]].assign(h=[np.frombuffer(s, np.int64) for s in pdf["shingles"]])


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, pivot_rounds: int = 1) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    A link is 100 * |A and B| >= percent * |A or B| on distinct shingles of shingle_words words. With 32 bands of 4 rows a
    pair at 0.75 shares no band with probability 5e-6. Null and wordless texts have an empty set and link with nothing; a
    shorter text is one shingle. Repeated rows are copies of each other. Rows with one doc_id and different texts are one
    document that is linked with all that any of its texts is linked with. A row with a null doc_id is returned with a null
    component and kept false. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    # ids go through pandas as text: a long column with nulls would become doubles there
    sig = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_signatures(shingle_words, bands, rows), "doc_id string, n_shingles long, set_key binary, bands array<long>")
    sig = materialize(sig.withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")
    classes = sig.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("pivot"), F.max("node").alias("last")).filter("pivot.node <> last").select("key", "pivot")
    members = materialize(banded.join(shared, "key").select("key", "node", "n", "pivot"), "members")
    met = small(materialize(members.select("node").distinct(), "met"))
    nodes = materialize(classes.join(met, "node", "left_semi").select("node", "set_key"), "nodes")
    of_nodes = docs.join(small(nodes.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = materialize(of_nodes.mapInPandas(_sets(shingle_words), "node long, set_key binary, shingles binary"), "sets")
    if sets.count() > nodes.count():  # repeated doc_ids: one row of each class will do
        sets = materialize(sets.join(small(nodes), ["node", "set_key"], "left_semi").dropDuplicates(["node", "set_key"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
        return materialize(b.join(small(pairs), "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInPandas(_confirm(percent), "a long, b long"), "confirmed")

    def fits(x: str, y: str):
        return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")  # else no intersection can be large enough

    first = members.filter(F.col("pivot.node") != F.col("node")).filter(fits("n", "pivot.n")).select(F.col("pivot.node").alias("a"), F.col("node").alias("b"))
    tested = materialize(first.distinct(), "pairs")
    links = confirmed(tested)
    several = sig.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("doc_id")
    several = materialize(several, "several")
    if not several.isEmpty():  # documents of several classes link these
        mine = sig.join(small(several), "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
        least = mine.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.union(materialize(mine.join(least, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "own-links"))
    comps = connected_components(links)
    for turn in range(pivot_rounds + 1):
        here = members.select("key", "node", "n").join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "comp", "n"), F.xxhash64("node", F.lit(turn))).alias("p")).filter("lo <> hi").select("key", "p")
        split = materialize(split, "split")
        if turn < pivot_rounds:
            pairs = here.join(small(split), "key").filter("comp <> p.comp").filter(fits("n", "p.n"))
            pairs = pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
        else:
            left = here.join(small(split.select("key")), "key", "left_semi").select("node", "comp", "n").distinct()
            pairs = _prefix_pairs(left, sets, percent)
        pairs = materialize(pairs.distinct().join(small(tested), ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested, new = tested.union(pairs), confirmed(pairs)
            if not new.isEmpty():
                links = links.union(new)
                comps = connected_components(links)
    roots = classes.join(small(comps), "node", "left").select("set_key", F.coalesce("comp", "node").alias("component_id"))
    linked = sig.filter("n_shingles > 0 and doc_id is not null").join(roots, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = sig.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(False)).alias("kept"))
