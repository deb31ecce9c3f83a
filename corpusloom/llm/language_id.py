"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text accepts every substring of that text. A new text is cut greedily, from
left to right, into the longest phrases that the automaton accepts; the fewer phrases a language needs for a text, the
smaller the cross-entropy. The count is normalised by the text's length, as the per-language samples have the same size.

The automata are built from a bounded sample of labelled rows (sample_chars characters a language), so they can be broadcast: at
most 2 * sample_chars states and 3 * sample_chars arcs a language. All labelled languages are learned, and all letters of their
samples are symbols. A language with few letters has a table of states and symbols, any other a sorted array of its arcs; if all
of them are too large to be held at once, they are broadcast, loaded and scored in groups. A text is reduced to
lower-case letters with one space between words. It is parsed whole, in segments of `segment` symbols, all segments of a
batch in lockstep and for each language at once; a phrase ends at the end of its segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, others

UNDETERMINED = "und"
SPACE = 0
GROUP_BYTES = 128 << 20  # of automata that a worker holds at once
DRAWN_LANGUAGES = 256  # whose samples the driver collects at once


def automaton_arcs(symbols: list[int]) -> list[dict[int, int]]:
    """Symbol to next state, for each state of the suffix automaton; every state accepts, state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def suffix_automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Transition table (states x symbols, -1 where there is none) of the suffix automaton."""
    nexts = automaton_arcs(symbols)
    step = np.full((len(nexts), n_symbols), -1, np.int32)
    for state, out in enumerate(nexts):
        for c, to in out.items():
            step[state, c] = to
    return step


@cache
def _alphabetic() -> np.ndarray:
    """1 for each code point that is a letter, else 0."""
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), np.uint32, 0x110000)


def _classes(letters: str) -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, 1 for letters not in the samples, then the letters. Upper case as lower case."""
    table = _alphabetic().copy()
    for i, ch in enumerate(letters, 2):
        table[ord(ch)] = i
    for ch in letters:
        up = ch.upper()
        if len(up) == 1:
            table[ord(up)] = table[ord(ch)]
    return table


def to_symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of the text's letters, words parted by one SPACE, and one at either end; empty without letters."""
    s = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s != SPACE
    if not keep.any():
        return np.empty(0, np.uint32)
    first = np.concatenate([[True], keep[:-1]])  # the first of what lies between words
    s = s[keep | first]
    s = s if s[0] == SPACE else np.concatenate([np.zeros(1, np.uint32), s])
    return s if s[-1] == SPACE else np.concatenate([s, np.zeros(1, np.uint32)])


def letters_of(text: str) -> set[str]:
    return {ch for ch in text.lower() if ch.isalpha() and len(ch) == 1}


def _table_bytes(text: str) -> int:
    return 8 * (len(text) + 3) * (len(letters_of(text)) + 2)


def _arc_bytes(text: str) -> int:
    return 12 * 3 * (len(text) + 3)


def groups(samples: dict[str, str], most_bytes: int = GROUP_BYTES) -> list[dict[str, str]]:
    """samples in groups whose automata are about most_bytes at most, in the order of the languages."""
    share, held, out = most_bytes // max(1, len(samples)), most_bytes, []
    for lang in sorted(samples):
        table, arcs = _table_bytes(samples[lang]), _arc_bytes(samples[lang])
        size = table if table <= share else arcs
        if held + size > most_bytes:
            out.append({})
            held = 0
        out[-1][lang] = samples[lang]
        held += size
    return out or [{}]


class Automaton:
    """Suffix automaton of one language over the symbols of its own sample. A symbol that it hasn't is a phrase of its own, state `dead`."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, table: bool):
        own = np.unique(symbols)
        self.width = len(own) + 1
        self.column = np.full(n_symbols, len(own), np.int64)  # of each symbol; the last for those it hasn't
        self.column[own] = np.arange(len(own))
        nexts = automaton_arcs(self.column[symbols].tolist())
        dead = len(nexts)
        self.again = np.full(self.width, dead, np.int32)  # where a phrase's first symbol leads
        for c, to in nexts[0].items():
            self.again[c] = to
        n = sum(map(len, nexts))
        arcs = np.fromiter((state * self.width + c for state, out in enumerate(nexts) for c in out), np.int64, n)
        to = np.fromiter((t for out in nexts for t in out.values()), np.int32, n)
        self.arcs = self.to = self.step = None
        if table:
            self.step = np.tile(~self.again, dead + 1)  # missing arcs lead to the arc from the start, marked by sign
            self.step[arcs] = to
        else:
            order = np.argsort(arcs)
            self.arcs, self.to = np.append(arcs[order], np.iinfo(np.int64).max), np.append(to[order], np.int32(0))

    def next(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The next state, or ~ of it where a new phrase begins."""
        arc = state * self.width + column
        if self.step is not None:
            return self.step[arc]
        at = np.searchsorted(self.arcs, arc)
        return np.where(self.arcs[at] == arc, self.to[at], ~self.again[column])


class Model:
    """Automata of some languages."""

    def __init__(self, samples: dict[str, str], table_bytes: int = GROUP_BYTES):
        """table_bytes: the most that the transition table of one language may take, else it has sorted arcs."""
        self.languages = sorted(samples)
        self.letters = "".join(sorted(set().union(*map(letters_of, samples.values()))))
        table = _classes(self.letters)
        self.automata = [Automaton(to_symbols(samples[lang], table), len(self.letters) + 2, _table_bytes(samples[lang]) <= table_bytes) for lang in self.languages]
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def phrases(self, texts: list[str | None], segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed (texts x languages), and symbols of each text."""
        if self._table is None:
            self._table = _classes(self.letters)
        symbols = [to_symbols(t, self._table) if t else np.empty(0, np.uint32) for t in texts]
        size = np.array([len(s) for s in symbols])
        cuts = -(-size // segment)
        owner = np.repeat(np.arange(len(texts)), cuts)
        need = np.zeros((len(texts), len(self.languages)), np.int64)
        if not len(owner) or not self.languages:
            return need, size
        flat = np.concatenate(symbols)
        begin = np.repeat(np.cumsum(size) - size, cuts) + segment * (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        long = np.minimum(segment, np.repeat(np.cumsum(size), cuts) - begin)
        order = np.argsort(-long, kind="stable")
        begin, long, owner = begin[order], long[order], owner[order]
        lanes = np.searchsorted(-long, -np.arange(1, segment + 1), side="right")  # how many segments have a symbol at that place
        for i, auto in enumerate(self.automata):
            column = auto.column[flat]
            state = auto.again[column[begin]].astype(np.int64)
            count = np.ones(len(begin), np.int64)
            for place in range(1, segment):
                n = lanes[place]
                if not n:
                    break
                to = auto.next(state[:n], column[begin[:n] + place])
                missing = to >> 31  # -1 or 0
                count[:n] -= missing
                state[:n] = to ^ missing
            need[:, i] = np.bincount(owner, weights=count, minlength=len(texts))
        return need, size


def training_sample(labelled: DataFrame, sample_chars: int) -> dict[str, str]:
    """Text of each language, of at most sample_chars characters. Rows are taken in the order of a hash of their id and text: about
    as many of each language, by its count, as its share of characters needs. Of many languages, so many at a time as the driver can collect."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)).alias("rank"))
    chars = {r["lang"]: r["chars"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()}
    out: dict[str, str] = {}
    for start in range(0, len(chars), DRAWN_LANGUAGES):
        # three times what is needed on average; the least rank of each language comes too, should the draw be empty
        cut = {lang: min(1.0, 3.0 * sample_chars / max(1, chars[lang])) for lang in sorted(chars)[start : start + DRAWN_LANGUAGES]}
        share = F.element_at(F.create_map(*[x for lang, s in cut.items() for x in (F.lit(lang), F.lit(s))]), F.col("lang"))
        own = rows.filter(F.col("lang").isin(list(cut)))
        head = F.substring("text", 1, sample_chars).alias("text")
        least = own.groupBy("lang").agg(F.min_by(head, "rank").alias("text"), F.min("rank").alias("rank"))
        drawn = own.filter(F.col("rank") < share).select("lang", head, "rank").union(least.select("lang", "text", "rank"))
        for r in sorted(drawn.distinct().collect(), key=lambda r: (r["lang"], r["rank"], r["text"])):
            if len(out.get(r["lang"], "")) < sample_chars:
                out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[:sample_chars]
    return {lang: t for lang, t in out.items() if any(ch.isalpha() for ch in t)}


def identify_languages(docs: DataFrame, labelled: DataFrame, *, sample_chars: int = 60_000, sharpness: float = 60.0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with lang_pred string, score double and phrase_rate double (phrases a symbol, of the best language) added; columns
    of docs with these names are replaced.

    Learns from text and lang of labelled only. score is the best language's share in exp(-sharpness * rate). A null text, one
    without letters, or an empty labelled table gives `und` and 0. Ties go to the language first in the alphabet. Long texts
    are parsed whole. Repeated rows get equal results. More automata than group_bytes are held and scored in groups.
    """
    spark = docs.sparkSession
    samples = training_sample(labelled, sample_chars)
    table_bytes = group_bytes // max(1, len(samples))
    shared = [spark.sparkContext.broadcast(Model(g, table_bytes)) for g in groups(samples, group_bytes)]
    languages = sorted(samples)

    def phrases(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for s in shared:
            found.append(s.value.phrases(texts))
            if len(shared) > 1 and s._path:  # the next group takes its place; read again from the worker's file
                del s._value
        return np.hstack([need for need, _ in found]), found[0][1]

    @F.pandas_udf("lang_pred string, score double, phrase_rate double")
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found, start, texts = [], 0, texts.tolist()
            while start < len(texts):  # half a million characters at a time
                end, chars = start, 0
                while end < len(texts) and (chars < 500_000 or end == start):
                    chars += len(texts[end] or "")
                    end += 1
                need, size = phrases(texts[start:end])
                if languages:
                    rate = need / np.maximum(size, 1)[:, None]
                    best = rate.argmin(axis=1)
                    low = rate.min(axis=1)
                    share = 1 / np.exp(-sharpness * (rate - low[:, None])).sum(axis=1)
                    lang = np.array(languages, object)[best]
                else:
                    lang, share, low = np.full(end - start, UNDETERMINED, object), np.zeros(end - start), np.zeros(end - start)
                none = size == 0
                lang[none], share[none], low[none] = UNDETERMINED, 0.0, 0.0
                found.append(pd.DataFrame({"lang_pred": lang, "score": share, "phrase_rate": low}))
                start = end
            yield pd.concat(found, ignore_index=True) if found else pd.DataFrame({"lang_pred": [], "score": [], "phrase_rate": []})

    kept: list[Column] = [F.col(c) for c in others(docs, "lang_pred", "score", "phrase_rate")]
    p = fresh("parsed", docs)
    return docs.select(*kept, parse("text").alias(p)).select(*kept, f"{p}.lang_pred", f"{p}.score", f"{p}.phrase_rate")
