"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Seeds are bigrams of which one word may be left out between. An alignment with a score of 2 m - x has m matches and a
penalty of x between them, so at least m - 1 - x / 2 pairs of matches that follow each other have a penalty of one at most:
both words next to each other, or one word apart, in item and passage alike. So seeds of this form can't miss an alignment
that scores enough, however its edits lie.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, texts

_WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
SEEDS = 3  # that lie in one alignment, if it is sure to have so many


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(item, passage) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of ``item`` in ``passage`` (Smith-Waterman, linear gaps)."""
    a = np.array(item)
    n = len(a)
    ramp = np.arange(n + 1) * GAP
    row, origin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = (0, 0, 0)
    for j, x in enumerate(passage):
        came = np.empty(n + 1, np.int64)
        score = np.zeros(n + 1, np.int64)
        diagonal = row[:-1] + np.where(a == x, MATCH, MISMATCH)
        skip = row[1:] + GAP
        up = skip > diagonal
        score[1:] = np.maximum(np.where(up, skip, diagonal), 0)
        came[0], came[1:] = j + 1, np.where(up, origin[1:], np.where(row[:-1] > 0, origin[:-1], j))
        # gaps in the passage: the best score to the left, less what the way costs
        run = np.maximum.accumulate(score - ramp)
        far = run + ramp
        if (better := far > score).any():
            at = np.maximum.accumulate(np.where(score - ramp == run, np.arange(n + 1), 0))
            came, score = np.where(better, came[at], came), np.where(better, far, score)
        row, origin = score, came
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), j + 1)
    return best


class Items:
    """Test items with an index of their rare seeds; its size is bounded by the block of items it is made of."""

    def __init__(self, items: list[tuple[int, str]], least: float):
        numbers: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(t)], np.int64) for _, t in items]
        self.numbers = numbers
        self.distinct = [np.unique(w, return_counts=True) for w in self.words]
        length = np.array([len(w) for w in self.words], np.int64)
        self.bar = least * MATCH * length  # of the score
        self.matches = np.maximum(1, np.ceil(least * length - 1e-9)).astype(np.int64)  # a score of 2 m at most has m matches
        self.span = np.maximum(1, np.floor((MATCH + 1) * length - self.bar + 1e-9)).astype(np.int64)  # m matches, 2 m - bar others at most
        self.sure = np.maximum(0, np.ceil(least * length - 1 - 1e-9)).astype(np.int64)  # places with a seed in an alignment that reaches the bar
        self.seeds = np.clip(self.sure, 1, SEEDS)
        self.places = [self._seeds_of(w, s) for w, s in zip(self.words, self.sure.tolist(), strict=True)]
        self.codes = np.array(sorted({c for p in self.places for each in p for c in each}), np.int64)

    def _seeds_of(self, w: np.ndarray, sure: int) -> list[list[int]]:
        """The codes of the seeds that begin at each place of an item; of items that are too short for seeds, its words."""
        n, base = w.tolist(), len(self.numbers) + 1
        return [[a * base + b for b in n[i + 1 : i + 3]] for i, a in enumerate(n[:-1])] if sure else [[a * base] for a in n]

    def numbered(self, text: str) -> np.ndarray:
        """The text's word numbers; 0: in no item."""
        words = words_of(text)
        return np.fromiter(map(self.numbers.get, words, itertools.repeat(0)), np.int64, len(words))

    def seeds_in(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the seed) of all seeds of any item among the word numbers ``w``."""
        known = np.flatnonzero(w)
        if not len(known) or not len(self.codes):
            return known[:0], known[:0]
        after, base = np.concatenate([w, [0, 0]]), len(self.numbers) + 1
        first = w[known] * base
        code = np.concatenate([first, first + after[known + 1], first + after[known + 2]])
        number = np.searchsorted(self.codes, code)
        there = self.codes[np.minimum(number, len(self.codes) - 1)] == code
        return np.concatenate([known, known, known])[there], number[there]

    def keep_rare(self, counts: np.ndarray) -> None:
        """Each item's seeds: those that begin at its rarest places, by the number of documents. So many places are left out
        that an alignment which reaches the bar still has ``seeds`` of the rest, whichever they are."""
        pairs = []
        for k, each in enumerate(self.places):
            numbers = [np.searchsorted(self.codes, c).tolist() for c in each]
            most = len(each) - int(self.sure[k]) + int(self.seeds[k]) if self.sure[k] else len(each)
            rare = sorted(numbers, key=lambda p: (counts[p].sum(), p))[:most]
            pairs += [(x, k) for x in {x for p in rare for x in p}]
        at = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(at[:, 0], np.arange(len(self.codes) + 1))
        self.of = at[:, 1]

    def windows(self, w: np.ndarray) -> dict[int, list[list[int]]]:
        """By item, the parts of a document (word numbers) that may hold an alignment which reaches the bar; none is left out."""
        place, number = self.seeds_in(w)
        n = self.first[number + 1] - self.first[number]
        at = np.repeat(place, n)
        k = self.of[np.repeat(self.first[number] - np.cumsum(n) + n, n) + np.arange(len(at))]
        order = np.lexsort((at, k))
        at, k = at[order], k[order]
        i = np.arange(len(at))
        j = np.minimum(i + self.seeds[k] - 1, len(at) - 1)
        near = np.flatnonzero((i + self.seeds[k] <= len(at)) & (k[j] == k) & (at[j] - at < self.span[k]))
        out: dict[int, list[list[int]]] = {}
        for x in near.tolist():  # of hits i to j in one alignment, both lie within its span
            item, span = int(k[x]), int(self.span[k[x]])
            lo, hi = max(0, int(at[j[x]]) - span + 1), min(len(w), int(at[x]) + span)
            spans = out.setdefault(item, [])
            if spans and hi <= spans[-1][1]:
                continue
            if not self.reachable(item, w[lo:hi]):
                continue
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        return out

    def reachable(self, k: int, part: np.ndarray) -> bool:
        """Bounds of the alignment with item ``k``: words in common, and the best sum if each word of the item matched."""
        own, times = self.distinct[k]
        at = np.minimum(np.searchsorted(own, part), len(own) - 1)
        common = own[at] == part
        if np.minimum(np.bincount(at[common], minlength=len(own)), times).sum() < self.matches[k]:
            return False
        p = np.flatnonzero(common)
        gain = (MATCH + 1) * np.arange(len(p)) - p
        return bool((gain - np.minimum.accumulate(gain)).max() + MATCH >= self.bar[k] - 1e-9)


def _overlaps(items: Items, text: str):
    """(item number, score share, first word, end word) of the best alignment with each item that reaches the bar."""
    w = items.numbered(text)
    for k, spans in sorted(items.windows(w).items()):
        item = items.words[k]
        best = (0, 0, 0)
        for lo, hi in spans:
            score, a, b = align(item, w[lo:hi])
            best = max(best, (score, -(lo + a), lo + b))
        if best[0] and best[0] >= items.bar[k]:
            yield k, best[0] / (MATCH * len(item)), -best[1], best[2]


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block: int = 5000, most_chars: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, rid, item_id, score, start, end): pairs of a document and a test item whose best local alignment has
    ``least`` of the item's full score or more, with the words [start, end) of the document.

    Words are lower-cased runs of word characters. Seeds are bigrams (with one word between, or none) at each item's rarest
    places, by their document counts over all of ``docs``; they are so many that every alignment which reaches ``least`` has
    some of them close together, so the result is that of aligning every document with every item.
    Items come in blocks of about ``block`` items and ``most_chars`` characters at most (by hashed id), each block with its
    index broadcast and run against all documents, so what is broadcast is bounded for a benchmark of any size. Null or empty texts and items match
    nothing; repeated rows get equal results.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("item")).distinct()
    n, chars = tests.agg(F.count("*"), F.sum(F.length("item"))).first()
    blocks = max(1, -(-n // block), -(-(chars or 0) // most_chars))
    out = None
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k).collect()
        items = Items(sorted(((r.item_id, r.item) for r in part), key=lambda x: (x[0] is None, x)), least)
        first = spark.sparkContext.broadcast(items)

        def seen(batches, first=first):
            items = first.value
            counts = np.zeros(len(items.codes), np.int64)
            for b in batches_of(batches):
                for t in b.column("text").to_pylist():
                    counts[np.unique(items.seeds_in(items.numbered(t))[1])] += 1
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["seed", "n"])

        counts = np.zeros(len(items.codes), np.int64)
        for r in rows.select("text").mapInArrow(seen, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["seed"]] = r["n"]
        items.keep_rare(counts)
        index = spark.sparkContext.broadcast(items)

        def score(batches, index=index):
            for b in batches_of(batches):
                at = [(i, *x) for i, t in enumerate(b.column("text").to_pylist()) for x in _overlaps(index.value, t)]
                rows_at = pa.array([x[0] for x in at], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows_at), b.column("rid").take(rows_at), pa.array([index.value.ids[x[1]] for x in at], pa.int64()), pa.array([x[2] for x in at], pa.float64()), pa.array([x[3] for x in at], pa.int64()), pa.array([x[4] for x in at], pa.int64())], ["doc_id", "rid", "item_id", "score", "start", "end"])

        found = rows.mapInArrow(score, "doc_id long, rid long, item_id long, score double, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out
