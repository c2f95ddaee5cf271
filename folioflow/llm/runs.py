"""Periodic runs of words: stretches that repeat themselves three times or more.

A document is exploded into overlapping tiles, a row of tiles for each octave of periods. In an octave with blocks of D
words (periods below 2D), a run's matching words (those equal to the word one period on) fill at least one block that
starts at a multiple of D. So a tile looks at these boundaries only: blocks that recur within the octave's distance are
found by rolled hashes, and Z-functions from the boundary, onwards and backwards, give how far the match goes and whether a
shorter period divides it. What a tile finds is cut at its ends; fragments are shuffled by document and period
and stitched there. Work is n log n in a document's words, whatever its periods are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, texts, written

LEAST, POWER = 24, 3  # words of a run, and how often its period must fit
CORE = 1 << 13  # words of a tile without its overlaps, at least
MOST_BYTES = 8 << 20  # of tiles that a batch holds
_A = np.uint64(0x9E3779B97F4A7C15)
_RUN = "struct<start:bigint,period:bigint,length:bigint>"


def z_function(s: list) -> list[int]:
    """For each place, how many items from there on equal the items from the start on."""
    z, left, right = [0] * len(s), 0, 0
    if s:
        z[0] = len(s)
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@functools.lru_cache(100_000)
def _quotients(q: int) -> tuple[int, ...]:
    """``q`` by each of its prime divisors."""
    out, rest, d = [], q, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def octaves(n: int, least: int = LEAST, power: int = POWER) -> Iterator[tuple[int, int]]:
    """(D, smallest period) of each octave that a document of ``n`` words can have runs in; its periods end at 2D - 1. The
    first one has all short periods."""
    block = 1 << ((least // 3).bit_length() - 1)
    low = 1
    while n >= max(least, power * low):
        yield block, low
        block, low = 2 * block, 2 * block


def tiles(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(D, smallest period, first word, words before the core, words): a tile's core is followed by 4 D words and comes after
    D words of the document, where there are as many."""
    for block, low in octaves(len(codes), least, power):
        core = max(CORE, 8 * block)
        for start in range(0, len(codes), core):
            lead = min(start, block)
            yield block, low, start - lead, lead, codes[start - lead : start + core + 4 * block]


def solve(codes: np.ndarray, lead: int, block: int, low: int) -> dict[int, list[list[int]]]:
    """Of one tile: for each period the places (from, to) of words that equal the word one period on, if they fill
    a block at a boundary of the core. Periods of which a divisor is a period too have none."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _A
    step = 1
    while step < block and len(h) > step:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * _A + h[step:]
        step *= 2
    if step < block:
        return {}
    core = max(CORE, 8 * block)
    at = np.arange(lead, min(lead + core, len(h) - low), block)
    offsets = np.arange(low, 2 * block)
    to = at[:, None] + offsets
    same = (h[np.minimum(to, len(h) - 1)] == h[at][:, None]) & (to < len(h))
    found: dict[int, list[list[int]]] = {}
    for i in np.flatnonzero(same.any(axis=1)).tolist():
        b = int(at[i])
        periods = offsets[same[i]].tolist()
        onward = z_function(codes[b : b + 4 * block].tolist())
        before, around = codes[max(0, b - block) : b][::-1].tolist(), codes[max(0, b - block) : b + 2 * block][::-1].tolist()
        backward = z_function([*before, -1, *around])
        last = len(backward) - 1 - (len(before) + 1)  # place in `around` of its last item, the earliest word
        for q in periods:
            if onward[q] < block or any(onward[p] >= q - p for p in _quotients(q)):
                continue  # equal hashes of other words, or a shorter period
            back = backward[len(before) + 1 + last - (len(before) + q - 1)]
            a, e = b - back, b + min(onward[q], 2 * block)
            if (held := found.setdefault(q, [])) and a <= held[-1][1]:
                held[-1][1] = max(held[-1][1], e)
            else:
                held.append([a, e])
    return found


def coded(words: list[bytes]) -> np.ndarray:
    """Words as small numbers, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def _tiled(least: int, power: int):
    names = ["doc_id", "rid", "block", "low", "start", "lead", "codes"]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names)

    def cut(batches):
        held, size = [], 0
        for b in batches_of(batches):
            for doc_id, rid, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True):
                words = text.encode().split()
                if len(words) < least:
                    continue
                for block, low, start, lead, part in tiles(coded(words), least, power):
                    held.append((doc_id, rid, block, low, start, lead, part.tobytes()))
                    size += part.nbytes
                    if size > MOST_BYTES:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return cut


def _solved(batches):
    names = ["doc_id", "rid", "period", "start", "end"]
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, rid, block, low, start, lead, codes in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "block", "low", "start", "lead", "codes")), strict=True):
            for q, places in solve(np.frombuffer(codes, np.int32), lead, block, low).items():
                for a, e in places:
                    for column, x in zip(out, (doc_id, rid, q, start + a, start + e), strict=True):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)


def find_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, runs array<start, period, length>) of each distinct (id, text) that has runs, by start, then period.

    A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least ``least`` words and
    ``power`` periods (3 at least), that no neighbouring word extends. Words stand between ASCII white space. Null and empty texts have
    no runs; rows that repeat id and text have the same ones, and null ids count like any other.
    """
    if power < 3 or least < 3:
        raise ValueError("runs of fewer than three periods or words can't be found by blocks")
    cut = texts(docs, id_col, text_col).mapInArrow(_tiled(least, power), "doc_id long, rid long, block long, low long, start long, lead long, codes binary")
    parts = cut.mapInArrow(_solved, "doc_id long, rid long, period long, start long, end long")
    each = parts.groupBy("doc_id", "rid", "period").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("parts"))
    # an interval that begins where the last one has ended, or before, goes on with it
    stitched = F.expr("""aggregate(parts, cast(array() as array<struct<start:bigint,end:bigint>>), (held, x) ->
        if(size(held) > 0 and x.start <= element_at(held, -1).end,
           concat(slice(held, 1, size(held) - 1), array(named_struct('start', element_at(held, -1).start, 'end', greatest(element_at(held, -1).end, x.end)))),
           concat(held, array(x))))""")
    whole = each.select("doc_id", "rid", "period", F.explode(stitched).alias("x")).select("doc_id", "rid", F.struct(F.col("x.start").alias("start"), "period", (F.col("x.end") - F.col("x.start") + F.col("period")).alias("length")).alias("run"))
    long_enough = (F.col("run.length") >= least) & (F.col("run.length") >= F.col("run.period") * power)
    return whole.where(long_enough).groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def collapse_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<start, period, length>, collapsed string) for every row: its runs, and its words joined by one space without those
    that a run has after its first period. See `find_runs`; without runs the array is empty and all words stay."""
    rows = texts(docs, id_col, text_col)
    runs = written(find_runs(docs, least, power, id_col, text_col).select(F.col("doc_id").alias("r_doc"), F.col("rid").alias("r_rid"), "runs"), "runs")
    small = (runs.agg(F.sum(F.size("runs") + 4)).first()[0] or 0) <= 4_000_000  # about 100 MB at most
    same = F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("rid") == F.col("r_rid"))

    def keep(batches):
        for b in batches_of(batches):
            n, kept = [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = text.encode().split()
                n.append(len(words))
                if runs:
                    stay = bytearray(b"\1") * len(words)
                    for r in runs:
                        stay[r["start"] + r["period"] : r["start"] + r["length"]] = bytes(r["length"] - r["period"])
                    words = [w for w, s in zip(words, stay, strict=True) if s]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), b.column("runs"), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    joined = rows.join(F.broadcast(runs) if small else runs, same, "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(keep, f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string")
    return out.withColumn("runs", F.coalesce("runs", F.array().cast(f"array<{_RUN}>")))
