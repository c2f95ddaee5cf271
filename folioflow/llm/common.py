"""What several training-data operators share: row identity, once/twice Bloom filters
and connected components."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import discard, new_path, written

__all__ = ["BLANKS", "batches_of", "components", "discard", "filter_bits", "join_first", "map_suspects", "new_path", "texts", "written"]

#: ASCII white space of the text contracts: space and U+0009..U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, rid long, text string): the two columns that text operators read, under fixed names, so
    that further columns of ``docs`` never clash. Null texts become empty. (doc_id, rid) names a row's content:
    rows that repeat both id and text have equal results."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows, so that what Python holds of long texts at a time stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def join_first(many: DataFrame, one: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``many`` joined with the row of ``one`` that has its ``key``. ``one`` has each key once, and in ``n`` (dropped) how many
    rows of ``many`` have it. Keys that a thousandth of these rows or more have (so a thousand at most) are broadcast,
    and their rows stay where they are; only the others are shuffled. Both should be written tables."""
    bar = max(2, (one.agg(F.sum(n)).first()[0] or 0) // 1000)
    hot, rest = one.where(F.col(n) >= bar).drop(n), one.where(F.col(n) < bar).drop(n)
    others = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(F.broadcast(hot), key).unionByName(others.join(rest, key))


# --- once-seen / twice-seen Bloom filters ---------------------------------------------------------

_CHUNK = 1 << 16  # bytes of a filter that are merged together


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    other = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys & mask, (other >> np.uint64(20)) & mask


def _get(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def _put(field: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(field, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def filter_bits(n_keys: int, most_bits: int) -> int:
    """A power of two with about 12 bits a key, within 2**20 and ``most_bits`` (2**10 at least)."""
    return int(max(1 << 10, min(max(1 << 20, 1 << math.ceil(math.log2(max(1, n_keys) * 12))), most_bits)))


class Twice:
    """Bits of a Bloom filter that holds the keys which two documents (or more) have."""

    def __init__(self, bits: int):
        self.field = np.zeros(bits // 8, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which uint64 keys are in the filter: all that two documents share and a few others."""
        one, two = _places(keys, len(self.field) * 8)
        return (_get(self.field, one) & _get(self.field, two)).astype(bool)


def _fill(once: np.ndarray, twice: np.ndarray, keys: np.ndarray, again: np.ndarray) -> None:
    """Distinct keys into both filters: those that the first one has, or that are known to be there ``again``, go to the second one too."""
    one, two = _places(keys, len(once) * 8)
    again = again | (_get(once, one) & _get(once, two)).astype(bool)
    for at in (one, two):
        _put(once, at)
        _put(twice, at[again])


def twice_filter(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Twice:
    """The filter of all keys that two rows share.

    ``keys_of`` turns a batch of ``rows`` into one array of distinct uint64 keys for each document. Each task
    fills two filters, for keys seen once and seen twice; of two tasks, the bits that both once-filters have go
    to the twice-filter too, so no shared key is ever missed. Only compressed filter chunks are shuffled.
    """
    out = Twice(bits)

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches_of(batches):
            each = [k for k in keys_of(batch) if len(k)]
            if each:
                keys, n = np.unique(np.concatenate(each), return_counts=True)
                _fill(once, twice, keys, n > 1)
        for c in range(0, len(once), _CHUNK):
            if (a := once[c : c + _CHUNK]).any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c // _CHUNK], pa.int64()), "once": pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), "twice": pa.array([zlib.compress(twice[c : c + _CHUNK].tobytes(), 1)], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(0, np.uint8), None
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = (a.copy(), b.copy()) if twice is None else (once | a, twice | b | (once & a))
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})

    got = rows.mapInArrow(fill, "chunk long, once binary, twice binary").groupBy("chunk").applyInPandas(merge, "chunk long, twice binary")
    for row in got.toLocalIterator():  # bits / 8 bytes at most
        out.field[row["chunk"] * _CHUNK : row["chunk"] * _CHUNK + _CHUNK] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


RANGE = 1 << 22  # keys of a range of hashes, which one task filters


def shared_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n_keys: int, per_range: int = RANGE) -> DataFrame:
    """(tag int, keys array<binary>): for rows (with a column ``tag``) the uint64 keys that two of them may share; no shared key is missed.

    Keys are dealt by ranges of their hashes, as many as ``n_keys`` asks for; each range fills a once-seen and a twice-seen filter of its own and
    answers to the tags of its keys. A key that several rows of a batch have is sent on but once, for the rows of other batches; its own rows are answered
    from where they are. So a key that very many rows have is no hot range, and nothing is broadcast.
    """
    ranges = max(1, -(-n_keys // per_range))
    names = ["range", "keys", "tags", "sure"]

    def scatter(batches):
        turn = TaskContext.get().partitionId() * 7919  # tasks begin at different ranges
        for b in batches_of(batches):
            each = [np.unique(k) for k in keys_of(b)]
            tags = np.repeat(b.column("tag").to_numpy(), [len(k) for k in each])
            if not len(tags):
                continue
            keys = np.concatenate(each)
            order = np.argsort(keys, kind="stable")
            keys, tags = keys[order], tags[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            many = np.diff(np.append(np.flatnonzero(new), len(keys)))
            alone = np.repeat(many == 1, many)
            turn += 1
            out = [(turn % ranges, keys[~alone], tags[~alone], True)] if not alone.all() else []
            at = ((keys >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            for picked, whose in ((alone, tags), (new & ~alone, None)):  # those of one row, and one for all rows of each other key
                place = at[picked]
                by = np.argsort(place, kind="stable")
                edges = np.flatnonzero(np.diff(place[by], prepend=-1)).tolist()
                for i, j in itertools.pairwise([*edges, len(by)]):  # none, if no key is picked
                    out.append((int(place[by[i]]), keys[picked][by[i:j]], whose[picked][by[i:j]] if whose is not None else np.zeros(0, np.int32), False))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1].tobytes() for x in out], pa.binary()), pa.array([x[2].astype(np.int32).tobytes() for x in out], pa.binary()), pa.array([x[3] for x in out], pa.bool_())], names)

    def judge(group: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(k, np.uint64), np.frombuffer(t, np.int32), sure) for k, t, sure in zip(*(group.column(c).to_pylist() for c in names[1:]), strict=True)]
        bits = filter_bits(sum(len(k) for k, _, sure in parts if not sure), 1 << 30)
        once, twice = np.zeros(bits // 8, np.uint8), Twice(bits)
        for k, t, sure in parts:
            if not sure:
                _fill(once, twice.field, k, np.full(len(k), len(t) == 0))
        keys, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for k, t, sure in parts:
            if len(t):
                kept = np.ones(len(k), bool) if sure else twice.has(k)
                keys.append(k[kept])
                tags.append(t[kept])
        keys, tags = np.concatenate(keys), np.concatenate(tags)
        order = np.argsort(tags, kind="stable")
        keys, tags = keys[order], tags[order]
        edges = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1]])) if len(tags) else np.zeros(0, np.int64)
        return pa.table({"tag": pa.array(tags[edges], pa.int32()), "keys": pa.array([keys[i:j].tobytes() for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True)] if len(edges) else [], pa.binary())})

    dealt = rows.mapInArrow(scatter, "range long, keys binary, tags binary, sure boolean")
    return dealt.groupBy("range").applyInArrow(judge, "tag int, keys binary").groupBy("tag").agg(F.collect_list("keys").alias("keys"))


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among sorted ones. ``known`` is not sorted again, so a few keys may be asked for at a time."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


GATHERED = 1 << 20  # keys that a task deals at once


def shared_counts(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], list[np.ndarray]], n_keys: int, per_range: int = RANGE) -> DataFrame:
    """(tag int, hits long): of rows (with a column ``tag``), how many of their distinct uint64 keys two of them have; rows without such a key are left out.
    No shared key is missed, a few others may count.

    Keys are dealt by ranges, as many as ``n_keys`` asks for, with their lower 32 bits, and a range's keys are sorted to find those that are there twice. A key that
    several rows of those dealt together have counts where it is, and is sent on but once, for the rows of other tasks. So a key that very many rows have is no
    hot range. Texts stay where they are, and counts travel packed, by ranges of tags.
    """
    ranges = max(1, -(-n_keys // per_range))

    def parted(place: np.ndarray) -> tuple[np.ndarray, list]:
        """Rows in the order of their places, and (place, begin, end) of each."""
        by = np.argsort(place.astype(np.uint16) if ranges <= 1 << 16 else place, kind="stable")
        edges = np.flatnonzero(np.diff(place[by], prepend=-1)).tolist()
        return by, [(int(place[by[i]]), i, j) for i, j in itertools.pairwise([*edges, len(by)])]

    def deal(keys: list[np.ndarray], tags: list[np.ndarray], n: list[int], turn: int) -> pa.RecordBatch:
        keys, tags = np.concatenate(keys), np.concatenate(tags)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(keys)
        first = np.concatenate([[True], np.diff(keys[order]) > 0])
        once = first & np.append(first[1:], True)
        alone = np.empty(len(keys), bool)
        alone[order] = once
        again = keys[order[first & ~once]]
        here = np.bincount(row[~alone], minlength=len(n))
        out = [(turn % ranges, b"", tags[here > 0].tobytes(), here[here > 0].astype(np.int32).tobytes())]
        at = lambda k: ((k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        low = lambda k: k.astype(np.uint32).tobytes()
        keys, row = keys[alone], row[alone]
        by, parts = parted(at(keys))
        keys, row = keys[by], row[by]
        for p, i, j in parts:
            new = np.flatnonzero(np.diff(row[i:j], prepend=-1))
            out.append((p, low(keys[i:j]), tags[row[i:j][new]].tobytes(), np.diff(new, append=j - i).astype(np.int32).tobytes()))
        by, parts = parted(at(again))
        again = again[by]
        out += [(p, low(again[i:j]), b"", b"") for p, i, j in parts]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[c] for x in out], pa.binary()) for c in (1, 2, 3))], ["range", "keys", "tags", "counts"])

    def scatter(batches):
        turn, held = TaskContext.get().partitionId() * 7919, ([], [], [])
        for b in batches_of(batches):
            each = keys_of(b)
            held[0].extend(each)
            held[1].append(b.column("tag").to_numpy())
            held[2].extend(map(len, each))
            if sum(held[2]) >= GATHERED:
                yield deal(*held, turn)
                turn, held = turn + 1, ([], [], [])
        if sum(held[2]):
            yield deal(*held, turn)

    def judge(group: pa.Table) -> pa.Table:
        parts = [tuple(np.frombuffer(x, t) for x, t in zip(row, (np.uint32, np.int32, np.int32), strict=True)) for row in zip(*(group.column(c).to_pylist() for c in ("keys", "tags", "counts")), strict=True)]
        own, again, here = [p for p in parts if len(p[0]) and len(p[1])], [p[0] for p in parts if not len(p[1])], [p for p in parts if not len(p[0])]
        keys = np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in own), *again, *again])  # those that several rows have, twice
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        shared = np.zeros(len(keys), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        of = np.concatenate([np.zeros(0, np.int32), *(np.repeat(p[1], p[2]) for p in own)])
        return packed(*summed([of[shared[: len(of)]], *(p[1] for p in here)], [np.ones(int(shared[: len(of)].sum()), np.int64), *(p[2] for p in here)]))

    def summed(tags: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tags, counts = np.concatenate(tags), np.concatenate(counts)
        order = np.argsort(tags)
        new = np.flatnonzero(np.diff(tags[order], prepend=-1))
        return tags[order[new]], np.add.reduceat(counts[order], new) if len(new) else counts

    def packed(tags: np.ndarray, counts: np.ndarray) -> pa.Table:
        by, parts = parted(tags.astype(np.int64) % ranges)
        tags, counts = tags[by], counts[by].astype(np.int32)
        return pa.table({"part": pa.array([p for p, _, _ in parts], pa.int64()), "tags": pa.array([tags[i:j].tobytes() for _, i, j in parts], pa.binary()), "counts": pa.array([counts[i:j].tobytes() for _, i, j in parts], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        tags, counts = summed(*([np.frombuffer(x, np.int32) for x in group.column(c).to_pylist()] for c in ("tags", "counts")))
        return pa.table({"tag": pa.array(tags, pa.int32()), "hits": pa.array(counts, pa.int64())})

    dealt = rows.mapInArrow(scatter, "range long, keys binary, tags binary, counts binary")
    counted = dealt.groupBy("range").applyInArrow(judge, "part long, tags binary, counts binary")
    return counted.groupBy("part").applyInArrow(total, "tag int, hits long")


def map_suspects(rows: DataFrame, filled_from: DataFrame, keys_of: Callable, n_keys: int, suspects: Callable, schema: str, most_bits: int = 1 << 30) -> DataFrame:
    """``suspects(batch, has)`` over the batches of ``rows``, where ``has(keys)`` tells which uint64 keys two documents of
    ``filled_from`` may share.

    The size of a filter is known before it is built: ``most_bits`` (128 MiB by default) is the most that is broadcast. Where ``n_keys``
    would fill that too far, the filters are split by ranges of hashes (`shared_keys`), and a row's suspects come back to it by a join. Either way the texts are read
    a fixed number of times at any size of the input, and as few keys are let through.
    """
    bits = filter_bits(n_keys, most_bits)
    if n_keys * 4 <= bits:
        held = rows.sparkSession.sparkContext.broadcast(twice_filter(filled_from, keys_of, bits))

        def pick(batches):
            for b in batches_of(batches):
                yield suspects(b, held.value.has)

        return rows.mapInArrow(pick, schema)

    tagged = rows.withColumn("tag", F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)).cast("int"))
    back = shared_keys(tagged, keys_of, n_keys).withColumnRenamed("tag", "_tag")

    def look(batches):
        for b in batches_of(batches):
            found = [k for row in b.column("keys").to_pylist() if row for k in row]
            known = np.unique(np.frombuffer(b"".join(found), np.uint64))
            yield suspects(b, lambda keys, known=known: among(keys, known))

    return tagged.join(back, F.col("tag") == F.col("_tag"), "left").drop("_tag").mapInArrow(look, schema)


# --- connected components -------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps: each is a minimum by node and a join, so a node with very many
    neighbours is pre-aggregated before the shuffle and never gathered. Ends when the edges no longer change,
    after a number of rounds that grows with the logarithm of the longest path. Only the last round's files stay.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        before, now = now, written(small, "edges")
        discard(before)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
