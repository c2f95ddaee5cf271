"""Language-model scores from a Bloom filter of logarithmic frequencies.

N-grams of all learning documents are counted exactly; an n-gram of the count c is put into a Bloom filter once for each level of counts
up to c (levels grow by a fixed ratio). So probing a filter for level after level, until one misses, gives
an n-gram's count to within that ratio, and no n-gram is stored. The filter is broadcast; its size has a bound. Where that is too small for
all levels, the counts of the lowest ones stay in a table, and each text gets those of its own n-grams by a join.
A token's probability mixes the counts of all orders: p(w | h) = (c(hw) + k p(w | shorter h)) / (c(h) + k).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batches_of, written
from .jaccard import _mix

RATIO = 1.25  # of counts from level to level
PRIORS = (100.0,)  # k of order 2 and on: as many as there are, so many orders
PROBES = 4  # bits of an entry
ROOM = 8  # bits that an entry has to itself, at least
BLOCK = 1 << 16  # bits: all entries of an n-gram lie in one block
SPAN = 16  # blocks that are filled together
HOT = 1_000_000  # words that have a millionth of all words each, so no more than that
SAMPLE = 64  # one n-gram in so many (by hash) is counted to see how many there are of each level
FLUSH = 1 << 20  # distinct words, or twice as many n-grams, that a task counts before it passes them on
END = b""  # no word is empty
PIECE = 1 << 16  # bytes that are hashed together, so that they stay in the cache
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BEGIN, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x8F3B2C6D51E7A049)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse
_POWERS, _INVERSE = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * _B)  # of each byte; white space adds nothing to a word
_LETTERS[list(BLANKS.encode())] = 0
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z
_INK = _LETTERS != 0


def level_bounds(ratio: float = RATIO) -> np.ndarray:
    """The least count of each level; the first few levels are single counts."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def level_values(bounds: np.ndarray) -> np.ndarray:
    """The count that a level (from 0, for none) stands for: the geometric mean of its ends."""
    return np.concatenate([[0.0], np.sqrt(bounds[:-1].astype(float) * (bounds[1:] - 1)), [float(bounds[-1])]])


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each key; blocks are in the order of keys."""
    return (keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)


class LogFrequencyFilter:
    """Levels of uint64 keys. Levels below ``least`` aren't held: a key of a lower level is as one that never came, unless `Low` has it."""

    def __init__(self, field: np.ndarray, least: int):
        self.field, self.least, self.blocks = field, least, len(field) * 8 // BLOCK

    @staticmethod
    def places(keys: np.ndarray, level: np.ndarray | int) -> Iterator[np.ndarray]:
        """Of an entry, the bits within its key's block."""
        h = _mix(keys ^ (np.asarray(level, np.uint64) * _B))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) & np.uint64(BLOCK - 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, active, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), self.least
        start = _block(keys, self.blocks) * np.uint64(BLOCK)
        while len(active) and level < 400:
            hit = np.ones(len(active), bool)
            for at in self.places(keys[active], level):
                at = at + start[active]
                hit &= (self.field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            active = active[hit]
            out[active] = level
            level += 1
        return out


class Low:
    """Levels of keys that a filter doesn't hold: sorted keys and the level of each."""

    def __init__(self, found: pa.Array):
        """``found``: lists of (key, level), null for none."""
        each = found.flatten()
        self.keys, first = np.unique(each.field("key").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
        self.level = each.field("level").to_numpy(zero_copy_only=False)[first]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.level[at], 0)


def _spell(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64 bits of each word: the sum of its letters' numbers times powers of a base, by sums over pieces of many words."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, side="right")))
        a, b = int(starts[at]), int(stops[to - 1])
        if b - a > PIECE:  # a word of several pieces
            parts = (int((_LETTERS[data[i : min(b, i + PIECE)]] * _POWERS[: min(b - i, PIECE)]).sum()) * pow(_BASE, i - a, 1 << 64) for i in range(a, b, PIECE))
            out[at] = np.uint64(sum(parts) % (1 << 64))
        else:
            off = starts[at:to] - a
            out[at:to] = np.add.reduceat(_LETTERS[data[a:b]] * _POWERS[: b - a], off) * _INVERSE[off]
        at = to
    return _mix(out)


class Words:
    """The words of some texts, one text after another: ``h`` has their hashes, ``n`` how many each text has. Nothing is done word by word in Python."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = self.data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        ink = _INK[data]
        begin, finish = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1]
        finish[:-1] &= ~ink[1:]
        cut = ends[(ends > 0) & (ends < len(ink))]  # texts that meet here share no word
        begin[cut] = ink[cut]
        finish[cut - 1] = ink[cut - 1]
        self.starts, self.stops = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.n = np.diff(np.searchsorted(self.starts, ends))
        self.h = _spell(data, self.starts, self.stops)

    def spelt(self, which: np.ndarray) -> pa.Array:
        """Words by their numbers, A-Z lower-cased; END for those beyond the last."""
        offsets = np.full(2 * len(self.starts) + 2, len(self.data), np.int64)  # of words and of what lies between them, and nothing at the end
        offsets[:-2:2], offsets[1:-2:2] = self.starts, self.stops
        each = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(self.data.tobytes().lower())])
        return each.take(pa.array(2 * np.minimum(which, len(self.starts)))).cast(pa.binary())

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """See `sequences`."""
        return _laid(self.h, self.n)


def _hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words and ENDs."""
    some = np.fromiter(map(bool, words), bool, len(words))
    out = np.full(len(words), _END)
    if some.any():
        out[some] = Words(pa.array([w for w in words if w], pa.binary())).h
    return out


def _words(text: str) -> list[bytes]:
    """What `Words` finds, of one text."""
    return text.encode().lower().split()  # of bytes: A-Z alone, and ASCII white space


def _laid(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = n.astype(np.int64) + 2
    ends = np.cumsum(sizes)
    h = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    place = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
    inside = np.ones(len(h), bool)
    inside[ends - sizes] = inside[ends - 1] = False
    h[inside] = words
    h[ends - sizes], h[ends - 1] = _BEGIN, _END
    return h, place


def sequences(each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of documents' words, each document between a begin and an end, one after another; places in the document."""
    return _laid(_hashed([x for w in each for x in w]), np.array([len(w) for w in each], np.int64))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in order, where one of each is, and each one's place among them."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    index = order[new]
    return x[index], index, back


def word_keys(h: np.ndarray) -> np.ndarray:
    """The keys of single words, by their hashes."""
    return _mix(h + np.uint64(1))


def ngram_keys(h: np.ndarray, place: np.ndarray, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (keys of the n-grams that end at each place, whether there is one)."""
    out, key = [], h
    for m in range(1, orders + 1):
        if m > 1:
            key = np.concatenate([np.zeros(1, np.uint64), key[:-1]]) * _A + h if len(h) else h
        out.append((_mix(key + np.uint64(m)), place >= max(1, m - 1)))
    return out


class Model:
    """What scoring needs, of a bounded size: the filter, the numbers of learning documents, tokens and distinct ones, and the frequent words' counts."""

    def __init__(self, held: Broadcast, n_docs: int, n_tokens: int, n_types: int, hot: Broadcast, priors: tuple[float, ...], ratio: float):
        self.held, self.n_docs, self.n_tokens, self.n_types, self.hot, self.priors = held, n_docs, n_tokens, n_types, hot, priors
        self.values = level_values(level_bounds(ratio))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n_tokens + 0.5 * (self.n_types + 1)))

    def levels(self, keys: np.ndarray, low: Low | None) -> np.ndarray:
        out = self.held.value.levels(keys)
        return out if low is None else np.where(out > self.held.value.least, out, low.levels(keys))

    def unheld(self, h: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, each one's document, from 0) that the filter hasn't got or has at its lowest level, where a false answer weighs most, of words that are not among the frequent ones and of n-grams; once a document."""
        doc = np.cumsum(place == 0) - 1
        for m, (keys, there) in enumerate(ngram_keys(h, place, len(self.priors) + 1), 1):
            there = there & ~np.isin(h, self.hot.value[0]) if m == 1 else there
            some, again = np.unique(keys[there], return_inverse=True)
            missed = (self.held.value.levels(some) <= self.held.value.least)[again]
            each = np.unique(doc[there][missed] * max(1, len(some)) + again[missed])
            yield some[each % max(1, len(some))], each // max(1, len(some))

    def score(self, h: np.ndarray, place: np.ndarray, words: tuple[np.ndarray, np.ndarray], at: np.ndarray, found: np.ndarray, low: Low | None = None) -> np.ndarray:
        """log10 of each token's probability; 0 at begins. ``words`` are the distinct hashes of ``h`` and each one's place among them, ``at`` their places
        among the frequent words, if they are ``found`` there: these have their levels, once for all. ``low`` has what the filter hasn't got."""
        values = self.values
        distinct, back = words
        count = np.where(found, self.hot.value[2][at] if len(at) and len(self.hot.value[2]) else 0.0, 0.0)
        rare = ~found
        count[rare] = values[self.levels(word_keys(distinct[rare]), low)]
        shorter = count[back]
        p = (shorter + 0.5) / (self.n_tokens + 0.5 * (self.n_types + 1))
        shorter[place == 0] = self.n_docs
        for k, (keys, there) in zip(self.priors, ngram_keys(h, place, len(self.priors) + 1)[1:], strict=True):
            some, _, again = _distinct(keys[there])
            count = np.zeros(len(h))
            count[there] = values[self.levels(some, low)][again]
            of = np.maximum(np.concatenate([[0.0], shorter[:-1]]), count)  # counts are rough: no n-gram is more frequent than its context
            p[there] = ((count + k * p) / (of + k))[there]
            shorter = count
        p[place == 0] = 1.0
        return np.log10(p)


def learn(docs: DataFrame, learns: Column, priors: tuple[float, ...] = PRIORS, ratio: float = RATIO, most_bits: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the documents for which ``learns`` is true, and the words (token, n, c) that are not among the frequent ones: n in all
    documents, c in those. See `fit`."""
    return fit(docs, learns, priors, ratio, most_bits, id_col, text_col)[:2]


def fit(docs: DataFrame, learns: Column, priors: tuple[float, ...] = PRIORS, ratio: float = RATIO, most_bits: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame, DataFrame | None]:
    """`learn`, with the n-grams (key, level) that the filter has no room for and those of the lowest level in it, or none if it holds all.

    All documents' counts are exact. The filter has at most ``most_bits`` (128 MiB): if the n-grams of all levels need more, the
    lowest levels are left out of it, as few as possible, and are written as a table. Words are n-grams too.
    """
    rows = _rows(docs, learns, id_col, text_col)
    orders, bounds = len(priors) + 1, level_bounds(ratio)

    def count(batches):
        """Words, and of one n-gram in SAMPLE how often it comes."""
        held, sampled, size, docs, learned = [], [np.zeros(0, np.uint64)], 0, 0, 0
        for b in batches_of(batches):
            words, yes = Words(b.column("text")), b.column("learns").to_numpy(zero_copy_only=False).astype(bool)
            some, index, back = _distinct(words.h)
            held.append((some, words.spelt(index), np.bincount(back, minlength=len(some)), np.bincount(back[np.repeat(yes, words.n)], minlength=len(some))))
            docs, learned = docs + len(yes), learned + int(yes.sum())
            h, place = words.sequences()
            of_learned = np.repeat(yes, words.n + 2)
            sampled += [keys[there & of_learned & (keys % np.uint64(SAMPLE) == 0)] for keys, there in ngram_keys(h, place, orders)[1:]]
            size += len(some) + sum(map(len, sampled[1 - orders :]))
            if size > FLUSH:
                yield _counted(held, sampled, docs, learned)
                held, sampled, size, docs, learned = [], [np.zeros(0, np.uint64)], 0, 0, 0
        if docs:
            yield _counted(held, sampled, docs, learned)

    counted = rows.select("text", "learns").mapInArrow(count, "token binary, key long, n long, c long").groupBy("token", "key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    counted = written(counted, "tokens")
    tokens = counted.where("token is not null").drop("key")
    n_all, n_tokens, n_types, n_docs = tokens.agg(F.sum("n"), F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("token") == F.lit(END), F.col("c")))).first()
    n_all, n_tokens, n_types, n_docs = (int(x or 0) for x in (n_all, n_tokens, n_types, n_docs))
    bar = max(1, -(-n_all // HOT))

    def shorten(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashed(b.column("token").to_pylist()).view(np.int64)), b.column("c")], ["h", "c"])

    hot = tokens.where(F.col("n") >= bar).select("token", "c").mapInArrow(shorten, "h long, c long").toArrow()  # a million rows of 16 bytes at most
    h, c = (hot.column(x).to_numpy().astype(np.int64) for x in ("h", "c"))
    order = np.argsort(h.view(np.uint64))
    h, c = h.view(np.uint64)[order], c[order]

    level = F.size(F.filter(F.array(*map(F.lit, bounds[:120].tolist())), lambda x: x <= F.col("n")))  # counts up to 10^10
    spread = Counter()
    for some, times in ((counted.where("token is null"), SAMPLE), (tokens.where("c > 0").withColumn("n", F.col("c")), 1)):
        for r in some.groupBy(level.alias("level")).agg(F.count("*").alias("many")).collect():  # a row a level
            spread[r["level"]] += r["many"] * times
    least = 1
    while (entries := sum(n * (x - least + 1) for x, n in spread.items() if x >= least)) * ROOM > most_bits:
        least += 1
    blocks = max(1, min(most_bits // BLOCK, -(-entries * 10 // BLOCK)))

    def passed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Sorted keys and their counts: a row a key if some are kept in a table, else a row for all of a span of blocks."""
        if least > 1:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])
        span = (_block(keys, blocks) // np.uint64(SPAN)).astype(np.int64)
        edges = np.flatnonzero(np.diff(span, prepend=-1))
        offsets = pa.py_buffer(np.append(edges, len(keys)).astype(np.int32) * np.int32(8))
        lists = (pa.Array.from_buffers(pa.binary(), len(edges), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (keys, n.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(span[edges]), *lists], ["span", "keys", "n"])

    def gather(batches):
        held, size = [], 0
        for b in batches_of(batches):
            held += [keys[there] for keys, there in ngram_keys(*Words(b.column("text")).sequences(), orders)[1:]]
            size += sum(map(len, held[1 - orders :]))
            if size > 2 * FLUSH:
                yield passed(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield passed(*np.unique(np.concatenate(held), return_counts=True))

    def single(batches):
        held, size = [], 0
        for b in batches:
            held.append((word_keys(_hashed(b.column("token").to_pylist())), b.column("c").to_numpy()))
            size += b.num_rows
            if size > 2 * FLUSH:
                yield passed(*_summed(*map(np.concatenate, zip(*held, strict=True))))
                held, size = [], 0
        if held:
            yield passed(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    def filled(keys: np.ndarray, n: np.ndarray, first: int, many: int) -> pa.Table:
        field, levels = np.zeros(many * BLOCK // 8, np.uint8), np.searchsorted(bounds, n, side="right")
        start = (_block(keys, blocks) - np.uint64(first)) * np.uint64(BLOCK)
        for x in range(least, int(levels.max(initial=0)) + 1):
            some = levels >= x
            for at in LogFrequencyFilter.places(keys[some], x):
                at = at + start[some]
                np.bitwise_or.at(field, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return pa.table({"block": pa.array([first], pa.int64()), "field": pa.array([field.tobytes()], pa.binary())})

    def fill(group: pa.Table) -> pa.Table:
        return filled(group.column("key").to_numpy().view(np.uint64), group.column("n").to_numpy(), group.column("block")[0].as_py(), 1)

    def fill_span(group: pa.Table) -> pa.Table:
        keys, n = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group.column(c)]) for c, t in (("keys", np.uint64), ("n", np.int64)))
        first = group.column("span")[0].as_py() * SPAN
        return filled(*_summed(keys, n), first, min(SPAN, blocks - first))

    what = "key long, n long" if least > 1 else "span long, keys binary, n binary"
    every = rows.where("learns").select("text").mapInArrow(gather, what).unionByName(tokens.where("c > 0").select("token", "c").mapInArrow(single, what))
    low = None
    if least > 1:
        block = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * F.lit(blocks), 32)
        summed = written(every.repartition(block).withColumn("block", block).groupBy("block", "key").agg(F.sum("n").alias("n")), "counts")  # one shuffle, for counts and blocks
        low = summed.where(F.col("n") < int(bounds[least])).select("key", level.alias("level"))
        parts = summed.where(F.col("n") >= int(bounds[least - 1])).groupBy("block").applyInArrow(fill, "block long, field binary")
    else:
        parts = every.groupBy("span").applyInArrow(fill_span, "block long, field binary")
    field = np.zeros(blocks * BLOCK // 8, np.uint8)
    got = parts.toArrow()  # most_bits / 8 bytes at most
    for number, bits in zip(got.column("block").to_pylist(), got.column("field"), strict=True):
        field[number * BLOCK // 8 :][: len(bits.as_buffer())] = np.frombuffer(bits.as_buffer(), np.uint8)
    held = LogFrequencyFilter(field, least)
    probed = held.levels(word_keys(h))
    hot_counts = h, c, level_values(bounds)[np.where(probed > 0, probed, np.searchsorted(bounds, c, side="right"))]
    sc = docs.sparkSession.sparkContext
    return Model(sc.broadcast(held), n_docs, n_tokens, n_types, sc.broadcast(hot_counts), priors, ratio), tokens.where(F.col("n") < bar), low


def _rows(docs: DataFrame, learns: Column, id_col: str, text_col: str) -> DataFrame:
    own = docs.withColumn("_folioflow_learns", F.coalesce(learns, F.lit(False)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return own.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"), F.col("_folioflow_learns").alias("learns"))


def _counted(held: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]], sampled: list[np.ndarray], docs: int, learned: int) -> pa.RecordBatch:
    """Words and ends with their numbers in all documents and in learning ones, then sampled n-grams with theirs in learning ones."""
    some, index, back = _distinct(np.concatenate([x[0] for x in held]))
    n, c = (np.bincount(back, np.concatenate([x[k] for x in held]), len(some)).astype(np.int64) for k in (2, 3))
    keys, times = np.unique(np.concatenate(sampled), return_counts=True)
    tokens = [pa.concat_arrays([x[1] for x in held]).take(pa.array(index)), pa.array([END], pa.binary()), pa.nulls(len(keys), pa.binary())]
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays(tokens),
        pa.array(np.concatenate([np.zeros(len(some) + 1, np.int64), keys.view(np.int64)])),
        pa.array(np.concatenate([n, [docs], times])),
        pa.array(np.concatenate([c, [learned], times])),
    ], ["token", "key", "n", "c"])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, _, back = _distinct(keys)
    return some, np.bincount(back, n, len(some)).astype(np.int64)


def score_texts(docs: DataFrame, learns: Column, priors: tuple[float, ...] = PRIORS, ratio: float = RATIO, most_bits: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, learns, n_tokens, n_known, train_tokens, base_score, score) for every row: its tokens are its words (A-Z lower-cased, between
    ASCII white space) and one end; n_known of them came in a learning document. base_score is exact: the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens, c being a token's count in learning documents, N all of them, V distinct ones. score is the
    model's log10 probability of the text.

    Null and empty texts have the end alone. Rows that repeat count again each time they come; rows with a null id are scored like others.
    ``learns`` is over the columns of ``docs``; null is false. Without learning documents all tokens are alike.
    """
    model, rare, low = fit(docs, learns, priors, ratio, most_bits, id_col, text_col)
    names = ["doc_id", "rid", "learns", "n_tokens", "hot_known", "hot_base", "score", "cold"]

    def judge(batches):
        hot, count, _ = model.hot.value
        for b in batches_of(batches):
            words = Words(b.column("text"))
            seq, place = words.sequences()
            starts = np.flatnonzero(place == 0)
            distinct, _, back = _distinct(seq)
            at = np.minimum(np.searchsorted(hot, distinct), max(0, len(hot) - 1))
            found = hot[at] == distinct if len(hot) else np.zeros(len(distinct), bool)
            c = np.where(found, count[at] if len(hot) else 0, 0)
            token = place > 0
            is_hot = found[back] & token
            base = np.add.reduceat(np.where(is_hot, model.base(c)[back], 0.0), starts)
            known = np.add.reduceat((is_hot & (c[back] > 0)).astype(np.int64), starts)
            cold = np.flatnonzero(token & ~is_hot)
            doc = np.repeat(np.arange(len(starts)), words.n + 2)[cold]
            own, first, again = _distinct(doc * len(distinct) + back[cold])  # a document's cold words, each once
            of, which = doc[first], cold[first]
            which = np.where(seq[which] == _END, len(words.h), which - 2 * of - 1)
            each = pa.StructArray.from_arrays([words.spelt(which), pa.array(np.bincount(again, minlength=len(own)), pa.int64())], ["token", "tf"])
            cold = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(starts) + 1)), pa.int32()), each)
            more = Low(b.column("low")) if "low" in b.schema.names else None
            score = np.add.reduceat(model.score(seq, place, (distinct, back), at, found, more), starts)
            n = words.n.astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), b.column("learns"), *map(pa.array, (n, known, base, score)), cold], names)

    def ask(batches):
        for b in batches_of(batches):
            rid = b.column("rid").to_numpy()
            for keys, doc in model.unheld(*Words(b.column("text")).sequences()):
                yield pa.RecordBatch.from_arrays([pa.array(rid[doc]), pa.array(keys.view(np.int64))], ["rid", "key"])

    rows = _rows(docs, learns, id_col, text_col)
    if low is not None:  # each text gets the counts of its own n-grams that the filter hasn't got
        met = rows.select("rid", "text").mapInArrow(ask, "rid long, key long").join(low, "key").groupBy("rid").agg(F.collect_set(F.struct("key", "level")).alias("low"))
        rows = rows.join(written(met, "low"), "rid", "left")
    scored = written(rows.mapInArrow(judge, "doc_id long, rid long, learns boolean, n_tokens long, hot_known long, hot_base double, score double, cold array<struct<token:binary,tf:bigint>>"), "scored")
    each = scored.select("doc_id", "rid", F.explode("cold").alias("x")).select("doc_id", "rid", "x.token", "x.tf")
    met = each.join(rare.select("token", "c"), "token").groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("token", "tf", "c"))).alias("x"))
    whole = F.lit(model.n_tokens + 0.5 * (model.n_types + 1))
    zero = F.struct(F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"))
    add = lambda s, x: F.struct((s["known"] + F.when(x["c"] > 0, x["tf"]).otherwise(F.lit(0).cast("long"))).alias("known"), (s["base"] + x["tf"] * F.log10((x["c"] + 0.5) / whole)).alias("base"))
    met = met.select(F.col("doc_id").alias("c_doc"), F.col("rid").alias("c_rid"), F.aggregate("x", zero, add).alias("s"))
    out = scored.drop("cold").join(met, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("rid") == F.col("c_rid")), "left")
    zeros = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return out.select("doc_id", "learns", "n_tokens", (F.col("hot_known") + zeros("s.known", 0)).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("hot_base") + zeros("s.base", 0.0)).alias("base_score"), "score")
