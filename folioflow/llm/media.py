"""Media columns: chroma fingerprints of audio, and the alignment of recordings by them.

Frames of pitch-class energies become an integral image; rectangle filters over it, each quantized to two bits,
pack a stretch of audio into one 32-bit integer. Recordings that share integers are aligned by a histogram of
offsets and compared by the bits that differ at the best offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, written

FRAME, HOP = 1024, 512  # samples
SPAN = 16  # frames below one integer
BLOCK = 1 << 18  # samples that are transformed together
LONG = BLOCK  # recordings with more samples are transformed piece by piece
VOTES = 1 << 21  # that are counted together, and codes of queries that are broadcast together
#: Of each of the 16 filters: shape, lowest pitch class, height, width; by rule.
FILTERS = [(i % 6, 5 * i % 12 % (12 - 3 - i % 4), 4 + i % 4, 4 + 3 * i % (SPAN - 3)) for i in range(16)]
LEVELS = (-0.1, 0.0, 0.1)  # of a filter's value, between its four outcomes
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """(recordings, frames, 12) shares of energy by pitch class, of samples (recordings, samples)."""
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME, axis=1)[:, ::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=2)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (hz >= 60) & (hz <= min(3520, rate / 2))
    of = np.zeros((len(hz), 12), np.float32)
    of[np.flatnonzero(heard), np.round(12 * np.log2(hz[heard] / 440)).astype(int) % 12] = 1
    energy = power.astype(np.float32) @ of
    return energy / np.maximum(energy.sum(axis=2, keepdims=True), 1e-9)


def pack_filters(c: np.ndarray) -> np.ndarray:
    """(recordings, frames - SPAN + 1) uint32 from chroma, by rectangle sums of its integral image."""
    n, t, _ = c.shape
    image = np.zeros((n, t + 1, 13))
    image[:, 1:, 1:] = c.cumsum(axis=1).cumsum(axis=2)
    k = t - SPAN + 1
    at = lambda x, y: image[:, x : x + k, y]
    box = lambda x0, x1, y0, y1: at(x1, y1) - at(x0, y1) - at(x1, y0) + at(x0, y0)
    out = np.zeros((n, k), np.uint32)
    for shape, y, h, w in FILTERS:
        whole = box(0, w, y, y + h)
        if shape == 0:  # early against late
            part = box(0, w // 2, y, y + h)
        elif shape == 1:  # low against high
            part = box(0, w, y, y + h // 2)
        elif shape == 2:  # diagonal quarters against the others
            part = box(0, w // 2, y, y + h // 2) + box(w // 2, w, y + h // 2, y + h)
        elif shape == 3:  # middle against both sides, in time
            part = box(w // 3, w - w // 3, y, y + h)
        elif shape == 4:  # and in pitch
            part = box(0, w, y + h // 3, y + h - h // 3)
        else:  # against all other pitches
            part, whole = whole, box(0, w, 0, 12)
        value = np.log((1 + part) / (1 + np.maximum(whole - part, 0)))
        out = (out << np.uint32(2)) | _GRAY[np.digitize(value, LEVELS)]
    return out


def long_codes(x: np.ndarray, rate: int) -> Iterator[np.ndarray]:
    """The codes of a long recording, of LONG samples at a time: a block's frames go on SPAN - 1 beyond its own codes, so each code sees
    the same frames as in one piece."""
    codes = (len(x) - FRAME) // HOP + 1 - SPAN + 1
    step = max(1, (LONG - FRAME) // HOP)
    for a in range(0, codes, step):
        n = min(step, codes - a)
        part = x[a * HOP : (a + n + SPAN - 2) * HOP + FRAME]
        yield pack_filters(chroma(part[None].astype(np.float32), rate))[0].view(np.int32)


def fingerprints(media: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", rate: int = 4000) -> DataFrame:
    """(rec_id, codes array<int>) of every row with an id: packed integers of its 16-bit mono little-endian samples.
    Null audio, and audio shorter than SPAN frames, has no codes; an odd last byte is ignored."""
    rows = media.select(F.col(id_col).cast("long").alias("rec_id"), F.coalesce(F.col(pcm_col), F.lit(b"")).alias("pcm")).where("rec_id is not null")

    def codes(batches):
        for b in batches_of(batches, 128):
            each = [np.frombuffer(p, "<i2", len(p) // 2) for p in b.column("pcm").to_pylist()]
            out: list = [[]] * len(each)
            for i, x in enumerate(each):
                if len(x) > LONG:
                    out[i] = np.concatenate(list(long_codes(x, rate)))
            for size in {len(x) for x in each if len(x) <= LONG}:
                alike = [i for i, x in enumerate(each) if len(x) == size and (size - FRAME) // HOP + 1 >= SPAN]
                step = max(1, BLOCK // max(1, size))
                for at in (alike[k : k + step] for k in range(0, len(alike), step)):
                    for i, c in zip(at, pack_filters(chroma(np.stack([each[i] for i in at]).astype(np.float32), rate)).view(np.int32), strict=True):
                        out[i] = c
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(out, pa.list_(pa.int32()))], ["rec_id", "codes"])

    return rows.mapInArrow(codes, "rec_id long, codes array<int>")


class Asked:
    """Codes of a block of query recordings, sorted for look-up with the place of each."""

    def __init__(self, rows: list[tuple[int, int, list[int]]]):
        self.ids, self.own = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.codes = [np.array(r[2], np.int32) for r in rows]
        size = np.array([len(c) for c in self.codes], np.int64)
        flat = np.concatenate(self.codes)
        order = np.argsort(flat, kind="stable")
        self.sorted = flat[order]
        self.query = np.repeat(np.arange(len(rows)), size).astype(np.int32)[order]
        self.at = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)[order]
        self.longest = int(size.max())

    def best_offsets(self, codes: np.ndarray, least_hits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, offset) of the queries that have ``least_hits`` votes with the recording at some offset: the offset
        with most votes, of equal ones the smallest. Each place of a code in one votes with each place in the other."""
        lo, n = np.searchsorted(self.sorted, codes), np.searchsorted(self.sorted, codes, "right")
        n = n - lo
        wide, ends, keys, hits = self.longest + len(codes), np.cumsum(n), np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = 0
        while start < len(codes):  # few votes are held at a time, however often a code repeats
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + VOTES, "right")))
            m = n[start:stop]
            place = np.repeat(lo[start:stop] - np.cumsum(m) + m, m) + np.arange(m.sum())
            key = self.query[place].astype(np.int64) * wide + (np.repeat(np.arange(start, min(stop, len(codes))), m) - self.at[place] + self.longest)
            key, count = np.unique(key, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
            hits, start = np.bincount(back, np.concatenate([hits, count]), len(keys)).astype(np.int64), stop
        keys, hits = keys[hits >= least_hits], hits[hits >= least_hits]
        query = keys // wide
        order = np.lexsort((keys, -hits, query))
        first = order[np.flatnonzero(np.diff(query[order], prepend=-1))]
        return query[first], keys[first] % wide - self.longest


def align_recordings(prints: DataFrame, queries, least_hits: int = 2, most_errors: float = 0.1, least_aligned: int = 24, block: int = VOTES) -> DataFrame:
    """(match, copies, query, offset, aligned, bit_errors): a row for each distinct fingerprint and each query recording
    that it aligns with (``queries``: a condition on rec_id); one with nulls where none does.

    Equal fingerprints are one class, named by its smallest id, with ``copies`` members; so copies make no pairs.
    A class with queries asks once, under the smallest of their ids. Every place of a code in a recording votes with
    every place of it in every query, for the query and the offset between both. Offsets with ``least_hits`` votes are
    candidates, for each query the one with most (of equal ones the smallest); they are kept if at least
    ``least_aligned`` codes face each other there and at most the share ``most_errors`` of their bits differ.
    Queries align with themselves and are left out with their own class. Recordings without codes
    align with nothing; ids given twice count once a fingerprint.

    Queries come in blocks of about ``block`` codes (by hashed id); each is broadcast and meets all classes where
    they are, so votes are counted recording by recording and none is shuffled, whatever codes are frequent.
    """
    return _pairs(_classes(prints, queries), least_hits, most_errors, least_aligned, block)


def search_recordings(prints: DataFrame, queries, least_hits: int = 2, most_errors: float = 0.1, least_aligned: int = 24, block: int = VOTES) -> DataFrame:
    """(kind, rec_id, class_id, is_query, copies, query, offset, aligned, bit_errors) of all recordings, in two kinds of rows.

    ``member``: each row of ``prints``, with the class of its fingerprint and whether it is a query itself; without codes it
    has no class. ``pair``: each class (rec_id and class_id are its name) and each query it aligns with as in
    `align_recordings`, and the query's own class at offset 0 without errors. The query stands for all queries of
    its class, which the members name; so copies make rows in proportion to their number, not to pairs of them.
    """
    every = written(prints.withColumn("is_query", F.coalesce(queries, F.lit(False))), "recordings")
    classes = _classes(every, F.col("is_query"))
    names = classes.select("codes", F.col("id").alias("class_id"), "copies")
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("query", "long"), ("offset", "int"), ("aligned", "int"), ("bit_errors", "double"))]
    bare = every.where(F.size("codes") == 0).select("rec_id", F.lit(None).cast("long").alias("class_id"), "is_query", F.lit(None).cast("long").alias("copies"))
    members = every.where(F.size("codes") > 0).join(names, "codes").select("rec_id", "class_id", "is_query", "copies").unionByName(bare).select(F.lit("member").alias("kind"), "*", *nulls)
    others = _pairs(classes, least_hits, most_errors, least_aligned, block).where("query is not null")
    own = classes.where("asked is not null").select(F.col("id").alias("match"), "copies", F.col("asked").alias("query"), F.lit(0).alias("offset"), F.size("codes").alias("aligned"), F.lit(0.0).alias("bit_errors"))
    asks = F.lit(None).cast("boolean").alias("is_query")
    return members.unionByName(own.unionByName(others).select(F.lit("pair").alias("kind"), F.col("match").alias("rec_id"), F.col("match").alias("class_id"), asks, "copies", "query", "offset", "aligned", "bit_errors"))


def _classes(prints: DataFrame, queries) -> DataFrame:
    some = prints.where(F.size("codes") > 0).withColumn("asked", F.when(queries, F.col("rec_id")))
    return written(some.groupBy("codes").agg(F.min("rec_id").alias("id"), F.countDistinct("rec_id").alias("copies"), F.min("asked").alias("asked")), "prints")


def _pairs(classes: DataFrame, least_hits: int, most_errors: float, least_aligned: int, block: int) -> DataFrame:
    spark = classes.sparkSession
    asked = classes.where("asked is not null").select("asked", "id", "codes")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("codes"))).first()[0] or 0) // block))
    schema = "match long, query long, offset int, aligned int, bit_errors double"
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == k).collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast(Asked(sorted((r.asked, r.id, r.codes) for r in rows)))

        def align(batches, held=held):
            q = held.value
            for b in batches_of(batches, 128):
                out: list[tuple] = []
                for name, m in zip(b.column("id").to_pylist(), b.column("codes"), strict=True):
                    m = m.values.to_numpy()
                    for i, offset in zip(*(x.tolist() for x in q.best_offsets(m, least_hits)), strict=True):
                        start = max(-offset, 0)
                        aligned = min(len(q.codes[i]) - start, len(m) - start - offset)
                        if q.own[i] == name or aligned < least_aligned:
                            continue
                        wrong = int(np.bitwise_count((q.codes[i][start : start + aligned] ^ m[start + offset : start + offset + aligned]).view(np.uint32)).sum())
                        if wrong / (32 * aligned) <= most_errors:
                            out.append((name, int(q.ids[i]), offset, aligned, wrong / (32 * aligned)))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["match", "query", "offset", "aligned", "bit_errors"])

        found = found.unionByName(classes.select("id", "codes").mapInArrow(align, schema))
    every = classes.select(F.col("id").alias("match"), "copies").join(found, "match", "left")
    return every.select("match", "copies", "query", "offset", "aligned", "bit_errors")


def render(vectors: DataFrame, id_col: str, vector_col: str, rate: int = 4000, step: int = 512) -> DataFrame:
    """(rec_id, pcm): a recording made of each vector, a stand-in for audio where a table has none. Step t sounds the
    twelve tones of an octave, as loud as the components from t on are high; so near vectors sound alike.
    Null and empty vectors are without samples."""
    rows = vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.coalesce(F.col(vector_col).cast("array<float>"), F.array().cast("array<float>")).alias("v"))

    def sound(batches):
        tones = np.sin(2 * np.pi * 440 * 2 ** (np.arange(12) / 12)[:, None] * np.arange(step) / rate)
        for b in batches_of(batches, 128):
            out = []
            for v in b.column("v").to_pylist():
                v = np.nan_to_num(np.array([x or 0.0 for x in v], np.float64))
                loud = np.clip(v / (v.std() or 1.0) + 2.5, 0, 5) if len(v) else v
                chords = loud[(np.arange(len(v))[:, None] + np.arange(12)) % max(1, len(v))]
                out.append((500 * (chords @ tones)).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(out, pa.binary())], ["rec_id", "pcm"])

    return rows.mapInArrow(sound, "rec_id long, pcm binary")
