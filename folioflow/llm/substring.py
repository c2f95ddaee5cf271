"""Substring dedup by repeated-phrase automata.

A phrase is a window of consecutive words. Windows are dealt by their minimizer (the least hash of their short
word n-grams): neighbouring windows mostly share it, and equal windows always do. Once/twice Bloom filters find
minimizers that several documents have; only the segments around those are shuffled. Phrases that recur are
confirmed from digests, compiled into one Aho-Corasick automaton for each shard of minimizers, and the shard's
segments of all documents are streamed through it, which locates every occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, join_first, map_suspects, texts, written
from .jaccard import _mix

GRAM = 5  # words of the n-grams whose least hash is a window's minimizer
SHARD = 20_000  # segments of a task
ALL = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # of bytes: at space and U+0009..U+000D


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * by + h[i : len(h) - n + 1 + i]
    return _mix(out)


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Of each window of ``window`` words (at least one)."""
    grams = _rolled(h, min(GRAM, window), _A)
    out = grams[: len(h) - window + 1].copy()
    for i in range(1, window - min(GRAM, window) + 1):
        np.minimum(out, grams[i : i + len(out)], out=out)
    return out


def copies(rows: DataFrame) -> DataFrame:
    """(doc_id, rid) of documents whose whole text a smaller id has too."""
    each = written(rows.select("doc_id", "rid", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")), "digests")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    return join_first(each, written(first, "firsts"), "digest").where("doc_id > first").select("doc_id", "rid").distinct()


def segments(docs_rows: DataFrame, window: int, most_bits: int = 1 << 30) -> DataFrame:
    """(m, doc_id, rid, start, words string): each run of a document's windows with one minimizer that other
    documents seem to have, from word ``start``, words joined by one space."""
    n = docs_rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def keys(batch):
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            yield np.unique(minimizers(_hashed(words), window)) if len(words) >= window else np.zeros(0, np.uint64)

    def cut(b, has):
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, rid, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True):
            words = words_of(text)
            if len(words) < window:
                continue
            m = minimizers(_hashed(words), window)
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            last = np.append(first[1:], len(m))
            kept = has(m[first])
            first, last = first[kept], last[kept]
            for i, j, key in zip(first.tolist(), last.tolist(), m[first].view(np.int64).tolist(), strict=True):
                for column, x in zip(out, (key, doc_id, rid, i, b" ".join(words[i : j + window - 1])), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary()).cast(pa.string())], ["m", "doc_id", "rid", "start", "words"])

    return map_suspects(docs_rows, docs_rows.select("text"), keys, n // 36, cut, "m long, doc_id long, rid long, start long, words string", most_bits)


def _windows(each: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments: two digests of each window, its segment's number and its place there."""
    sizes = np.array([len(w) for w in each], np.int64)
    h = _hashed([x for w in each for x in w])
    one, two = _rolled(h, window, _A), _rolled(_mix(h ^ _B), window, _B)
    seg = np.repeat(np.arange(len(each)), sizes)[: len(one)]
    at = np.arange(len(one)) - (np.cumsum(sizes) - sizes)[seg]
    whole = at <= sizes[seg] - window
    return one[whole], two[whole], seg[whole], at[whole]


def digests(found: DataFrame, window: int, *columns: str) -> DataFrame:
    """(one, two and ``columns``, which are longs) of each window of segments: two digests of its words' 64-bit hashes. The automaton decides by the words."""

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            one, two, seg, _ = _windows([w.encode().split(b" ") for w in b.column("words").to_pylist()], window)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(b.column(c).to_numpy()[seg]) for c in columns)], ["one", "two", *columns])

    return found.select(*columns, "words").mapInArrow(each, "one long, two long, " + ", ".join(f"{c} long" for c in columns))


def recurring(found: DataFrame, window: int) -> DataFrame:
    """(m, one, two, first): windows of segments that at least two document ids have, with the smallest id. Minima
    are taken before the shuffle, so a phrase of very many documents is no hot key."""
    each = digests(found, window, "m", "doc_id")
    return each.groupBy("m", "one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")


def _sign(n: int) -> str:
    return chr(n if n < 0xD800 else n + 0x800)  # no surrogates; a shard has far fewer words than there are signs


def occurrences(found: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """(doc_id, rid, start, end): the words that ``phrases`` of smaller ids cover, one row for each run.

    Shards are ranges of minimizers' hashes, as many as there are segments for. A shard with more segments than
    a task takes is dealt over several tasks by document, each with an automaton of those phrases of the shard that
    its own segments have.
    """
    shards = max(1, -(-found.count() // SHARD))
    shard = F.pmod(F.xxhash64("m"), F.lit(shards)).cast("int")
    sizes = found.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))
    parts = written(sizes.select("shard", F.ceil(F.col("n") / (2 * SHARD)).cast("int").alias("parts")), "shards")
    part = F.pmod(F.xxhash64("doc_id", "rid"), F.col("parts"))
    cut = found.withColumn("shard", shard).join(parts, "shard").withColumn("part", part.cast("int")).drop("parts")
    known = phrases.withColumn("shard", shard).join(parts, "shard")
    hot = digests(cut.join(parts.where("parts > 1").select("shard"), "shard", "left_semi").withColumn("at", F.col("part").cast("long")), window, "m", "at").distinct()
    hot = known.where("parts > 1").join(hot, ["m", "one", "two"]).withColumn("part", F.col("at").cast("int"))
    known = known.where("parts = 1").withColumn("part", F.lit(0)).drop("parts").unionByName(hot.drop("parts", "at"))

    def locate(segs: pa.Table, known: pa.Table) -> pa.Table:
        import ahocorasick

        names = ["doc_id", "rid", "start", "end"]
        none = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not known.num_rows or not segs.num_rows:
            return none
        segs = segs.filter(pc.is_in(segs.column("m"), pc.unique(known.column("m"))))  # others have no phrase
        if not segs.num_rows:
            return none
        each = [w.encode().split(b" ") for w in segs.column("words").to_pylist()]
        one, two, seg, at = _windows(each, window)
        ones, twos, firsts = (known.column(c).to_numpy() for c in ("one", "two", "first"))
        order = np.lexsort((twos, ones))
        key = np.dtype([("one", np.int64), ("two", np.int64)])
        index = np.rec.fromarrays([ones[order], twos[order]], dtype=key)
        asked, place = np.unique(np.rec.fromarrays([one.view(np.int64), two.view(np.int64)], dtype=key), return_index=True)
        found = np.minimum(np.searchsorted(index, asked), len(index) - 1)
        here = index[found] == asked  # phrases whose words are here
        if not here.any():
            return none
        # each distinct word of the shard is one sign of the automaton's alphabet; sign 0 stands between segments
        signs: dict[bytes, str] = {}
        said = ["".join([signs.get(x) or signs.setdefault(x, _sign(len(signs) + 1)) for x in w]) for w in each]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i, first in zip(seg[place[here]].tolist(), at[place[here]].tolist(), firsts[order][found[here]].tolist(), strict=True):
            automaton.add_word(said[s][i : i + window], first)
        automaton.make_automaton()
        starts = np.cumsum([0, *(len(x) + 1 for x in said)])
        matches = np.array(list(automaton.iter("\0".join(said))), np.int64).reshape(-1, 2)
        of = np.searchsorted(starts, matches[:, 0], side="right") - 1
        later = matches[:, 1] < segs.column("doc_id").to_numpy()[of]
        of, end = of[later], (matches[:, 0] - starts[of])[later] + 1
        if not len(of):
            return none
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (end[1:] - end[:-1] > window)])  # runs of covered words
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(of)) - 1
        rows, start = of[first], segs.column("start").to_numpy()[of[first]]
        return pa.table({"doc_id": segs.column("doc_id").take(rows), "rid": segs.column("rid").take(rows), "start": pa.array(start + end[first] - window), "end": pa.array(start + end[last])})

    by = ["shard", "part"]
    return cut.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(locate, "doc_id long, rid long, start long, end long")


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) for every row: its words, joined by one space, without those that
    a window covers whose words also start in a document with a smaller id.

    Words are what stands between ASCII white space, unchanged; null and empty texts have none. Windows are judged
    on the input; of texts that are equal as a whole, only the smallest id's goes further. Rows with the same id count as one document; null ids neither hold nor lose words.
    """
    rows = texts(docs, id_col, text_col)
    known = rows.where("doc_id is not null")
    again = written(copies(known), "copies")  # every window of a copy starts in its original too
    small = again.count() <= 2_000_000  # 32 MB at most
    found = written(segments(known.join(F.broadcast(again) if small else again, ["doc_id", "rid"], "left_anti"), window, most_bits), "segments")
    cover = occurrences(found, written(recurring(found, window), "phrases"), window)
    cover = cover.unionByName(again.select("doc_id", "rid", F.lit(0).cast("long").alias("start"), F.lit(ALL).alias("end")))
    cover = cover.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "end")).alias("cover"))

    def keep(batches):
        for b in batches_of(batches):
            n, removed, kept = [], [], []
            for text, cover in zip(b.column("text").to_pylist(), b.column("cover").to_pylist(), strict=True):
                words = words_of(text)
                n.append(len(words))
                stay = bytearray(b"\1") * len(words)
                for c in cover or () if len(words) >= window else ():
                    end = min(c["end"], len(words))
                    stay[c["start"] : end] = bytes(end - c["start"])
                removed.append(len(words) - sum(stay))
                kept.append(b" ".join([w for w, s in zip(words, stay, strict=True) if s] if cover else words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(cover.hint("shuffle_hash"), ["doc_id", "rid"], "left").select("doc_id", "text", "cover")
    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
