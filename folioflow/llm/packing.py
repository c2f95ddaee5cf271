"""Best-fit packing: token pieces into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, texts, written

MEMO = 1_000_000  # of each kind that a Python worker remembers
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids as bytes of the vocabulary file at ``path``, as ``encode(text, add_special_tokens=False)`` has them.

    The file's rules lower-case, split into letters, single digits and other signs, and then look at each part
    alone; so parts met before come from a memo. That holds for texts below U+0250 (no combining marks there);
    all others, and files with other rules, go through the tokenizer whole.
    """

    _parts = re.compile(r"[a-zß-öø-ɏªµº]+|'(?:s|t|re|ve|m|ll|d)|\d|[^\sa-zA-Z0-9ªµºÀ-ÖØ-öø-ɏ²³¹¼-¾]+|[²³¹¼-¾]")
    _odd = re.compile("[\x1c-\x1fɐ-\U0010ffff<]")  # white space in Python only; signs above; < begins the names of special tokens

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}  # between white space, which no part crosses
        self.parts: dict[str, bytes] = {}
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_part = bool((m := self.whole.to_str()) and '"</w>"' in m and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in m and '"Lowercase"' in m)

    def encode(self, texts: list[str]) -> list[bytes]:
        low = [t.lower() for t in texts]
        plain = [self.by_part and not self._odd.search(t) for t in low]
        chunks = [t.split() if p else () for t, p in zip(low, plain, strict=True)]
        if len(self.chunks) > MEMO:
            self.chunks = {}
        self._learn(set().union(*chunks).difference(self.chunks))
        rest = iter(self.whole.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        known = self.chunks.__getitem__
        return [b"".join(map(known, c)) if p else np.array(next(rest).ids, "<u4").tobytes() for c, p in zip(chunks, plain, strict=True)]

    def _learn(self, new: set[str]) -> None:
        if len(self.parts) > MEMO:
            self.parts = {}
        split = {c: self._parts.findall(c) for c in new}
        unseen = list(set().union(*split.values()).difference(self.parts))
        if unseen:  # all at once: an id whose token ends with </w> is the last one of its part
            ids = np.array(self.whole.encode(" ".join(unseen), add_special_tokens=False).ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.parts.update(zip(unseen, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for c, p in split.items():
            self.chunks[c] = b"".join([self.parts[w] for w in p])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids and ``end_id``, cut every ``capacity`` ids.

    ``tokenizer`` is the path of a vocabulary file on the executors. Null and empty texts are ``end_id`` alone.
    Repeated rows are packed as often as they occur; a null id stays null.
    """
    rows = texts(docs, id_col, text_col).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        for b in batches_of(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for column, x in zip(out, (doc_id, k, at, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


GROUP_ROWS = 1 << 20  # pieces that a task packs, about


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length by best-fit decreasing: each goes to the tightest bin it fits in.

    A segment tree over the remaining capacities 1..capacity counts the open bins below each node; the tightest
    is found by one way up and one way down, so in the logarithm of the capacity.
    """
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        node = size + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:  # the right neighbour's subtree has the smallest capacity above
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - size
            b = open_bins[room].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > need:
            open_bins[room - need].append(b)
            node = size + room - need
            while node:
                tree[node] += 1
                node >>= 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group_tokens: int = 1 << 23) -> DataFrame:
    """``pieces`` with sequence_id and offset: best-fit decreasing within groups of about ``group_tokens`` tokens.

    Pieces are dealt into groups by a hash of their content and of their place in the table, so that equal rows don't
    meet in one group; as many groups as the input's tokens and rows need, so each task's work is bounded and all groups have alike mixtures of lengths; at most a few sequences of a group of
    thousands stay open, which is what grouping costs against packing everything at once. Pieces of full length
    fill a sequence alone. Lengths must be from 1 to ``capacity``.
    """
    pieces = written(pieces, "pieces")
    tokens, n = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(tokens or 0) // group_tokens), -(-n // GROUP_ROWS))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = best_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=(pdf["grp"].iloc[0] << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64)).drop(columns="grp")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))).groupBy("grp").applyInPandas(one, schema)
