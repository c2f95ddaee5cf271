"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs i < j of <v[i], v[j]>) over the distinct terms of a text, so a pair
of terms can count for more (or less) than both alone. Terms are the text's words, its stems (the first letters of
longer words, with how many distinct words begin so) and the magnitude of its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, texts

_TERM = re.compile(r"[^\W\d_]+")
STEM = 5  # letters
TIMES = (1, 2, 3, 5)  # distinct words of a stem: each number that is reached is a term
MEMO = 250_000  # words that a task remembers
BLOCK = 2048  # terms whose pairs are counted together
ROWS = 512  # rows that are counted together
SLAB = 64  # terms whose pairs with all others are judged together: the driver holds few floats at a time
_memo: dict[str, tuple[int, int]] = {}


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> 1


def buckets(text: str, dims: int) -> np.ndarray:
    """Sorted distinct buckets of the terms of the whole text; none without letters."""
    if len(_memo) > MEMO:
        _memo.clear()
    words = _TERM.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    distinct = set(words)
    for w in distinct.difference(_memo):
        _memo[w] = _hash(w), _hash("^" + w[:STEM]) if len(w) > STEM else 0
    each = np.array(list(map(_memo.__getitem__, distinct)), np.int64)
    stems, n = np.unique(each[:, 1], return_counts=True)
    known = stems != 0
    reached = [stems[known & (n >= t)] // 8 + t for t in TIMES]
    return np.unique(np.concatenate([each[:, 0], *reached, [_hash(f"#{len(words).bit_length()}")]]) % dims)


def _deviance(count: np.ndarray, hit: np.ndarray, p: float | np.ndarray) -> np.ndarray:
    """How far the share of labelled ones is from ``p``, as a log-likelihood ratio (about z squared)."""
    miss = count - hit
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = hit * np.log(hit / (count * p)), miss * np.log(miss / (count * (1 - p)))
    return 2 * (np.where(hit > 0, up, 0) + np.where(miss > 0, down, 0))


def _marked(at: list[np.ndarray], width: int) -> np.ndarray:
    """Rows by terms: 1 where a row has the term."""
    x = np.zeros((len(at), width), np.float32)
    x[np.repeat(np.arange(len(at)), [len(r) for r in at]), np.concatenate(at)] = 1
    return x


def mixed_terms(rows: list[np.ndarray], y: np.ndarray, kept: np.ndarray, terms: np.ndarray, least: float) -> np.ndarray:
    """Which of ``terms`` change what one of ``kept`` says: the share of labelled rows among those that have both is off from the share
    among those that have the kept one by a deviance of ``least`` or more. Both are sorted buckets."""
    at, of = ([np.searchsorted(t, r[np.isin(r, t, assume_unique=True)]) for r in rows] for t in (terms, kept))
    own, own_hit = np.zeros((2, len(kept)))
    both, hit = np.zeros((2, len(kept), len(terms)), np.float32)
    for k in range(0, len(rows), ROWS):
        a, b, label = _marked(of[k : k + ROWS], len(kept)), _marked(at[k : k + ROWS], len(terms)), y[k : k + ROWS] > 0
        own += a.sum(axis=0)
        own_hit += a[label].sum(axis=0)
        both += a.T @ b
        hit += a[label].T @ b[label]
    share = np.clip(own_hit / np.maximum(own, 1), 1e-6, 1 - 1e-6)
    found = np.zeros(len(terms), bool)
    for s in range(0, len(kept), SLAB):
        found |= (_deviance(both[s : s + SLAB], hit[s : s + SLAB], share[s : s + SLAB, None]) >= least).any(axis=0)
    return terms[found]


def paired_terms(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, least: float) -> np.ndarray:
    """Which of ``terms`` (sorted buckets) stand in a pair whose joint share of labelled rows is off by a deviance of
    ``least`` or more. Counts of all pairs are products of the matrix of rows by terms, BLOCK of both at a time."""
    p = float(y.mean())
    found = np.zeros(len(terms), bool)
    at = [np.searchsorted(terms, r[np.isin(r, terms, assume_unique=True)]) for r in rows]
    for i in range(0, len(terms), BLOCK):
        for j in range(i, len(terms), BLOCK):
            count, hit = np.zeros((2, min(BLOCK, len(terms) - i), min(BLOCK, len(terms) - j)), np.float32)
            for k in range(0, len(rows), ROWS):
                x, label = _marked(at[k : k + ROWS], len(terms)), y[k : k + ROWS] > 0
                a, b = x[:, i : i + BLOCK], x[:, j : j + BLOCK]
                count += a.T @ b
                hit += a[label].T @ b[label]
            for s in range(0, len(count), SLAB):
                odd = _deviance(count[s : s + SLAB], hit[s : s + SLAB], p) >= least
                odd &= np.arange(i + s, i + s + len(odd))[:, None] < np.arange(j, j + odd.shape[1])
                found[i + s : i + s + len(odd)] |= odd.any(axis=1)
                found[j : j + odd.shape[1]] |= odd.any(axis=0)
    return terms[found]


class FactorizationMachine:
    """Weights by bucket: w0, w (dims) and v (dims x factors); its size is fixed by ``dims`` and ``factors``."""

    def __init__(self, dims: int, factors: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dims, self.w0, self.w = dims, 0.0, np.zeros(dims, np.float32)
        self.v = rng.normal(0, 0.05, (dims, factors)).astype(np.float32)
        self.used = np.ones(dims, bool)

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        rows = [r[self.used[r]] for r in rows]
        ends = np.cumsum([len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        if not len(flat):
            return np.full(len(rows), self.w0)
        add = lambda x: np.diff(np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)[ends - 1] * (ends > 0)[:, None]]), axis=0)
        v = self.v[flat]
        pairs = 0.5 * (add(v) ** 2 - add(v * v)).sum(axis=1)
        return self.w0 + add(self.w[flat, None])[:, 0] + pairs

    def fit(self, rows: list[np.ndarray], y: np.ndarray, least_rows: int = 4, least_z: float = 4.0, least_pair: float = 40.0, pair_support: float = 0.02, most_terms: int = 4096, most_kept: int = 512, steps: int = 1500, batch: int = 128, rate: float = 0.1, decay: float = 1e-3) -> FactorizationMachine:
        """AdaGrad on the logistic loss. Of the buckets that at least ``least_rows`` rows have, those take part whose
        share among labelled ones differs by ``least_z`` standard errors or more. Of the others, those which the share
        ``pair_support`` of the rows has or more are counted in pairs, and take part if a pair's joint share is off by
        a deviance of ``least_pair`` or more: terms that say nothing alone; or if they change what a term says that takes part
        for itself. Of the others the ``most_terms`` most frequent ones are looked at, with the ``most_kept`` clearest of those that have an effect of
        their own, so the work is bounded by rows x most_terms x (most_terms + most_kept)."""
        y = np.asarray(y, np.float64)
        if not 0 < y.sum() < len(y):
            self.w0, self.used[:] = (-4.0 if not y.sum() else 4.0), False
            return self
        p = float(y.mean())
        count, hit = np.zeros((2, self.dims), np.int64)
        for r, t in zip(rows, y, strict=True):
            count[r] += 1  # a row has a bucket once
            hit[r] += t > 0
        z = (hit - count * p) / np.sqrt(np.maximum(count * p * (1 - p), 1e-9))
        self.used = (count >= least_rows) & (np.abs(z) >= least_z)
        frequent = count >= max(least_rows, pair_support * len(rows))
        others, kept = np.flatnonzero(frequent & ~self.used), np.flatnonzero(frequent & self.used)
        others = np.sort(others[np.argsort(-count[others], kind="stable")[:most_terms]])
        kept = np.sort(kept[np.argsort(-np.abs(z[kept]), kind="stable")[:most_kept]])
        mixed = mixed_terms(rows, y, kept, others, least_pair) if len(kept) and len(others) else others[:0]
        self.used[paired_terms(rows, y, others, least_pair)] = True
        self.used[mixed] = True
        self.w0 = float(np.log(p / (1 - p)))
        ids = np.flatnonzero(self.used)
        at = [np.searchsorted(ids, r[self.used[r]]) for r in rows]  # columns of the few buckets that take part
        w, v, w0 = np.zeros(len(ids), np.float32), self.v[ids], self.w0
        g0, gw, gv = 1e-6, np.full(w.shape, 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32)
        rng = np.random.default_rng(1)
        for _ in range(max(10, -(-steps * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                part = [at[i] for i in order[a : a + batch]]
                x = np.zeros((len(part), len(ids)), np.float32)
                x[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part)] = 1
                sums = x @ v
                margin = w0 + x @ w + 0.5 * (sums**2 - x @ v**2).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[order[a : a + batch]]).astype(np.float32)
                w0 -= rate * float(error.mean()) / np.sqrt(g0 := g0 + float(error.mean()) ** 2)
                here = x.any(axis=0)
                dw = error @ x / len(part)
                dv = x.T @ (error[:, None] * sums) / len(part) - dw[:, None] * v + decay * here[:, None] * v
                gw += dw**2
                gv += dv**2
                w -= rate * dw / np.sqrt(gw)
                v = v - rate * dv / np.sqrt(gv)
        self.w0, self.w[ids], self.v[ids] = float(w0), w, v
        return self


def learn(docs: DataFrame, labels: DataFrame, usable: Column, most_rows: int = 20_000, dims: int = 1 << 18, factors: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fitted on labelled rows for which ``usable`` (a column over ``labels``) holds: on all, or on the ``most_rows``
    of the smallest hashed ids, which is the bound of what reaches the driver (buckets, no texts). Rows with null
    ids or labels teach nothing; several labels of one id are averaged."""
    known = labels.where(usable).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "rid"]).select("doc_id", "text", "y")

    def hashed(batches):
        for b in batches_of(batches):
            each = [buckets(t, dims).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(each, pa.binary())], ["doc_id", "y", "terms"])
        _memo.clear()  # Python workers live on

    got = rows.mapInArrow(hashed, "doc_id long, y int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("terms", "ascending")])
    rows = [np.frombuffer(t.as_buffer(), np.int32) for t in got.column("terms")]  # no copies: what the driver holds is what came
    return FactorizationMachine(dims, factors).fit(rows, got.column("y").to_numpy().astype(np.float64))


def toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, score) of every row: the probability of the label, from 0 to 1, of the whole text. Null and
    empty texts get the model's prior. The model that is broadcast has a fixed size (9 MB by default)."""
    rows = texts(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches_of(batches):
            m = held.value
            x = m.margins([buckets(t, m.dims) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))), pa.float64())], ["doc_id", "rid", "score"])
        _memo.clear()

    return rows.mapInArrow(score, "doc_id long, rid long, score double")
