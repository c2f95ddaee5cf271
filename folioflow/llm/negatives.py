"""Hard-negative mining by maximum inner products, with cover trees.

Every vector x gets one more coordinate, sqrt(R^2 - |x|^2), where R is the greatest norm; then the inner product with an
anchor q is (|q|^2 + R^2 - d^2) / 2, d being the distance to (q, 0). So a ball of vectors bounds their inner products. Candidates are
dealt to cells around pivots and cells are cut into shards; each task builds a cover tree of its shard, whose
covering radii halve from level to level, and descends it for the anchors that the cells' own balls let through, best bound first. Nodes
whose bounds lie outside of all of an anchor's windows are skipped, and leaves are scored exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, written

SHARD = 2048  # candidates of a tree
PIVOTS = 256  # cells at most
ASKED = 1 << 16  # anchors that a tree is asked by at once
LEAF = 24  # rows that a node is not split any more
_MOST = (1 << 63) - 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows, the short ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


class Products:
    """Exact inner products of whole vectors, by floats where all sums are below 2^53."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.most = rows, int(np.abs(rows).max(initial=0))
        self.floats = rows.astype(np.float64)

    def __call__(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:
            return (self.floats[at] @ q.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ q


class CoverTree:
    """Of augmented vectors. A node covers its rows within a radius; its children's centres are more than half of that apart,
    cover their rows within half of it, and the first one has the node's own centre."""

    def __init__(self, rows: np.ndarray, r2: float, leaf: int = LEAF):
        self.product, self.r2, self.leaf = Products(rows), r2, leaf
        x = rows.astype(np.float64)
        self._x = np.hstack([x, np.sqrt(np.maximum(0.0, r2 - (x * x).sum(axis=1)))[:, None]])
        #: for each inner node: centres and radii of its children, which of them are inner nodes, rows of its leaves and their child
        self.nodes: list[tuple] = []
        if len(rows):
            everything = np.arange(len(rows))
            self._split(everything, 0, self._far(everything, 0))

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self._x[rows] - self._x[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _split(self, rows: np.ndarray, centre: int, far: np.ndarray) -> int:
        """The number of the node of ``rows``, which are ``far`` from its centre. Levels are split from a list, not by recursion."""
        self.nodes.append(())
        todo = [(0, rows, centre, far)]
        while todo:
            number, rows, centre, far = todo.pop()
            half = far.max() / 2
            centres, radii, inner, in_leaves, of = [], [], [], [], []
            while len(rows):
                near = far <= half
                near[0] |= not near.any()
                own, radius = rows[near], float(far[near].max())
                if len(own) <= self.leaf or radius == 0:
                    inner.append(-1)
                    in_leaves.append(own)
                    of.append(np.full(len(own), len(centres)))
                else:
                    inner.append(len(self.nodes))
                    self.nodes.append(())
                    todo.append((inner[-1], own, centre, far[near]))
                centres.append(centre)
                radii.append(radius)
                rows = rows[~near]
                if len(rows):
                    centre = int(rows[0])
                    far = self._far(rows, centre)
            self.nodes[number] = (np.array(centres), np.array(radii), np.array(inner), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (in_leaves, of)))
        return 0

    def bounds(self, q: np.ndarray, q2: float, at: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product that a ball around each row may hold, with room for rounding."""
        d = np.sqrt(np.maximum(0.0, q2 + self.r2 - 2.0 * self.product(at, q)))
        slack = 1.0 + 1e-9 * (q2 + self.r2)
        return (q2 + self.r2 - (d + radii) ** 2) / 2 - slack, (q2 + self.r2 - np.maximum(0.0, d - radii) ** 2) / 2 + slack

    def best(self, q: np.ndarray, windows: list[tuple[int, int]], k: int, ids: np.ndarray, able: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most score) the first ``k`` (score, id) of ``able`` rows, higher scores and smaller ids first."""
        none = np.zeros(0, np.int64)
        found, least = [(none, none) for _ in windows], np.array([w[0] for w in windows], np.float64)
        most = np.array([w[1] for w in windows], np.float64)
        q2 = float((q.astype(np.float64) ** 2).sum())
        inside = lambda lo, hi: (hi[:, None] >= least) & (lo[:, None] <= most) & (least <= most)
        heap = [(0.0, 0, -np.inf)] if self.nodes else []
        while heap:
            bound, number, low = heapq.heappop(heap)
            if number and not inside(np.array([low]), np.array([-bound])).any():
                continue
            centres, radii, inner, rows, of = self.nodes[number]
            lo, hi = self.bounds(q, q2, centres, radii)
            let = inside(lo, hi).any(axis=1)
            for i in np.flatnonzero(let & (inner >= 0)).tolist():
                heapq.heappush(heap, (-float(hi[i]), int(inner[i]), float(lo[i])))
            rows = rows[let[of] & able[rows]]
            if not len(rows):
                continue
            score = self.product(rows, q)
            for w, (a, b) in enumerate(windows):
                here = (score >= least[w]) & (score >= a) & (score <= b)
                if here.any():
                    s, i = np.concatenate([found[w][0], score[here]]), np.concatenate([found[w][1], ids[rows[here]]])
                    first = np.lexsort((i, -s))[:k]
                    found[w] = s[first], i[first]
                    if len(first) == k:
                        least[w] = max(least[w], float(s[first[-1]]))
        return found


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    ``positives`` first rows of the same label, the ``negatives`` first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Exact.

    Components become floor(scale * x); the score is the inner product, higher ones come first, ties by smaller id. Rows with a null id, label
    or vector, or a component that is null, not a number or infinite, take no part; a short vector counts as if zeros
    followed. Rows that repeat id, label and vector count once; a row with the anchor's id is never its positive or negative. ``is_anchor`` is over
    the columns of ``vectors``; null is false.

    Of rows with equal label and vector only the smallest ids can be among the first ones, so only these become candidates: a vector
    that very many rows have is no hot spot. Pivots are a sample of at most ``pivots`` candidates; they say
    where a row lies, and every row lies somewhere.
    """
    spark, v = vectors.sparkSession, F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.when(~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = written(rows.where("vec_id is not null and label is not null and v is not null"), "vectors")
    n, dims, r2 = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    dims, r2 = max(1, dims), float(r2)

    nth = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    once = rows.select("vec_id", "label", "v").dropDuplicates(["vec_id", "label", "v"])
    kept = written(once.withColumn("nth", nth).where(F.col("nth") <= max(positives, negatives) + 1).drop("nth"), "kept")
    some = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(max(1, min(pivots, kept.count() // shard))).collect()
    centres = _matrix(pa.array([r.v for r in some], pa.list_(pa.int64())), dims).astype(np.float64)
    lifted = np.hstack([centres, np.sqrt(np.maximum(0.0, r2 - (centres**2).sum(axis=1)))[:, None]])

    def far(x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances of rows, with a last coordinate, to all pivots."""
        x = np.hstack([x, last[:, None]])
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (lifted**2).sum(axis=1) - 2 * x @ lifted.T))

    def place(batches):
        for b in batches_of(batches, 4096):
            x = _matrix(b.column("v"), dims).astype(np.float64)
            d = far(x, np.sqrt(np.maximum(0.0, r2 - (x * x).sum(axis=1))))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d[np.arange(len(cell)), cell])], ["vec_id", "label", "v", "cell", "far"])

    placed = written(kept.mapInArrow(place, "vec_id long, label string, v array<long>, cell long, far double"), "placed")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a pivot
    radii = np.array([cells[c].far if c in cells else 0.0 for c in range(len(some))])
    parts = [_ceil(cells[c].n, shard) if c in cells else 0 for c in range(len(some))]
    in_cell = lambda cell, by: cell * F.lit(1 << 32) + F.pmod(F.xxhash64(by), F.greatest(F.lit(1), F.element_at(F.array(*map(F.lit, parts)), cell.cast("int") + 1)))
    dealt = placed.select("vec_id", "label", "v", in_cell(F.col("cell"), "vec_id").alias("shard"))

    def windows(scores: list | None, floor: int | None) -> list[tuple[int, int]]:
        if scores is None:
            return [(-_MOST if floor is None else floor, _MOST)]
        return [(_ceil(low * s, 100), high * s // 100) for s in scores]

    def route(batches):
        """Each anchor with the cells whose balls may hold scores of its windows; without a ``floor`` or scores, the nearest one."""
        slack = 1.0 + 1e-9 * r2
        for b in batches_of(batches, 1024):
            q = _matrix(b.column("v"), dims).astype(np.float64)
            q2 = (q * q).sum(axis=1)[:, None]
            d = far(q, np.zeros(len(q)))
            lo, hi = (q2 + r2 - (d + radii) ** 2) / 2 - slack - 1e-9 * q2, (q2 + r2 - np.maximum(0.0, d - radii) ** 2) / 2 + slack + 1e-9 * q2
            let = np.zeros(d.shape, bool)
            for i, (scores, floor, home) in enumerate(zip(b.column("scores").to_pylist(), b.column("floor").to_pylist(), b.column("home").to_pylist(), strict=True)):
                if home is None:
                    let[i, d[i].argmin()] = True
                for a, e in windows(scores, floor) if home is not None else ():
                    let[i] |= (hi[i] >= a) & (lo[i] <= e)
            i, cell = np.nonzero(let)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in b.columns), pa.array(cell.astype(np.int64))], [*b.schema.names, "cell"])

    names = "anchor_id long, own long, label string, v array<long>, scores array<long>, floor long, home long"

    def search(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, own, window, score, vec_id): the first ``k`` of each window in each shard."""
        per_shard = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks"))
        per_shard = written(per_shard, "blocks")
        a = asked.join(per_shard, "shard").withColumn("block", F.pmod(F.xxhash64("anchor_id", "own"), F.col("blocks")).cast("int")).drop("blocks")
        c = dealt.join(per_shard, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        out_names = ["anchor_id", "own", "window", "score", "vec_id"]

        def one(asked: pa.Table, held: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[] for _ in out_names]
            if asked.num_rows and held.num_rows:
                tree = CoverTree(_matrix(held.column("v").combine_chunks(), dims), r2)
                ids, labels = held.column("vec_id").to_numpy(), np.array(held.column("label").to_pylist(), object)
                masks = {label: (labels == label) == same for label in set(asked.column("label").to_pylist())}
                qs = _matrix(asked.column("v").combine_chunks(), dims)
                for q, anchor, own, label, scores, floor in zip(qs, *(asked.column(x).to_pylist() for x in ("anchor_id", "own", "label", "scores", "floor")), strict=True):
                    for w, (s, i) in enumerate(tree.best(q, windows(scores, floor), k, ids, masks[label] & (ids != anchor))):
                        for column, x in zip(out, (np.full(len(s), anchor), np.full(len(s), own), np.full(len(s), w), s, i), strict=True):
                            column.append(x)
            return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for name, x in zip(out_names, out, strict=True)})

        by = ["shard", "block"]
        return a.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(one, ", ".join(f"{x} long" for x in out_names))

    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "own", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    null = F.lit(None).cast("long")
    anchors = rows.where("asks").select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("own"), "label", "v").dropDuplicates(["anchor_id", "own"])
    anchors = written(anchors.select("*", F.lit(None).cast("array<long>").alias("scores"), null.alias("floor"), null.alias("home")), "anchors")

    # positives: the nearest cell's shard gives a score that the last one has at least, then every shard that may have better ones
    to = lambda a: a.mapInArrow(route, names + ", cell long")
    near = written(to(anchors).withColumn("home", in_cell(F.col("cell"), "anchor_id")).drop("cell"), "near")
    at_home = written(search(near.withColumn("shard", F.col("home")), True, positives), "at_home")
    floors = at_home.groupBy("anchor_id", "own").agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    wide = near.join(floors, ["anchor_id", "own"], "left").withColumn("floor", F.col("least")).drop("least")
    every = F.explode(F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, parts)), F.col("cell").cast("int") + 1) - 1))
    spread = lambda a: to(a).where(F.col("cell").isin(*cells)).withColumn("part", every).withColumn("shard", F.col("cell") * F.lit(1 << 32) + F.col("part")).drop("cell", "part")
    others = search(written(spread(wide).where("shard <> home"), "asked"), True, positives)
    good = written(first(at_home.unionByName(others), positives).drop("window"), "positives")

    # negatives: a window for each positive
    scores = good.groupBy("anchor_id", "own").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    asked = near.drop("scores").join(scores, ["anchor_id", "own"]).withColumn("scores", F.col("p.score"))
    found = first(search(written(spread(asked.select(*near.columns)), "asked"), False, negatives), negatives)
    at = good.select("anchor_id", "own", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(at, ["anchor_id", "own", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
