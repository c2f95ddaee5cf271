import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm.negatives import CoverTree, mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5, low=80, high=100):
    able = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            able[i] = ([math.floor(256 * float(np.float32(x))) for x in v], label)
    out = []
    for a, (q, label) in able.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l == label) for i, (v, l) in able.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def vectors(seed, n=400, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    hot = [rng.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = hot if rng.random() < 0.35 else [x + rng.gauss(0, 0.3) for x in c]
        rows.append((i, v, rng.randrange(3)))
    return rows


@pytest.mark.parametrize(("seed", "shard", "pivots"), [(1, 40, 8), (2, 2048, 256), (3, 7, 200)])
def test_negatives_equal_brute_force(spark, seed, shard, pivots):
    rows = vectors(seed)
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, shard=shard, pivots=pivots).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_other_windows(spark):
    rows = vectors(4, 200)
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, positives=3, negatives=7, low=20, high=120, shard=30).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 7, 20, 120)


def test_odd_rows(spark):
    rows = vectors(6, 120)
    odd = [(None, rows[0][1], 1), (200, None, 1), (210, [None] * 6, 1), (220, [float("nan")] + [0.0] * 5, 1), (230, [float("inf")] + [0.0] * 5, 1), (240, rows[0][1], None), (250, [], 1), (260, [0.5], 1), (270, [0.0] * 6, 2)]
    df = spark.createDataFrame([*rows, *rows[:30], *odd], SCHEMA)
    for c in ("shard", "cell", "v", "asks", "own", "far", "home", "window", "score", "rank", "block"):
        df = df.withColumn(c, F.lit(1))
    got = sorted(map(tuple, mine_negatives(df, F.col("vec_id") % 10 == 0, shard=20).collect()))
    assert got == brute([*rows, *odd])
    assert mine_negatives(df.where("false"), F.lit(True)).count() == 0
    assert mine_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_cover_tree_skips_nodes_and_loses_none():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (20, 8))
    rows = centres[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 8))
    r2 = float((rows * rows).sum(axis=1).max())
    tree = CoverTree(rows, r2)
    held = np.concatenate([x[3] for x in tree.nodes])
    assert sorted(held.tolist()) == list(range(3000))  # each row in one leaf
    looked = 0
    whole = tree.product

    def counted(at, q):
        nonlocal looked
        looked += len(at)
        return whole(at, q)

    tree.product = counted
    ids, able = np.arange(3000), np.ones(3000, bool)
    for q in rows[:50]:
        score = rows @ q
        top = sorted(zip((-score).tolist(), ids.tolist()))[:5]
        windows = [(-(1 << 62), 1 << 62), (int(0.8 * -top[4][0]), -top[4][0])]
        for (s, i), (a, b) in zip(tree.best(q, windows, 5, ids, able), windows, strict=True):
            assert [(-x, y) for x, y in zip(s.tolist(), i.tolist())] == sorted((-int(score[j]), j) for j in range(3000) if a <= score[j] <= b)[:5]
    assert looked < 0.5 * 50 * 3000, looked / 150_000
