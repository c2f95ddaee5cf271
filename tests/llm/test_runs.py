import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm.runs import collapse_runs, find_runs, octaves, z_function


def brute(words, least=24, power=3):
    """All runs, by every period's matching words."""
    known = {}
    c = np.array([known.setdefault(w, len(known)) for w in words])
    found = {}
    for q in range(1, len(c) // power + 1):
        same = np.concatenate([[False], c[:-q] == c[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(least, power * q) and not any(q % p == 0 and (a, b - a + q) in found.get(p, ()) for p in range(1, q)):
                found.setdefault(q, set()).add((a, b - a + q))
    return sorted((a, q, n) for q, x in found.items() for a, n in x)


def collapsed(words, runs):
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng, n, alphabet):
    words = [f"w{rng.randrange(alphabet)}" for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        p, a = rng.randint(1, max(1, n // 4)), rng.randrange(n)
        for i in range(a + p, min(n, a + p * rng.randint(2, 6))):
            words[i] = words[i - p]
    return words


def texts(seed):
    rng = random.Random(seed)
    out = [planted(rng, rng.choice([1, 23, 24, 25, 60, 200, 700]), rng.choice([1, 2, 3, 50, 100_000])) for _ in range(150)]
    long = [f"v{rng.randrange(10**6)}" for _ in range(21_000)]
    for a, p, n in ((40, 1, 30), (8_000, 100, 900), (3_000, 5_000, 16_500), (16_383, 8, 25)):
        for i in range(a + p, a + n):
            long[i] = long[i - p]
    return [*out, long, ["a"] * 9_000, ["a", "b", "a"] * 2_800]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(spark, seed):
    each = texts(seed)
    docs = spark.createDataFrame([(i, "  ".join(w) + "\n") for i, w in enumerate(each)], "doc_id long, text string")
    got = {r.doc_id: r for r in collapse_runs(docs).collect()}
    some = 0
    for i, w in enumerate(each):
        want = brute(w)
        some += bool(want)
        assert [tuple(r) for r in got[i].runs] == want, i
        assert got[i].collapsed == collapsed(w, want) and got[i].n_words == len(w)
    assert some > 30


def test_other_bounds(spark):
    rng = random.Random(5)
    each = [planted(rng, 150, 3) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(each)], "doc_id long, text string")
    for least, power in ((9, 4), (40, 3), (3, 3)):
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in collapse_runs(docs, least, power).collect()}
        assert got == {i: [x for x in brute(w, least, power)] for i, w in enumerate(each)}


def test_odd_rows(spark):
    run = " ".join(["x y z"] * 10)
    rows = [(None, run), (None, run), (None, None), (1, run), (1, run), (1, "x"), (2, None), (3, ""), (4, " \t\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("rid", "runs", "start", "period", "codes", "r_doc", "parts")})
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in collapse_runs(docs).collect())
    whole = (30, [(0, 3, 30)], "x y z")
    assert got == sorted([((True, 0), *whole), ((True, 0), *whole), ((True, 0), 0, [], ""), ((False, 1), *whole), ((False, 1), *whole), ((False, 1), 1, [], "x"), *(((False, i), 0, [], "") for i in (2, 3, 4))])
    assert collapse_runs(docs.where("false")).count() == 0 and find_runs(docs.where("false")).count() == 0


def test_z_function_and_octaves():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 20))]
        assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    assert list(octaves(23)) == [] and list(octaves(24)) == [(8, 1)] and list(octaves(48)) == [(8, 1), (16, 16)]
