import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import jaccard
from folioflow.llm.jaccard import Bands, keep_first, parities, shingle_set, shingle_sets, signatures, similarity_components


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def documents(seed, words, n_docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n_docs):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randint(0, 3))]
        else:
            w = rng.choices(vocabulary, k=rng.randint(*words))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "num", "words"), [(3, 90, (2, 12)), (3, 90, (40, 200)), (5, 80, (1, 90))])
def test_components_match_brute_force(spark, n, num, words):
    rows = documents(num + words[1], words)
    rows += [(500, None), (501, ""), (502, "  "), (503, rows[0][1].upper()), (504, "one two"), (505, "ONE two"), (506, "two one")]
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, num, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, num, 100)


@pytest.mark.parametrize(("n", "num", "words"), [(3, 90, (2, 60)), (5, 80, (1, 90))])
def test_components_are_the_same_with_many_ranges(spark, n, num, words):
    rows = documents(num + words[1] + 1, words)
    rows += [(500, None), (501, ""), (503, rows[0][1].upper()), (504, "one two"), (505, "ONE two")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(3)
    got = similarity_components(df, n, num, 100, per_range=50).distinct().collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, num, 100)


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    texts = ["", " ", "a", "A b", "a b", "b a", "a\tB\n c d ", "\u00e9 \u00c9 a b", "", *(t for _, t in documents(4, (1, 40), 30))]
    monkeypatch.setattr(jaccard, "TOGETHER", 100)
    for n in (1, 3, 5):
        sets = shingle_sets(pa.array(["-", *texts]).slice(1), n)
        assert [s.tolist() for s in sets] == [shingle_set(t, n).tolist() for t in texts]
        for t, s in zip(texts, sets, strict=True):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
            k = min(n, len(w))
            assert len(s) == (len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if w else 0)
    assert shingle_sets(pa.array([], pa.string()), 3) == []
    a, b = shingle_sets(pa.array(["a b c", "A  B\tc"]), 3)
    assert a.tolist() == b.tolist() != shingle_set("b a c", 3).tolist()


def test_chains_and_near_threshold_groups_lose_no_link(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    chain, rows = list(base), []
    for i in range(40):  # each near the one before only
        chain[(i * 7) % 150] = f"c{i}"
        rows.append((i, " ".join(chain)))
    for i in range(60):  # around the threshold of a base that isn't there
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 6)):
            w[k] = f"e{i}-{k}"
        rows.append((100 + i, " ".join(w)))
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90, 100)


def test_signatures_and_parities_bound_differences():
    rng = np.random.default_rng(0)
    bands = Bands(80, 100)
    for _ in range(400):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.15], rng.integers(0, 2**63, rng.integers(0, 1 + len(x) // 8)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 80 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            assert len(np.intersect1d(signatures(x, bands), signatures(y, bands)))
        a, b = parities(x), parities(y)
        a, b = (p if len(p) == min(len(a), len(b)) else p[: len(p) // 2] ^ p[len(p) // 2 :] for p in (a, b))
        assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in a ^ b) <= len(np.setxor1d(x, y))
    assert len(shingle_set("", 3)) == 0 and len(shingle_set("A b", 3)) == 1


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (9, text, 4), (7, "other " * 9, 5), (8, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(((r.doc_id or -1), r.component_id) for r in similarity_components(df).collect())
    assert [x for x in got if x[0] != -1] == [(4, 4), (4, 4), (7, 7), (8, 8), (9, 4)]
    assert sorted(r.node for r in keep_first(df).collect()) == [1, 2, 3, 5, 6]
    assert similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
