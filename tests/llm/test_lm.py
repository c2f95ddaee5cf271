import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import lm


def zipf(seed, n=300, vocabulary=800):
    rng = random.Random(seed)
    words = [f"Word{i}" for i in range(vocabulary)]
    share = [1 / (i + 2) for i in range(vocabulary)]
    phrases = [rng.choices(words, share, k=rng.randint(3, 9)) for _ in range(150)]
    return [" ".join(sum((rng.choice(phrases) if rng.random() < 0.7 else rng.choices(words, share, k=3) for _ in range(rng.randint(0, 40))), [])) for _ in range(n)]


class Exact:
    """The same model with whole counts."""

    def __init__(self, learned, priors):
        self.priors, self.c = priors, [Counter() for _ in range(len(priors) + 1)]
        for t in learned:
            w = ["<begin>", *t.lower().split(), "<end>"]
            for m, c in enumerate(self.c):
                c.update(tuple(w[i - m : i + 1]) for i in range(max(1, m), len(w)))
        self.n, self.v, self.docs = sum(self.c[0].values()), len(self.c[0]), len(learned)

    def base(self, t):
        return sum(math.log10((self.c[0][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in [*t.lower().split(), "<end>"])

    def score(self, t):
        w, total = ["<begin>", *t.lower().split(), "<end>"], 0.0
        for i in range(1, len(w)):
            p = (self.c[0][(w[i],)] + 0.5) / (self.n + 0.5 * (self.v + 1))
            for m, k in enumerate(self.priors, 1):
                if m <= i:
                    h = tuple(w[i - m : i])
                    of = self.docs if h == ("<begin>",) else self.c[m - 1][h]
                    p = (self.c[m][(*h, w[i])] + k * p) / (of + k)
            total += math.log10(p)
        return total


@pytest.mark.parametrize("priors", [(100.0,), (50.0, 5.0)])
def test_scores_follow_exact_counts(spark, priors):
    texts = zipf(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 5 != 1, priors).collect()}
    model = Exact([t for i, t in enumerate(texts) if i % 5 != 1], priors)
    ours = theirs = base = 0.0
    for i, t in enumerate(texts):
        r, w = got[i], [*t.lower().split(), "<end>"]
        assert (r.learns, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 != 1, len(w), sum(model.c[0][(x,)] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(model.base(t), rel=1e-12)
        assert r.score < 0 and r.score == pytest.approx(model.score(t), abs=0.12 * len(w) + 0.3)
        if i % 5 == 1:
            ours, theirs, base = ours + r.score, theirs + model.score(t), base + r.base_score
    assert abs(ours - theirs) < 0.02 * abs(theirs) and ours > 0.9 * base  # both negative: better than single words


def test_rare_words_go_by_a_join(spark, monkeypatch):
    texts = zipf(4, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learns = F.col("doc_id") % 5 != 1
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 9), r.score) for r in lm.score_texts(docs, learns).collect())
    monkeypatch.setattr(lm, "HOT", 20)  # so 20 words at most are broadcast
    model, rare = lm.learn(docs, learns)
    assert len(model.hot.value[0]) <= 20 and rare.count() > 300
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 9), r.score) for r in lm.score_texts(docs, learns).collect()) == want


def test_filter_holds_every_level_and_few_others(spark):
    texts = zipf(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = lm.learn(docs, F.lit(True))
    seq, place = lm.sequences([lm._words(t) for t in texts])
    bounds = lm.level_bounds()
    for keys, there in [(lm.word_keys(seq), place > 0), lm.ngram_keys(seq, place, 2)[1]]:
        distinct, n = np.unique(keys[there], return_counts=True)
        level, want = model.held.value.levels(distinct), np.searchsorted(bounds, n, side="right")
        assert (level >= want).all() and (level == want).mean() > 0.97
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (model.held.value.levels(other) > 0).mean() < 0.03


def test_a_full_filter_leaves_the_lowest_levels_out(spark):
    rng = random.Random(6)
    texts = [*zipf(6), *(" ".join(f"x{rng.randrange(3000)}" for _ in range(500)) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, small = (lm.learn(docs, F.lit(True), most_bits=b)[0].held.value for b in (1 << 30, 1 << 19))
    assert whole.least == 1 and small.least > 1 and len(small.field) * 8 <= 1 << 19 < len(whole.field) * 8
    seq, place = lm.sequences([lm._words(t) for t in texts])
    for keys, there in [(lm.word_keys(seq), place > 0), lm.ngram_keys(seq, place, 2)[1]]:
        distinct, n = np.unique(keys[there], return_counts=True)
        want = np.searchsorted(lm.level_bounds(), n, side="right")
        assert (small.levels(distinct) >= np.where(want >= small.least, want, 0)).all()


@pytest.mark.parametrize("priors", [(100.0,), (50.0, 5.0)])
def test_counts_beyond_a_full_filter_go_by_a_join(spark, monkeypatch, priors):
    rng = random.Random(7)
    texts = [*zipf(7), *(" ".join(f"x{rng.randrange(3000)}" for _ in range(200)) for _ in range(100))]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learns = F.col("doc_id") % 5 != 1
    monkeypatch.setattr(lm, "HOT", 100)
    whole = {r.doc_id: r for r in lm.score_texts(docs, learns, priors).collect()}
    model, _, low = lm.fit(docs, learns, priors, most_bits=1 << 17)
    assert model.held.value.least > 1 and low.count() > 10_000
    small = {r.doc_id: r for r in lm.score_texts(docs, learns, priors, most_bits=1 << 17).collect()}
    exact = Exact([t for i, t in enumerate(texts) if i % 5 != 1], priors)
    assert small.keys() == whole.keys()
    for i, t in enumerate(texts):
        a, b = small[i], whole[i]
        assert (a.n_known, round(a.base_score, 9)) == (b.n_known, round(b.base_score, 9))
        assert a.score == pytest.approx(exact.score(t), abs=0.12 * a.n_tokens + 1.5)
    assert sum(r.score for r in small.values()) == pytest.approx(sum(r.score for r in whole.values()), rel=0.02)


@pytest.mark.parametrize("start", ["k7", "v"])
def test_a_full_filters_false_answers_are_looked_up(spark, monkeypatch, start):
    rng = random.Random(7)
    texts = [*zipf(7), *(" ".join(f"x{rng.randrange(3000)}" for _ in range(200)) for _ in range(100))]
    texts = [" ".join(start + w for w in t.split()) for t in texts]  # other hashes
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "HOT", 100)
    got = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 5 != 1, (50.0, 5.0), most_bits=1 << 17).collect()}
    exact = Exact([t for i, t in enumerate(texts) if i % 5 != 1], (50.0, 5.0))
    assert all(got[i].score == pytest.approx(exact.score(t), abs=0.12 * got[i].n_tokens + 1.5) for i, t in enumerate(texts))


def test_words_of_a_batch_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 50)
    rng = random.Random(8)
    for _ in range(100):
        texts = ["".join(rng.choice(["a", "B", "é", "Z9", "\0", "\x1c", " ", "\n", "\x0b", "  ", "long" * 40]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        each = [lm._words(t) for t in texts]
        flat = [w for x in each for w in x]
        words = lm.Words(pa.array(["x y", *texts]).slice(1))
        assert words.n.tolist() == list(map(len, each)) and words.spelt(np.arange(len(flat) + 1)).to_pylist() == [*flat, lm.END]
        assert len(set(words.h.tolist())) == len(set(flat)) and (words.h == lm._hashed(flat)).all()


def test_odd_rows(spark):
    rows = [(1, "a b A"), (1, "a b A"), (2, None), (3, ""), (None, "a c"), (4, "z " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rid", "learns", "token", "tf", "c", "n", "x", "cold", "score", "key", "block")})
    learns = F.col("doc_id").isin(1, 2)
    got = sorted(((r.doc_id or 0), r.learns, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in lm.score_texts(docs, learns).collect())
    model = Exact(["a b A", "a b A", ""], (100.0,))
    assert got == sorted((i or 0, i in (1, 2), len((t or "").split()) + 1, sum(model.c[0][(x,)] > 0 for x in [*(t or "").lower().split(), "<end>"]), model.n, round(model.base(t or ""), 9)) for i, t in rows)
    assert lm.score_texts(docs.where("false"), learns).count() == 0
    none = lm.score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == 6 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_levels():
    bounds = lm.level_bounds()
    assert bounds[:10].tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12] and (np.diff(bounds) > 0).all()
    values = lm.level_values(bounds)
    assert values[:5].tolist() == [0, 1, 2, 3, 4] and len(values) == len(bounds) + 1
