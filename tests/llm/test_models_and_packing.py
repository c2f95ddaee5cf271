import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import media
from folioflow.llm.decontam import align, find_contamination
from folioflow.llm.media import FRAME, HOP, Asked, align_recordings, fingerprints, render, search_recordings
from folioflow.llm.packing import Encoder, best_fit, pack, token_pieces
from folioflow.llm.toxicity import FactorizationMachine, buckets, learn, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    whole = Tokenizer.from_file(PATH)
    signs = "abcXYZéÀß'st1²½_-.\t\n ªÿĀ🙂ſǅ×\x85\x1cḰİΣςΑ<|endoftext|>Ⱥ"
    texts = ["", " ", "it's", "<|endoftext|>", "don'T re've"] + ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(3000)]
    e = Encoder(PATH)
    for _ in range(2):
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_is_the_tightest_open_bin():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 200))]
        bins, offsets = best_fit(lengths, 64)
        left: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in left if r >= lengths[i]]
            room = min(fits) if fits else 64
            assert 64 - room == offsets[i]
            if fits:
                left.remove(room)
            left.append(room - lengths[i])
        assert len(left) == (max(bins) + 1 if bins else 0)


def test_packing_is_whole_and_gapless(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma42", "ß"], k=rng.choice([0, 1, 30, 900, 5000])))) for i in range(80)] + [(90, None), (90, None), (None, "x")]
    got = pack(token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 512), 512, group_tokens=20_000).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i if i is not None else -1, k, 512 * k, len(p := ids[512 * k : 512 * k + 512]), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 512))]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert len(by) <= -(-sum(r.length for r in got) // 512) * 1.05 + 4
    assert pack(token_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


def test_factorization_machine_learns_pairs_that_say_nothing_alone():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(10, 400, 5), [1] * int(a), [2] * int(b)])).astype(np.int64))
        y.append(float(a != b))
    m = FactorizationMachine(512, 4).fit(rows, np.array(y))
    asked = [np.array(x, np.int64) for x in ([1], [2], [1, 2], [])]
    p = m.margins(asked)
    assert (p[:2] > 0).all() and (p[2:] < 0).all()
    one = np.array([1, 2, 7])
    v, w = m.v[one[m.used[one]]].astype(float), m.w[one[m.used[one]]].astype(float)
    assert np.isclose(m.margins([one])[0], m.w0 + w.sum() + sum(v[i] @ v[j] for i in range(len(v)) for j in range(i)), atol=1e-5)
    m.v[:] = 0  # no weights by term alone tell these rows apart
    p = m.margins(asked)
    assert not ((p[:2] > 0).all() and (p[2:] < 0).all())


def test_a_mention_that_counts_only_beside_an_insult():
    """The insult has an effect of its own, the mention none without it: the pair must be learned all the same."""
    rng = np.random.default_rng(12)
    n = 8000
    insult, mention = rng.random(n) < 0.3, rng.random(n) < 0.3
    p = np.where(insult & mention, 0.9, np.where(insult, 0.55, np.where(mention, 0.0, 0.15)))
    y = (rng.random(n) < p).astype(float)
    noise = [rng.choice(np.arange(10, 400), 12, replace=False) for _ in range(n)]
    rows = [np.sort(np.concatenate([x, [1] if a else [], [2] if b else []]).astype(np.int64)) for x, a, b in zip(noise, insult, mention, strict=True)]

    def auc(score):
        rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
        return (rank[y > 0].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (n - y.sum()))

    m = FactorizationMachine(512, 8).fit(rows, y)
    assert m.used[[1, 2]].all() and m.used.sum() < 30
    both, alone, other, none = (1 / (1 + np.exp(-m.margins([np.array(x, np.int64)])[0])) for x in ([1, 2], [1], [2], []))
    assert both > 0.75 and 0.4 < alone < 0.7 and other < 0.15 and both > alone + 0.15
    assert auc(m.margins(rows)) > auc(p) - 0.02


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    clean = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = rng.choices(clean, k=rng.randint(3, 60)) + (rng.sample(["gruff", "blah", "meh"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "gruff blah"), (0, rows[0][1])]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1001, None), (None, 1)], "doc_id long, toxic int")
    m = learn(docs, known, known.doc_id % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity(docs, m).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels if i % 5 == 0)
    assert 0 <= got[1000] == got[1001] < 0.5 and got[None] >= 0.5
    none = learn(docs, known.where("false"), known.doc_id >= 0)
    assert {r.score >= 0.5 for r in toxicity(docs, none).collect()} == {False}
    assert np.array_equal(buckets("Ab ab AB", 1 << 18), buckets("ab, 7 AB! ab", 1 << 18)) and not len(buckets("7 !", 64))
    assert len(buckets("unreal unrest unread", 1 << 18)) == 7  # words, unrea once and twice, unres, length
    assert toxicity(docs.where("false"), m).count() == 0
    extra = docs.selectExpr("*", "1 AS rid", "'x' AS score", "text AS terms")
    assert sorted(r.score for r in toxicity(extra, learn(extra, known, known.doc_id % 5 != 0)).collect()) == sorted(r.score for r in toxicity(docs, m).collect())


def smith_waterman(a, b):
    s = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i][j] = max(0, s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 1, s[i][j - 1] - 1)
    return max(max(r) for r in s)


def test_equal_rows_are_dealt_to_all_groups(spark):
    pieces = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    got = pack(pieces, 2048, group_tokens=10_000).withColumn("grp", F.shiftright("sequence_id", 32)).groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("s")).collect()
    assert len(got) == 10 and max(r.n for r in got) < 12_000 and sum(r.n for r in got) == 100_000
    assert sum(r.s for r in got) <= 100_000 // 2048 + 1 + 10


def test_long_recordings_have_the_codes_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    x = (3000 * np.sin(np.cumsum(rng.normal(0.4, 0.2, 90_000))) + rng.normal(0, 300, 90_000)).astype(np.int16)
    whole = media.pack_filters(media.chroma(x[None].astype(np.float32), 4000))[0].view(np.int32)
    monkeypatch.setattr(media, "LONG", 9_000)
    got = np.concatenate(list(media.long_codes(x, 4000)))
    assert len(got) == len(whole) and (got == whole).mean() > 0.99  # but for roundings at a filter's thresholds


def test_filters_are_rectangle_sums():
    rng = np.random.default_rng(3)
    c = rng.random((1, 40, 12))
    got = media.pack_filters(c)[0]
    total = lambda x0, x1, y0, y1, k: c[0, k + x0 : k + x1, y0:y1].sum()
    same = 0
    for k in range(len(got)):
        code = 0
        for shape, y, h, w in media.FILTERS:
            whole = total(0, w, y, y + h, k)
            if shape == 0:
                part = total(0, w // 2, y, y + h, k)
            elif shape == 1:
                part = total(0, w, y, y + h // 2, k)
            elif shape == 2:
                part = total(0, w // 2, y, y + h // 2, k) + total(w // 2, w, y + h // 2, y + h, k)
            elif shape == 3:
                part = total(w // 3, w - w // 3, y, y + h, k)
            elif shape == 4:
                part = total(0, w, y + h // 3, y + h - h // 3, k)
            else:
                part, whole = whole, total(0, w, 0, 12, k)
            level = int(np.digitize(np.log((1 + part) / (1 + max(whole - part, 0))), media.LEVELS))
            code = code << 2 | int(media._GRAY[level])
        same += code == int(got[k])
    assert same >= len(got) - 1


def test_alignment_scores_match_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(1, 6) for _ in range(rng.randint(1, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(1, 20))]
        score, start, end = align(a, b)
        assert score == smith_waterman(a, b)
        if score:
            assert 0 <= start < end <= len(b) and smith_waterman(a, b[start:end]) == score


def test_contamination_finds_copies_and_edits_only(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(20)] + [(50, None), (51, ""), (52, "two words")]
    rows, want = [], set()
    for i in range(200):
        w = rng.choices(vocabulary, k=rng.randint(20, 300))
        if i % 5 == 0:
            k = i % 20
            part = items[k][1].split()
            for _ in range(i % 4):
                part[rng.randrange(30)] = rng.choice(vocabulary)
            if i % 10 == 0:
                part.insert(9, "extra")
            at = rng.randrange(len(w))
            w[at:at] = part
            want.add((i, k))
        rows.append((i, ", ".join(w).upper()))
    rows += [(900, None), (901, "")]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (5000, 7):
        got = find_contamination(docs, tests, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and all(0.5 <= r.score <= 1 for r in got)
    assert find_contamination(docs, tests.where("false")).count() == 0
    assert find_contamination(docs.where("false"), tests).count() == 0


def test_edited_copies_are_found_as_by_full_alignment(spark):
    rng = random.Random(21)
    names = [f"w{i}" for i in range(150)]
    items = [(k, " ".join(rng.choices(names, k=rng.randint(1, 36)))) for k in range(16)]
    rows = []
    for i in range(160):
        part = items[i % 16][1].split()
        if i % 4 == 0:  # evenly spread replacements, which leave no two or three words in a row
            part = [x if (j + 1) % (3 if i % 8 else 6) else f"new{i}" for j, x in enumerate(part)]
        elif i % 4 == 1:  # words between
            part = [y for x in part for y in ([x, "between"] if rng.random() < 0.5 else [x])]
        elif i % 4 == 2:
            for j in rng.sample(range(len(part)), int(len(part) * rng.uniform(0.15, 0.33))):
                part[j] = f"new{rng.randrange(10**6)}"
        w = rng.choices(names, k=rng.randint(0, 60))
        w[len(w) // 2 : len(w) // 2] = part
        rows.append((i, " ".join(w)))
    five = ["gone" if j in (3, 9, 14, 20, 26) else f"x{j}" for j in range(30)]
    items.append((100, " ".join(f"x{j}" for j in range(30))))
    rows += [(500, " ".join(five)), (501, items[-1][1])]
    want = {}
    for i, t in rows:
        for k, q in items:
            a, b = q.split(), t.split()
            if (s := smith_waterman(a, b)) >= len(a):
                want[i, k] = s / (2 * len(a))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in find_contamination(docs, tests).collect()}
    assert (500, 100) in got and got == pytest.approx(want)


def test_recordings_align_in_spite_of_offset_and_noise(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    sound = {r.rec_id: np.frombuffer(r.pcm, "<i2") for r in render(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    media = [(i, s.tobytes()) for i, s in sound.items()]
    for i in range(0, 20):
        late = np.concatenate([np.zeros(5 * HOP, "<i2"), sound[i], np.zeros(2 * HOP, "<i2")]) + rng.normal(0, 20, len(sound[i]) + 7 * HOP).astype("<i2")
        media.append((1000 + i, late.tobytes()))
    media += [(2000 + i, sound[0].tobytes()) for i in range(30)] + [(3000, None), (3001, b"\0" * (2 * FRAME)), (3002, b"x"), (None, sound[1].tobytes())]
    prints = fingerprints(spark.createDataFrame(media, "rec_id long, pcm binary"))
    every = align_recordings(prints, prints.rec_id < 20).collect()
    assert len(every) == prints.where("size(codes) > 0").select("codes").distinct().count()
    got = [r for r in every if r.query is not None]
    found = {(r.query, r.match): r for r in got}
    hit = [found.get((i, 1000 + i)) for i in range(20)]
    assert sum(h is not None and h.offset == 5 for h in hit) >= 18  # recall of 0.9 at least
    assert not [k for k in found if k[1] != 1000 + k[0]]
    assert len({r.match for r in got}) == len(got)
    assert prints.where("rec_id = 3000").first().codes == []


def test_every_pair_of_a_query_and_a_recording_is_found(spark, monkeypatch):
    rng = random.Random(31)
    prints = {i: [rng.choice((5, -7, 1 << 30, rng.randrange(-(2**31), 2**31))) for _ in range(rng.randint(20, 40))] for i in range(6)}
    for i in range(6, 40):  # shifted copies with some codes changed, so that many queries share codes
        prints[i] = [rng.randrange(-(2**31), 2**31) for _ in range(rng.randint(0, 4))] + [x ^ (rng.random() < 0.1) for x in prints[rng.randrange(6)]]
    prints |= {50: [7] * 30, 51: [7] * 34}
    asked = [*range(0, 12), 50]
    want = {}
    for q in asked:
        for m in prints:
            votes = {}
            for i, a in enumerate(prints[q]):
                for j, b in enumerate(prints[m]):
                    if a == b:
                        votes[j - i] = votes.get(j - i, 0) + 1
            if q == m or max(votes.values(), default=0) < 2:
                continue
            at = min(votes, key=lambda o: (-votes[o], o))
            pairs = [(a, prints[m][i + at]) for i, a in enumerate(prints[q]) if 0 <= i + at < len(prints[m])]
            wrong = sum(((a ^ b) & 0xFFFFFFFF).bit_count() for a, b in pairs)
            if len(pairs) >= 24 and wrong <= 0.1 * 32 * len(pairs):
                want[q, m] = at, len(pairs), wrong / (32 * len(pairs))
    assert max(sum(m == k for _, m in want) for k in prints) > 1
    df = spark.createDataFrame(list(prints.items()), "rec_id long, codes array<int>")
    for block in (1 << 21, 100):
        every = align_recordings(df, df.rec_id.isin(asked), block=block).collect()
        assert {r.match for r in every} == {min(k for k in prints if prints[k] == prints[i]) for i in prints}
        assert {(r.query, r.match): (r.offset, r.aligned, r.bit_errors) for r in every if r.query is not None} == want
    one = Asked([(0, 0, prints[0]), (50, 50, prints[50])])
    whole = [x.tolist() for x in one.best_offsets(np.array(prints[51], np.int32), 2)]
    monkeypatch.setattr("folioflow.llm.media.VOTES", 3)
    assert [x.tolist() for x in one.best_offsets(np.array(prints[51], np.int32), 2)] == whole == [[1], [0]]


def test_exact_copies_are_named_with_their_queries(spark):
    rng = random.Random(17)
    a, b = ([rng.randrange(-(2**31), 2**31) for _ in range(30)] for _ in range(2))
    near = [a[0] ^ 1, *a[1:]]
    prints = spark.createDataFrame([(1, a), (2, a), (3, a), (4, near), (5, near), (6, b), (7, []), (8, b[:9])], "rec_id long, codes array<int>")
    rows = search_recordings(prints, prints.rec_id.isin(2, 3, 8)).collect()
    assert {(r.rec_id, r.class_id, r.is_query, r.copies) for r in rows if r.kind == "member"} == {(1, 1, False, 3), (2, 1, True, 3), (3, 1, True, 3), (4, 4, False, 2), (5, 4, False, 2), (6, 6, False, 1), (7, None, False, None), (8, 8, True, 1)}
    assert {(r.class_id, r.query, r.offset, r.aligned, r.bit_errors) for r in rows if r.kind == "pair"} == {(1, 2, 0, 30, 0.0), (4, 2, 0, 30, 1 / 960), (8, 8, 0, 9, 0.0)}
    assert len(rows) == 8 + 3


@pytest.mark.parametrize("table", ["vec_id long, embedding array<float>"])
def test_media_of_an_empty_table(spark, table):
    prints = fingerprints(render(spark.createDataFrame([], table), "vec_id", "embedding"))
    assert align_recordings(prints, prints.rec_id > 0).count() == 0
