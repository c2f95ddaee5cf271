import random
import re

from folioflow.llm.linededup import dedup_lines, drop_repeated_lines
from folioflow.llm.substring import remove_repeats

STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_lines(rows):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(ascii_lower(line.strip(STRIP)), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(k := ascii_lower(x.strip(STRIP))) >= 10 and len(held[k]) > 1 and i > min(held[k]))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def brute_repeats(rows, n):
    first = {}
    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def documents():
    rng = random.Random(11)
    lines = ["A shared line here", " a SHARED line here\t", "short", "Éa shared line", "unique", "", "ÀÀÀÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀÀ", "x" * 9, "y" * 10, "\x0bvertical tab line\x0c", "a no-break space line"]
    rows = [(i, "\n".join(rng.choice(lines) + (str(i) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 8)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "A shared line here\r"), (104, "word " * 30_000)]


def test_line_dedup_matches_brute_force(spark):
    rows = documents()
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted(brute_lines(rows))
    every = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), most_bits=8)  # no filter: the exact path
    assert sorted(map(tuple, every.collect())) == sorted(brute_lines(rows))


def test_line_dedup_odd_rows(spark):
    rows = [(None, "A shared line here"), (1, "A shared line here\nx"), (1, "A shared line here\nx"), (2, "a shared line HERE"), (None, "A shared line here")]
    got = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 1, 0, "A shared line here")] * 2 + [(1, 2, 0, "A shared line here\nx")] * 2 + [(2, 1, 1, "")], key=str)
    df = spark.createDataFrame([(1, "A shared line here", 5, "d"), (2, "A shared line here\nz", 6, "d"), (3, None, 7, None)], "doc_id long, text string, rid int, drop string")
    assert sorted(map(tuple, drop_repeated_lines(df).collect())) == [(1, "A shared line here", 5, "d"), (2, "z", 6, "d"), (3, None, 7, None)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passages():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2)
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 100)
            at = rng.randint(0, len(w))
            w[at:at] = base[a : a + rng.randint(3, 40)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ""), (74, "same " * 500), (75, "same " * 300), (76, "é x " * 20), (77, "é x " * 19)]


def test_substring_dedup_matches_brute_force(spark):
    rows = passages()
    for window in (5, 13):
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window)
        assert sorted(map(tuple, got.collect())) == sorted(brute_repeats(rows, window))
    every = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13, most_bits=8)
    assert sorted(map(tuple, every.collect())) == sorted(brute_repeats(rows, 13))


def test_substring_dedup_salts_hot_shards(spark, monkeypatch):
    from folioflow.llm import substring

    monkeypatch.setattr(substring, "SHARD", 3)
    rows = passages()
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13)
    assert sorted(map(tuple, got.collect())) == sorted(brute_repeats(rows, 13))


def test_substring_dedup_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(15))
    rows = [(None, text), (1, text), (1, text), (2, text + " more"), (3, text)]
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 15, 0), (1, 15, 0), (1, 15, 0), (2, 16, 15), (3, 15, 15)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
