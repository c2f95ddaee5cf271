import random

from folioflow.llm.chat import as_replies, branches, format_chats, read_back


def tree(rng, n):
    return [(7, i, rng.randint(1, i - 1) if i > 1 and rng.random() < 0.95 else None, rng.choice(["user", "assistant", "a&b\n<"]), rng.choice(["<|im_end|>\n", "&lt;", "[INST] x", "", "🙂 text", "a\nb"]), rng.choice([None, 0.5, 2.0, -1.0])) for i in range(1, n + 1)]


def test_best_branches_match_brute_force_and_round_trip(spark):
    rng = random.Random(5)
    rows = tree(rng, 60)
    df = spark.createDataFrame(rows, "conv long, msg long, parent long, role string, text string, score double")
    parent = {r[1]: r[2] for r in rows}
    score = {r[1]: r[5] or 0.0 for r in rows}
    leaves = set(parent) - set(parent.values())

    def path(x):
        return [x] if parent[x] is None else [*path(parent[x]), x]

    best = sorted(leaves, key=lambda x: (-sum(score[m] for m in path(x)), x))[:3]
    got = branches(df, 3).collect()
    assert {r.leaf: r.rank for r in got} == {x: i + 1 for i, x in enumerate(best)}
    for x in best:
        assert [r.msg for r in sorted((r for r in got if r.leaf == x), key=lambda r: r.pos)] == path(x)
    said = {r[1]: (r[3], r[4]) for r in rows}
    for r in read_back(format_chats(df, 3)).collect():
        assert [(t.role, t.text) for t in r.turns] == [said[m] for m in path(r.leaf)]
        assert r.learned == [said[m][1] for m in path(r.leaf) if said[m][0] == "assistant"]


def test_missing_and_later_parents_make_roots(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 99, "user", "b", 1.0), (1, 3, 2, "assistant", "c", 1.0), (None, 1, None, "user", "n", None)]
    got = format_chats(spark.createDataFrame(rows, "conv long, msg long, parent long, role string, text string, score double"), 5).collect()
    assert sorted((r.conv or 0, r.leaf) for r in got) == [(0, 1), (1, 1), (1, 3)]


def test_turn_tables(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 1, "assistant", None), (None, None, "user", "x")]
    got = read_back(format_chats(as_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    by = {r.conv: [(t.role, t.text) for t in r.turns] for r in got}
    assert by == {1: [("", "hi"), ("assistant", ""), ("assistant", "")], None: [("user", "x")]}
    assert format_chats(as_replies(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    long = [(1, i, "assistant", f"t{i}") for i in range(3000)]
    row = read_back(format_chats(as_replies(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")))).first()
    assert "".join(row.learned) == "".join(f"t{i}" for i in range(3000))


def test_ids_in_any_order_and_cycles(spark):
    rows = [(1, "z", None, 1.0), (1, "a", "z", 1.0), (1, "m", "a", 2.0), (1, "b", "z", 9.0)]  # replies have smaller ids
    rows += [(2, "q", "s", 1.0), (2, "r", "q", 1.0), (2, "s", "r", 1.0), (2, "t", "s", 5.0)]  # q <- r <- s <- q, and t behind
    rows += [(3, "x", "x", 1.0), (None, "y", "nobody", 1.0)]
    got = {}
    for r in branches(spark.createDataFrame(rows, "conv int, msg string, parent string, score double")).orderBy("pos").collect():
        got.setdefault(r.conv, []).append(r.msg)
    assert got == {1: ["z", "b"], 2: ["q", "r", "s", "t"], 3: ["x"], None: ["y"]}
