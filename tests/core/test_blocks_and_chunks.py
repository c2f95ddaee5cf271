import random

import pytest

from folioflow.operators import blocks as B
from folioflow.operators import chunking as K
from folioflow.operators.changes import diff_chunks, reuse_embeddings


def parsed(spark, body, **how):
    return [(r.kind, r.level, r.text) for r in B.normalize_pages(spark.createDataFrame([(1, body)], "page_id long, body string"), **how).orderBy("pos").collect()]


def test_block_kinds(spark):
    body = "<h1>Top</h1><p>One  two</p><h2>Sub</h2><table><tr><td>a</td><td>b</td></tr></table><ac:structured-macro ac:name='code'><ac:plain-text-body><![CDATA[x < 1]]></ac:plain-text-body></ac:structured-macro><ul><li>i</li><li>j</li></ul>"
    want = [("heading", 1, "Top"), ("paragraph", 0, "One two"), ("heading", 2, "Sub"), ("table", 0, "a b"), ("code", 0, "x < 1"), ("list", 0, "i j")]
    assert parsed(spark, body) == want
    assert [k for k, *_ in parsed(spark, body, keep_cdata=False)] == ["heading", "paragraph", "heading", "table", "list"]
    assert parsed(spark, "<ac:structured-macro ac:name='warning'><p>Careful</p><p>then</p></ac:structured-macro>") == [("panel", 0, "Careful"), ("paragraph", 0, "then")]
    assert parsed(spark, "<p>a</p><script>var x</script>") == [("paragraph", 0, "a")]
    assert parsed(spark, "") == parsed(spark, None) == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("a <b>b</b> c", [("paragraph", 0, "a b c")]),
        ("<p title='x > y'>in</p>", [("paragraph", 0, "in")]),
        ("1 < 2 &amp; 3 <", [("paragraph", 0, "1 < 2 & 3 <")]),
        ("<!-- <h1>no</h1> --><H2>Yes</H2>", [("heading", 2, "Yes")]),
        ("<h1>open <p>then", [("heading", 0, "open then")]),
        ("<ul/><table><tr><td>x</td></tr>", [("table", 0, "x")]),
        ("<style>p { }</style>t<script>if (a < b) { '<h1>x</h1>' }</script>u", [("paragraph", 0, "t u")]),
        ("<p>\u0065\u0301</p>", [("paragraph", 0, "\u00e9")]),
        ('<a href="unclosed>x</a><p>y', [("paragraph", 0, 'x y')]),
        ("<![CDATA[never closed", [("paragraph", 0, "never closed")]),
    ],
)
def test_broken_bodies_give_their_text(spark, body, want):
    got = parsed(spark, body)
    assert got == want or body.startswith("<a href") and " ".join(t for *_, t in got).endswith("y")


def stack(blocks):
    out, now = [], []
    for kind, level, text in blocks:
        if kind == "heading":
            now = [x for x in now if x[0] < level] + [(level, text)]
        out.append([t for _, t in now])
    return out


def test_heading_paths_equal_a_stack(spark):
    rng = random.Random(1)
    pages = {p: [("heading", rng.randint(1, 6), f"h{i % 4}") if rng.random() < 0.5 else ("paragraph", 0, f"t{i}") for i in range(40)] for p in range(30)}
    df = spark.createDataFrame([(p, i, *b) for p, bs in pages.items() for i, b in enumerate(bs)], "page_id long, pos int, kind string, level int, text string")
    got = {}
    for r in B.build_sections(B.heading_paths(df)).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.path, r.section, r.sibling_ordinal))
    for p, bs in pages.items():
        paths, section, seen, ordinal, want = stack(bs), 0, {}, {}, []
        for i, (kind, _, _) in enumerate(bs):
            section += kind == "heading"
            if section not in ordinal:
                key = tuple(paths[i]) if kind == "heading" else ()
                ordinal[section] = seen[key] = seen.get(key, -1) + 1
            want.append((paths[i], section, ordinal[section]))
        assert got[p] == want


def windows(text, most, overlap):
    """Counts each candidate anew."""
    if K.count(text) <= most:
        return [text] if text.strip() else []
    atoms = [p for w in text.split() for p in ([w] if K.count(w) <= most else [w[i : i + 4 * most] for i in range(0, len(w), 4 * most)])]
    out, now = [], []
    for a in atoms:
        if now and K.count(" ".join([*now, a])) > most:
            out.append(" ".join(now))
            tail, total = [], 0
            for x in reversed(now):
                if total + K.count(x) > overlap:
                    break
                tail, total = [x, *tail], total + K.count(x)
            now = [*tail, a]
            while len(now) > 1 and K.count(" ".join(now)) > most:
                now.pop(0)
        else:
            now.append(a)
    return [*out, " ".join(now)]


def test_windows_equal_recounting():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join("x" * rng.choice([1, 2, 3, 8, 30, 120]) for _ in range(rng.randint(0, 120)))
        most = rng.randint(5, 40)
        overlap = rng.randint(0, most - 1)
        got = K.split_windows(text, most, overlap)
        assert got == windows(text, most, overlap) and all(K.count(w) <= most for w in got)
    with pytest.raises(ValueError):
        K.split_windows("a", 3, 3)


def test_parents_and_children():
    unit = "word " * 500
    assert K.pack_parents([unit.strip()] * 3) == ["\n".join([unit.strip()])] * 3
    assert K.pack_parents(["a", "b"]) == ["a\nb"]
    huge = "word " * 2500
    assert all(K.count(p) <= 1200 for p in K.pack_parents(["a", huge, "b"])) and K.pack_parents(["a", huge, "b"])[0] == "a"
    assert K.split_children("short") == ["short"]
    parts = K.split_children("abcd " * 900)
    assert len(parts) > 1 and all(K.count(p) <= 400 + 150 for p in parts)


def test_plan_and_links(spark):
    body = "<p>lead</p><h1>A</h1><p>one</p><h1>Empty</h1><h1>A</h1><p>two</p>"
    planned = K.link_chunks(K.plan_chunks(B.build_sections(B.heading_paths(B.normalize_pages(spark.createDataFrame([(1, body)], "page_id long, body string"))))))
    rows = planned.orderBy("seq").collect()
    assert [(r.kind, r.text, r.sibling) for r in rows if r.kind == 1] == [(1, "lead", 0), (1, "A\none", 0), (1, "Empty", 0), (1, "A\ntwo", 1)]
    kids = [r for r in rows if r.kind == 1]
    assert kids[0].prev_key is None and kids[-1].next_key is None and kids[1].prev_key == kids[0].stable_key
    assert all(k.parent_key == next(r.stable_key for r in rows if r.kind == 0 and r.section == k.section) for k in kids)
    assert len({r.stable_key for r in rows}) == len(rows)


def test_chunks_are_dealt_by_page_alone_and_linked_within_their_section(spark):
    body = "<h2>a&gt;b</h2><p>one</p><h1>a</h1><h2>b</h2><p>two</p>"  # two sections whose trails read alike
    blocks = B.normalize_pages(spark.createDataFrame([(1, body), (2, None), (None, body)], "page_id long, body string"))
    linked = K.link_chunks(K.plan_chunks(B.build_sections(B.heading_paths(blocks))))
    rows = linked.orderBy("seq").collect()
    assert [(r.seq, r.section, r.kind, r.text, r.tokens) for r in rows] == [(2 * n + k, n + 1, k, t, K.count(t)) for n, t in enumerate(["a>b\none", "a", "b\ntwo"]) for k in (0, 1)]
    assert [r.parent_key for r in rows] == [x for r in rows[::2] for x in (None, r.stable_key)]
    plan = linked.drop("path", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page_id") == plan.count("Exchange ") == 2  # blocks, then keys of chunks


def keyed(spark, chunks):
    return spark.createDataFrame([(1, i, p + c, c, p) for i, (p, c) in enumerate(chunks)], "page_id long, idx int, stable_key string, content_key string, positional_key string")


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ([("p0", "a"), ("p1", "b")], [("p0", "a"), ("p2", "b"), ("p1", "c")], {(0, 0, "exact"), (1, 1, "moved"), (2, None, "inserted")}),
        ([("p0", "a"), ("p1", "b")], [("p0", "a"), ("p2", "c")], {(0, 0, "exact"), (1, None, "inserted"), (None, 1, "deleted")}),
        ([("p0", "a"), ("p1", "a")], [("p2", "a"), ("p3", "a"), ("p4", "a")], {(0, 0, "moved"), (1, 1, "moved"), (2, None, "inserted")}),
        ([("p0", "a")], [("p0", "z")], {(0, 0, "edited")}),
        ([], [("p0", "a")], {(0, None, "inserted")}),
    ],
)
def test_chunk_diff(spark, old, new, want):
    a, b = keyed(spark, old), keyed(spark, new)
    d = diff_chunks(a, b)
    assert {(r.new_idx, r.old_idx, r.outcome) for r in d.collect()} == want
    had = a.selectExpr("*", "content_key AS retrieval_text", "array(cast(idx AS float)) AS embedding")
    carried, rest = reuse_embeddings(d, had, b)
    reused = {n for n, _, o in want if o in ("exact", "moved")}
    assert {r.idx for r in carried.collect()} == reused and {r.idx for r in rest.collect()} == set(range(len(new))) - reused
