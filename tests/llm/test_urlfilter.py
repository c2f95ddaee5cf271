import itertools
import random
import re

from folioflow.llm.queries import URL_RULES
from folioflow.llm.urlfilter import judge_urls, mine_rules


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(-len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(min(fits)[1:] if fits else (None, "allow"))


def test_rules_match_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1", "http://example.com/en/7x", "https://x.net/de/1?q=://y", "http://example.net/de/80#x", "http://notexample.net/de/8", "ftp://org/es/", "http://a.org/es", "://com/en/", "http://com?x/en/", "http://x.com:80/en/1", "http://ÉX.com/en/1", "http://a.b.c.d.example.com/en/79\n", "http://" + "a." * 5000 + "com/en/" + "x/" * 5000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[4])]
    fixed = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    none = mine_rules(spark.createDataFrame([], "url string, blocked boolean"))
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), fixed, none).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted([(i, *brute(u)) for i, u in rows], key=key)


def test_mined_rules_block_token_combinations(spark):
    rows = [(f"http://s{i}.bets.example/promo/win/{i}", True) for i in range(60)] + [(f"http://s{i}.bets.example/news/{i}", False) for i in range(60)] + [(f"http://s{i}.site.example/promo/{i}", False) for i in range(60)]
    mined = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), least_rows=20, confidence=0.9)
    tokens = {tuple(r.tokens) for r in mined.collect()}
    assert ("p:win",) in tokens and ("h:bets", "p:promo") in tokens and ("h:bets", "p:promo", "p:win") not in tokens
    pages = spark.createDataFrame([(1, "http://new.bets.example/promo/x"), (2, "http://new.bets.example/news/x"), (3, "http://new.site.example/promo/x"), (4, None)], "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string"), mined)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def brute_rules(rows, least, lift, z):
    labels = {}
    for url, bad in rows:
        if url is not None and bad is not None:
            labels.setdefault(url, []).append(bad)
    urls = {u: sum(b) / len(b) >= 0.5 for u, b in labels.items()}
    tokens = {u: {f"h:{x}" for x in u.split("/")[2].split(".")} | {f"p:{x}" for x in u.split("/")[3:] if x} for u in urls}
    at = {}
    for u, t in tokens.items():
        for x in t:
            at.setdefault(x, set()).add(u)
    items = {}
    for x, us in at.items():
        items.setdefault(frozenset(us), set()).add(x)
    items = {min(m): (us, m) for us, m in items.items() if len(us) >= least}
    base = sum(urls.values()) / len(urls)
    count = {}
    for k in range(1, len(items) + 1):
        for s in itertools.combinations(sorted(items), k):
            us = set.intersection(*(set(items[x][0]) for x in s))
            if us:
                count[frozenset(s)] = (len(us), sum(urls[u] for u in us))
    out = {}
    for s, (n, hits) in count.items():
        clear = hits >= max(1, least) and hits >= n * base + z * (n * base * (1 - base)) ** 0.5 and hits / n >= lift * base
        if clear and not any(o < s and count[o][1] / count[o][0] >= hits / n for o in count):
            out[tuple(sorted(set().union(*(items[x][1] for x in s))))] = hits / n
    return out


def test_mining_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        host, lang = rng.choice(["a.bets", "b.bets", "news", "blog.site"]), rng.choice(["en", "de", "fr"])
        rows.append((f"http://{host}.example/{lang}/{i}", rng.random() < (0.8 if "bets" in host and lang == "en" else 0.5 if lang == "fr" else 0.2)))
    rows += [rows[0]] * 3 + [(rows[1][0], not rows[1][1]), (None, True), (rows[2][0], None)]
    got = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), least_rows=10, lift=1.1, z=1.0, confidence=0.0).collect()
    assert {tuple(r.tokens): r.confidence for r in got} == brute_rules(rows, 10, 1.1, 1.0) and len(got) > 2


def test_long_urls_that_repeat_end(spark):
    url = "http://a.b.example/" + "/".join(f"s{i}" for i in range(16))
    rows = [(url, True)] * 30 + [(f"{url}/{i}", True) for i in range(30)] + [(f"http://other.example/{i}", False) for i in range(60)]
    got = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert {r.confidence for r in got} == {1.0} and len(got) == 1 and len(got[0].tokens) == 18


def test_no_rule_below_one_half_decides(spark):
    """A token that doubles the share of blocked URLs, to two fifths, blocks none of them; one with four fifths does; combinations count."""
    rows = [(f"http://{h}.example/{lang}/{i}", i % 10 < n) for h, lang, n in (("a", "fr", 4), ("b", "de", 1), ("c", "en", 1), ("c", "de", 8), ("d", "en", 1), ("e", "nl", 1)) for i in range(200)]
    got = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), least_rows=10)
    assert all(r.confidence >= 0.5 and len(r.tokens) > 1 for r in got.collect()) and got.count() > 0
    low = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), least_rows=10, confidence=0.0)
    assert min(r.confidence for r in low.collect()) < 0.5
