from tidewell.llm.urls import DAMPING, ROUNDS, judge_sql, judge_urls

SCHEMA = "page_id long, url string, html string, host int"

PAGES = [
    (1, "https://A.Example.NET/en/x?q=1", '<a href="http://good.info/p">', 0),
    (2, "http://spam.net/x", "<a href=http://mid.info/>", 0),
    (3, "https://www.example.com/de/1#t", "", 0),
    (4, "https://www.example.com/fr/1", "<A HREF='https://spam.net/a'>x</A>", 0),
    (5, "http://x.org/fr/1", '<a href="http://good.info/"><a href="/local"><a href="http://x.org/self">', 0),
    (6, "http://good.info/", '<a href="http://friend.info/z">', 0),
    (7, "http://friend.info", None, 0),
    (8, "http://feeder.info/a", '<a href="http://spam.net/">', 0),
    (9, "http://feeder2.info/a", '<a href="http://feeder.info/?x=://">', 0),
    (10, "no scheme at all", "", 0),
    (11, None, '<a href="http://spam.net/">', 0),
    (12, "http://net", "", 0),
    (13, "http://net/", "", 0),
    (14, "ftp://notnet/x", "", 0),
    (15, "http://a.net?x", "", 0),
    (16, "://good.info/a://b/c", "", 0),
    (None, "http://spam.net/x", "", 0),
    (6, "http://good.info/", '<a href="http://friend.info/z">', 0),
]


def test_rules_and_graph(spark):
    got = {}
    for r in judge_urls(spark.createDataFrame(PAGES, SCHEMA)).collect():
        got[r.page_id] = r
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block")
    assert (got[3].rule, got[3].verdict, got[3].path) == ("example.com/de/", "block", "/de/1")
    assert (got[5].rule, got[5].verdict) == ("org/fr/", "allow")
    assert got[4].rule is None and got[4].verdict == "block"  # its host is a blocked seed
    assert got[6].verdict == got[7].verdict == "allow"
    assert got[8].verdict == got[9].verdict == "block"
    assert (got[10].host, got[10].path, got[10].verdict) == ("", "", "allow") == (got[11].host, got[11].path, got[11].verdict)
    assert (got[12].host, got[12].path, got[12].rule) == ("net", "", None)
    assert got[13].rule == "net/" and got[14].rule is None and got[15].rule is None
    assert (got[16].host, got[16].path) == ("good.info", "/a://b/c")


def test_against_slow_pagerank(spark):
    edges = {("good.info", "friend.info"): 2, ("a.example.net", "good.info"): 1, ("x.org", "good.info"): 1, ("spam.net", "mid.info"): 1, ("www.example.com", "spam.net"): 1, ("feeder.info", "spam.net"): 1, ("feeder2.info", "feeder.info"): 1}
    # Seeds by pages: trust a.example.net and x.org; distrust spam.net twice, www.example.com and net.
    seeds = {"trust": {"a.example.net": 0.5, "x.org": 0.5}, "distrust": {"spam.net": 0.5, "www.example.com": 0.25, "net": 0.25}}
    rank = {}
    for kind, s in seeds.items():
        e = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        r = dict(s)
        for _ in range(ROUNDS):
            new = {h: (1 - DAMPING) * v for h, v in s.items()}
            for (a, b), n in e.items():
                new[b] = new.get(b, 0) + DAMPING * r.get(a, 0) * n / sum(m for (x, _), m in e.items() if x == a)
            r = new
        rank[kind] = r
    for r in judge_urls(spark.createDataFrame(PAGES, SCHEMA)).collect():
        good, bad = rank["trust"].get(r.host, 0), rank["distrust"].get(r.host, 0)
        assert abs(r.distrust - (bad / (good + bad) if good + bad else 0)) < 1e-6, r


def test_same_rows_as_sql(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html", "n"]).astype({"page_id": "Int64"}))
    want = sorted(map(str, con.execute(judge_sql()).fetchall()))
    got = sorted(str(tuple(r)) for r in judge_urls(spark.createDataFrame(PAGES, SCHEMA)).select("page_id", "host", "path", "rule", "verdict", "distrust").collect())
    assert got == want


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def judged(spark, pages, **more):
    return {r.page_id: r for r in judge_urls(spark.createDataFrame([(i, u, h, 0) for i, u, h in pages], SCHEMA), **more).collect()}


def test_distrust_reaches_far_hosts(spark):
    last = 18
    pages = [(0, "http://spam.net/x", "")] + [(i, f"http://h{i}.info/", f'<a href="http://{f"h{i - 1}.info" if i > 1 else "spam.net"}/">') for i in range(1, last + 1)]
    got = judged(spark, pages)
    assert all((got[i].verdict, got[i].distrust) == ("block", 1.0) for i in range(1, last + 1))
    assert judged(spark, pages, rounds=ROUNDS)[last].verdict == "allow"


def test_ranks_settle_on_a_cycle(spark):
    pages = [
        (1, "http://bad.net/x", '<a href="http://a.info/">'),
        (2, "http://good.org/fr/x", '<a href="http://a.info/"><a href="http://far.info/">'),
        (3, "http://a.info/", '<a href="http://b.info/"><a href="http://bad.net/">'),
        (4, "http://b.info/", '<a href="http://c.info/">'),
        (5, "http://c.info/", '<a href="http://a.info/"><a href="http://good.org/">'),
    ]
    links = {("bad.net", "a.info"), ("good.org", "a.info"), ("good.org", "far.info"), ("a.info", "b.info"), ("a.info", "bad.net"), ("b.info", "c.info"), ("c.info", "a.info"), ("c.info", "good.org")}
    rank = {}
    for kind, seed in (("trust", "good.org"), ("distrust", "bad.net")):
        e = links if kind == "trust" else {(b, a) for a, b in links}
        r = {seed: 1.0}
        for _ in range(600):
            new = {seed: 1 - DAMPING}
            for a, b in e:
                new[b] = new.get(b, 0) + DAMPING * r.get(a, 0) / sum(x == a for x, _ in e)
            r = new
        rank[kind] = r
    for r in judged(spark, pages).values():
        good, bad = rank["trust"].get(r.host, 0), rank["distrust"].get(r.host, 0)
        assert abs(r.distrust - bad / (good + bad)) < 2e-9, r


def test_links_without_a_scheme_are_edges(spark):
    got = judged(spark, [(1, "http://spam.net/x", ""), (2, "http://one.info/", '<a href="//SPAM.net/x?u=http://other.info/">'), (3, "http://two.info/", '<a href="/spam.net/">')])
    assert got[2].verdict == "block" and got[3].verdict == "allow"
