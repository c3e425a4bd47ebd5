"""URL filters: rules, aliases through redirects and canonical links, allow precedence."""

from __future__ import annotations

import random

import duckdb
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidebook.llm import urls as U

PAGES = "page_id long, url string, html string"


def canonical(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


def refresh(to):
    return f'<META http-equiv="Refresh" content="0; url={to}">'


def verdicts(spark, pages, **kw):
    rows = U.judge(spark.createDataFrame(pages, PAGES), **kw).collect()
    assert len(rows) == len(pages)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_rules(spark):
    got = verdicts(spark, [
        (1, "http://Example.COM/en/7x?q", None), (2, "https://example.com/en/8", None), (3, "http://com/en/", None), (4, "http://notcom/en/", None),
        (5, "x://a.example.net/de/81", None), (6, "x://b.net/de/", None), (7, "nothing", None), (8, None, None), (9, "http://shop.org?x/es/", None), (10, "http://shop.org/es/#f", None), (11, "a://b://c/en/", None),
    ])
    assert got == {
        1: ("example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("example.com", "/en/8", "com/en/", "block"),
        3: ("com", "/en/", "com/en/", "block"),
        4: ("notcom", "/en/", None, "allow"),
        5: ("a.example.net", "/de/81", "example.net/de/8", "block"),
        6: ("b.net", "/de/", "net/de/", "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("shop.org", "", None, "allow"),
        10: ("shop.org", "/es/", "org/es/", "block"),
        11: ("b:", "//c/en/", None, "allow"),
    }


def test_aliases_follow_blocks_and_allows(spark):
    got = verdicts(spark, [
        (1, "http://a.info/1", canonical("http://x.com/en/1")),  # alias of a blocked address
        (2, "http://a.info/2", refresh("/1")),  # relative, through page 1
        (3, "http://b.info/1", canonical("http://y.com/en/1")),
        (4, "http://b.info/2", canonical("//b.info/1")),
        (5, "http://b.info/1#part", canonical("http://z.net/de/1")),  # an allowed address in the same component
        (6, "http://c.info/dir/a", canonical("b?p=1&amp;q=2")),
        (7, "http://c.info/dir/b?p=1&q=2", refresh("http://w.org/es/")),
        (8, "http://d.info/", canonical("http://d.info/")),
        (9, "http://a.info/1", None),  # a repeated page follows its address
        (10, "http://x.com/en/1", canonical("http://n.net/de/1")),  # its own rule decides
        (11, "http://e.info/", canonical("http://x2.com/en/1")),
    ])
    assert {k: v[3] for k, v in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "block", 11: "block"}


def test_extra_edges(spark):
    log = spark.createDataFrame([("http://log.info/a", "http://q.com/en/"), ("bad", "http://q.com/en/")], "a string, b string")
    got = verdicts(spark, [(1, "http://log.info/a", None), (2, "bad", None)], extra_edges=log)
    assert (got[1][3], got[2][3]) == ("block", "allow")


def test_long_rule_lists_are_joined(spark, monkeypatch):
    pages = [(1, "http://Example.COM/en/7x", None), (2, "https://deep.er.com/en/8", None), (3, "x://b.net/de/", None), (4, "plain", None), (5, "http://a.info/", canonical("http://x.com/en/"))]
    inline = verdicts(spark, pages)
    monkeypatch.setattr(U, "INLINE_RULES", 0)
    assert verdicts(spark, pages) == inline


def test_ties_of_rules_go_one_way(spark, monkeypatch):
    """Random rule lists with ties: the inline expression, the join and a plain loop agree."""
    rng = random.Random(4)
    hosts, paths = ["com", "a.com", "b.a.com", "x.com"], ["", "/", "/x", "/xy", "/x/", "/xyz"]
    pages = [(i, f"http://{h}{p}", None) for i, (h, p) in enumerate((h, p) for h in [*hosts, "c.b.a.com", "q.org"] for p in paths)]
    places = spark.createDataFrame(pages, PAGES).select("page_id", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path")).cache()
    lists = [(("block", "a.com", "/"), ("block", "com", "/xy"))]
    lists += [tuple((rng.choice(("block", "allow")), rng.choice(hosts), rng.choice(paths)) for _ in range(rng.randint(1, 25))) for _ in range(5)]
    for rules in lists:
        want = {}
        for i, url, _ in pages:
            host, _, path = url[7:].partition("/")
            path = "/" + path if _ else ""
            fit = [(-len(h + p), a != "allow", a, h, p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            want[i] = (host, path, min(fit)[3] + min(fit)[4], min(fit)[2]) if fit else (host, path, None, None)
        for limit in (0, 200):
            monkeypatch.setattr(U, "INLINE_RULES", limit)
            rows = U.with_rule(places, rules, "host", "path").collect()
            assert {r.page_id: (r.host, r.path, r.rule, r.action) for r in rows} == want, (rules, limit)


EDGE_PAGES = [
    (1, "http://a.info/1", canonical("http://free.info/") + canonical("http://x.com/en/1")),  # the second tag blocks
    (2, "http://a.info/2", refresh("/none") + refresh("3") + refresh("http://y.com/en/1")),
    (3, "http://b.info", refresh("http://x.com/en/2")),  # an empty path is the path "/"
    (4, "http://b.info/", None),
    (5, "http://c.info/d/e/f?p=1", canonical("../../g")),
    (6, "http://c.info/g", canonical("http://z.com/en/")),
    (7, "http://c.info/./d/../g", None),
    (8, "http://e.info/file?x", canonical("?y=2")),
    (9, "http://e.info/file?y=2", refresh("https://w.org/es/")),
    (10, "http://f.info/", canonical("#top") + "<link rel=canonical href=>"),
    (11, "http://g.info/a/..", canonical("http://v.com/en/..")),  # v.com/ has no rule
    (12, "http://g.info/a/b", "<LINK HREF='http://u.com/en/' REL='Canonical'>"),
    (13, None, canonical("http://x.com/en/1")),
]


def test_all_tags_and_relative_targets(spark, tmp_path):
    got = verdicts(spark, EDGE_PAGES)
    assert {k for k, v in got.items() if v[3] == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 12}
    spark.createDataFrame(EDGE_PAGES, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert_same(U.op9_urls(spark, str(tmp_path)), con, U.ORACLE_SQL)


@pytest.mark.parametrize("html", [None, "", "canonical refresh", "<link rel=canonical>", "x" * 1_000_000 + canonical("http://x.com/en/")])
def test_odd_html(spark, html):
    assert verdicts(spark, [(1, "http://a.info/", html)])[1][3] == ("block" if html and len(html) > 99 else "allow")


def test_empty_and_clashes(spark):
    assert U.judge(spark.createDataFrame([], PAGES)).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/en/", None, "h", 4)], f"{PAGES}, host string, rule int")
    assert [r.verdict for r in U.judge(df).collect()] == ["block"]


def test_query(spark, small, sql):
    assert_same(U.op9_urls(spark, small), sql, U.ORACLE_SQL)
