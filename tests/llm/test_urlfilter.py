import random
from urllib.parse import urljoin

from rankweave.llm import urlfilter as U
from rankweave.llm.components import connected_components
from rankweave.llm.queries import ORACLE_SQL, URL_RULES, op9_url_filter
from tests.compare import connected, spark_rows, sql_rows

PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://b.org/y">'), (2, "http://b.org/y", None), (3, "http://c.org/z", '<meta http-equiv="refresh" content="0; url=/y2">'),
    (4, "http://c.org/y2", '<link href="https://x.example.com/de/1" rel=canonical>'), (5, None, "x"), (6, "nourl", ""), (7, "http://q.net", ""), (8, "http://E.example.NET/en/a?x#y", ""),
    (9, "http://d.org/fr/1", "<link rel=canonical href='http://e.com/y'>"), (10, "http://e.com/y", None), (11, "http://f.net/", "<link rel=canonical href='http://e.com/y'>"), (12, "http://notexample.net.com/", ""), (12, "http://notexample.net.com/", ""),
]


def test_rules_aliases_and_precedence(spark):
    df = spark.createDataFrame([(*p, "old") for p in PAGES], "page_id int, url string, html string, rule string")
    out = U.judge(df.drop("html"), URL_RULES, U.page_edges(df))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(PAGES) and out.columns.count("rule") == 1
    assert got[1] == ("a.net", "/x", "net/", "block")
    assert got[2][2:] == (None, "block")  # an alias of a blocked address
    assert got[3][3] == got[4][3] == "block"  # by way of an address that no page has
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("q.net", "", None, "allow")
    assert got[8] == ("e.example.net", "/en/a", "example.net/en/", "allow")
    assert got[10][3] == "allow" and got[11][3] == "block"  # an allowed alias wins over a blocked one, a rule over both
    assert got[12][2:] == (None, "allow")
    assert U.judge(df.where("false").drop("html"), URL_RULES, U.page_edges(df.where("false"))).count() == 0
    assert {r.verdict for r in U.judge(df.drop("html"), [], U.page_edges(df)).collect()} == {"allow"}


def test_links_resolve_as_the_standard_says(spark):
    pages = ["http://a.b/c/d;p?q", "http://a.b/c/d", "https://a.b", "http://a.b/", "http://a.b/x/y/z/?r#s"]
    links = "g ./g g/ /g //g.h ?y g?y #s g#s ;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/../y g?y/../x https://o.p".split()
    rows = [(p, k) for p in pages for k in links]
    got = {}
    for p in pages:
        found = U._resolved(spark.createDataFrame([(p, k) for k in links], "source string, link string").coalesce(1)).collect()
        got |= {(p, k): r.target for k, r in zip(links, found, strict=True)}

    for p, k in rows:
        assert got[p, k].split("#")[0] == urljoin(p, k).split("#")[0], (p, k)
    odd = U._resolved(spark.createDataFrame([("http://a.b/", "mailto:x@y.z"), ("http://a.b/", "http://o.p/q/../r")], "source string, link string").coalesce(1))
    assert [r[0] for r in odd.select(U.alias_key(U.F.col("target"))).collect()] == [None, "o.p/r"]  # the library keeps such dots


def test_aliases_as_sql(spark, data):
    from rankweave.llm.queries import url_alias_verdicts

    rows = spark_rows(url_alias_verdicts(spark, data))
    assert rows == sql_rows(connected(data), ORACLE_SQL["url_alias_verdicts"]) != spark_rows(op9_url_filter(spark, data))
    plan = url_alias_verdicts(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_components_equal_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 800)] + [(None, 3), (9, None), (900, 900)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_as_sql(spark, data):
    assert spark_rows(op9_url_filter(spark, data)) == sql_rows(connected(data), ORACLE_SQL["op9_url_filter"])


def test_main_path_is_native(spark, data):
    plan = op9_url_filter(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
