from treeloom.llm import url_filter as op

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_host_path_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.NET/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"), 2: ("http://example.net/de", "example.net", "/de", "net/", "block"),
        3: ("http://xnet/", "xnet", "/", None, "allow"), 4: ("http://net", "net", "", None, "allow"), 5: ("no scheme.net/x", "", "", None, "allow"), 6: (None, "", "", None, "allow"),
        7: ("a://b.example.com/de/?x://y", "b.example.com", "/de/", "example.com/de/", "block"), 8: ("x?y://z.org/fr/a#b", "z.org", "/fr/a", "org/fr/", "allow"),
        9: ("http://A.net?x=/y", "a.net", "", None, "allow"), 10: ("http://", "", "", None, "allow"), 11: ("", "", "", None, "allow"), 12: ("http://É.net/ä#", "É.net", "/ä", "net/", "block"),
    }
    pages = spark.createDataFrame([(k, u[0], "h", "r") for k, u in urls.items()] + [(1, urls[1][0], "h", "r")], "page_id long, url string, host string, rule string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in op.judge(pages, rules(spark), no_links(spark)).collect()]
    assert sorted(got) == sorted([(k, *u[1:]) for k, u in urls.items()] + [(1, *urls[1][1:])])
    assert op.judge(pages.where("false"), rules(spark), no_links(spark)).collect() == []


def rules(spark):
    return op.rules(spark, [r[:2] for r in RULES if r[2] == "block"], [r[:2] for r in RULES if r[2] == "allow"])


def no_links(spark):
    return spark.createDataFrame([], "source string, target string")


def test_blocks_spread_to_aliases_unless_allowed(spark):
    urls = ["http://a.info/1", "http://b.info/1", "http://c.net/1", "http://d.info/", "http://e.org/fr/", "http://f.info", "http://g.info/"]
    links = [
        ("http://A.info/1#x", "http://b.info/1"), ("http://b.info/1", "http://only-linked.info/"), ("http://only-linked.info/", "http://c.net/1"),
        ("http://d.info/", "http://x.net/"), ("http://e.org/fr/", "http://d.info/"), ("http://f.info", None), (None, "http://f.info"), ("http://f.info", "http://f.info/"),
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["aliases"]) for r in op.judge(pages, rules(spark), spark.createDataFrame(links, "source string, target string")).collect()}
    assert got == {0: ("block", 3), 1: ("block", 3), 2: ("block", 3), 3: ("allow", 2), 4: ("allow", 2), 5: ("allow", 0), 6: ("allow", 0)}


def test_links_in_pages(spark):
    html = [
        '<LINK rel="canonical" href="/x?a=1&amp;b=2">', "<link href='//o.net/y' rel=canonical>", '<meta http-equiv="Refresh" content="0; url=z.html">', "<p>canonical</p>", None, "",
        '<link rel="stylesheet" href="q"><link rel="canonical" href="?p">',
    ]
    pages = spark.createDataFrame([("http://h.com/d/e?q", x) for x in html] + [(None, html[0])], "url string, html string")
    assert {r["target"] for r in op.links_in_pages(pages).collect()} == {"http://h.com/x?a=1&b=2", "http://o.net/y", "http://h.com/d/z.html", "http://h.com/d/e?p"}
