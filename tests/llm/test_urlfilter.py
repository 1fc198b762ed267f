from heristat.llm import urlfilter as U
from tests.conftest import DATA, rows


def test_query(spark, duck):
    assert rows(U.query(spark.read.parquet(f"{DATA}/pages.parquet")).toPandas()) == rows(duck.sql(U.SQL).df())


def test_intervals_and_edges(spark):
    entries = spark.createDataFrame([("l", "a.com", 5, 1), ("l", "a.com", 5, 0), ("l", "a.com", 7, 1), ("l", "a.com", 10, 0), ("l", "a.com", 10, 0), ("l", "a.com", 20, 1), ("m", "x.a.com", 0, 1), ("m", None, 0, 1), ("m", "b.com", 3, 0)], "list string, rule string, day long, added int")
    assert sorted(map(tuple, U.intervals(entries).collect())) == [("l", "a.com", 5, 10), ("l", "a.com", 20, None), ("m", "x.a.com", 0, None)]
    captures = [(1, "http://a.com/", 4), (2, "HTTP://U:p@X.A.com.:80/q?z#f", 5), (3, "https://x.a.com", 10), (4, "https://notaa.com", 6), (5, None, 6), (6, "junk", 6), (7, "http://a.com", None), (8, "http://a.com", 20), (8, "http://a.com", 20), (None, "http://a.com", 9)]
    df = spark.createDataFrame(captures, "page_id long, url string, day long").selectExpr("*", "'x' AS host", "1 AS salt", "'y' AS spans")
    got = U.judge(df, entries).collect()
    assert sorted(((r.page_id or 0), r.lists, r.blocked) for r in got) == [(0, "l", 1), (1, "", 0), (2, "l,m", 1), (3, "m", 1), (4, "", 0), (5, "", 0), (6, "", 0), (7, "", 0), (8, "l", 1), (8, "l", 1)]
    assert U.judge(df, entries.filter("false")).filter("blocked = 1").count() == 0 and U.judge(df.filter("false"), entries).count() == 0


def test_hot_host_and_long_urls(spark):
    """A host with most of the captures, null and very long URLs, repeated rows and odd column names; against a loop."""
    urls = ["http://hot.example.com/%d" % k for k in range(2500)] + [f"https://h{k % 40}.b{k % 7}.org/{'x' * (k % 9)}" for k in range(300)] + [None, "", "no url", "http://hot.example.com/" + "y" * 2_000_000] * 2
    captures = spark.createDataFrame([(k // 2, u, None if k % 97 == 0 else k % 50, 1) for k, u in enumerate(urls)], "`a.id` long, url string, `on day` long, spans int")
    entries = [("ads", "example.com", 10, 1), ("ads", "example.com", 30, 0), ("ads", "example.com", 40, 1), ("mal", "hot.example.com", 20, 1), ("mal", "b3.org", 0, 1), ("mal", "h5.b5.org", 5, 1), ("mal", "h5.b5.org", 6, 0), ("ads", None, 1, 1)]
    got = U.judge(captures, spark.createDataFrame(entries, "list string, rule string, day long, added int"), "a.id", "url", "on day")
    assert got.columns == ["a.id", "host", "on day", "lists", "blocked"]

    def lists(url, day):
        name = url.split("/")[2] if url and "://" in url else ""
        on = set()
        for kind, rule, since, added in sorted((e for e in entries if e[1]), key=lambda e: e[2]):
            if day is not None and since <= day and (name == rule or name.endswith("." + rule)):
                (on.add if added else on.discard)((kind, rule))
        return ",".join(sorted({kind for kind, _ in on}))

    want = [(k // 2, lists(u, None if k % 97 == 0 else k % 50)) for k, u in enumerate(urls)]
    assert sorted((r[0], r.lists) for r in got.collect()) == sorted(want) and len({w for _, w in want}) == 4
