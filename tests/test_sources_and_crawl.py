from pyspark.sql import functions as F

from sitegauge.catalog import queries
from sitegauge.operators import crawl, export
from sitegauge.plans.staging import join_by_group
from sitegauge.sources import sitemaps
from sitegauge.streaming import logs

RES = "url string, status int, content_type string, body string"


def test_sitemaps(spark):
    rows = [
        ("https://a.test/robots.txt", 200, None, "Sitemap: /s.xml # x\nSITEMAP: https://a.test/none.xml"),
        ("https://a.test/s.xml", 200, None, "<x:sitemapindex><x:sitemap><x:loc>https://a.test/s.xml</x:loc></x:sitemap><x:sitemap><x:loc>/c.xml</x:loc></x:sitemap></x:sitemapindex>"),
        ("https://a.test/c.xml", 200, None, "<urlset><url><loc> https://a.test/p </loc><image:loc>https://a.test/i.png</image:loc></url></urlset>"),
        ("https://b.test/sitemap.xml", 200, None, None), ("https://c.test/robots.txt", 404, None, "Sitemap: /x"),
    ]
    r = spark.createDataFrame(rows + rows[:1], RES)
    found = {x.site_host: x.sitemap for x in sitemaps.discovered(r).collect()}
    assert found == {"a.test": "https://a.test/s.xml", "b.test": "https://b.test/sitemap.xml"}
    roots = spark.createDataFrame([("https://a.test/", "https://a.test/s.xml")], "base string, sitemap string")
    assert [x.loc for x in sitemaps.expand(roots, r).collect()] == ["https://a.test/p"]
    assert sitemaps.parsed(spark.createDataFrame([], RES)).count() == 0


def test_breadth_first(spark):
    u = lambda x: f"https://a.test/{x}"
    graph = spark.createDataFrame([(u("1"), 0, u("2")), (u("1"), 1, u("3")), (u("2"), 0, u("1")), (u("3"), 0, u("4")), (u("4"), 0, "https://b.test/"), (u("1"), 2, None), (u("2"), 1, u("9"))], "src string, ordinal int, dst string")
    fetched = spark.createDataFrame([(u(k),) for k in "1234"], "url string")
    seeds = spark.createDataFrame([("a.test", u("1"), 0)], "site string, url string, position long")
    edges = crawl.canonical_edges(graph)
    order = [r.url for r in crawl.breadth_first(seeds, edges, fetched).orderBy("position").collect()]
    assert order == [u(k) for k in "1234"]
    assert crawl.breadth_first(seeds, edges, fetched, max_pages=2).count() == 2


def test_breadth_first_has_no_depth_limit(spark):
    u = lambda k: f"https://a.test/{k:02}"
    graph = spark.createDataFrame([(u(k), 0, u(k + 1)) for k in range(13)], "src string, ordinal int, dst string")
    fetched = spark.createDataFrame([(u(k),) for k in range(14)], "url string")
    seeds = spark.createDataFrame([("a.test", u(0), 0)], "site string, url string, position long")
    found = crawl.breadth_first(seeds, crawl.canonical_edges(graph), fetched).orderBy("position").collect()
    assert [(r.url, r.depth) for r in found] == [(u(k), k) for k in range(14)]


def test_crawl_starts_from_sitemap_and_root(spark, tmp_path):
    u = lambda x: f"https://www.a.test/{x}"
    listed = "".join(f"<url><loc>https://a.test/{x}</loc></url>" for x in ("z", "y", "gone", "z", "p.pdf"))
    res = [("https://a.test/sitemap.xml", 200, "text/xml", f"<urlset>{listed}</urlset>")]
    spark.createDataFrame(res, RES).write.parquet(str(tmp_path / "site_resources.parquet"))
    fetches = [(u(x), 200, "<p>") for x in ("", "b", "y", "z", "lone")]
    pages = spark.createDataFrame(fetches, "url string, status_code int, html string").withColumn("headers", F.lit(None).cast("map<string,array<string>>"))
    pages.withColumn("page_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "page_fetch.parquet"))
    spark.createDataFrame([(u("y"), 0, u("b"))], "src string, ordinal int, dst string").write.parquet(str(tmp_path / "link_graph.parquet"))
    found = queries()["crawl_bfs"](spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.url, r.depth) for r in found] == [(u(""), 0), (u("z"), 0), (u("y"), 0), (u("b"), 1)]


def test_crawl_seeds_leave_no_slot(spark):
    u = lambda x: f"https://a.test/{x}"
    told = spark.createDataFrame([("https://a.test/", u(x), f"/{k}") for k, x in enumerate("cab")], "base string, loc string, position string")
    seeds = lambda root, n: [r.url[-1] for r in crawl.crawl_seeds(told, spark.createDataFrame([("a.test", u(root))], "site string, url string"), n).orderBy("position").collect()]
    assert [seeds("r", 4), seeds("r", 3), seeds("a", 9), seeds("r", 2)] == [list("rcab"), list("cab"), list("cab"), list("ca")]


def test_crawl_statistics(spark):
    u = lambda x: f"https://a.test/{x}"
    site, base = "a.test", "https://a.test/"
    crawled = spark.createDataFrame([(site, u("1")), (site, u("2"))], "site string, url string")
    told = spark.createDataFrame([(base, u("2"), "/0"), (base, u("9"), "/1"), (base, u("9"), "/2")], "base string, loc string, position string")
    roots = spark.createDataFrame([(site, u("1")), ("b.test", "https://b.test/")], "site string, url string")
    graph = spark.createDataFrame([(u("1"), 0, u("2")), (u("1"), 1, u("8")), (u("2"), 0, u("8")), (u("2"), 1, u("8")), (u("7"), 0, u("1"))], "src string, ordinal int, dst string")
    pages = spark.createDataFrame([(1, u("1"), 200), (2, u("2"), 404), (3, u("7"), 404), (4, "https://b.test/", 200)], "page_id long, url string, status_code int")
    out = {r.site: tuple(r)[1:] for r in crawl.crawl_statistics(crawled, told, roots, crawl.canonical_edges(graph), pages).collect()}
    assert out == {"a.test": (3, 3, 3, 2, 1), "b.test": (0, 0, 0, 0, 0)}


def test_redirects(spark):
    hops = [(f"https://a.test/{i}", 301, f"/{i + 1}") for i in range(9)] + [("https://a.test/e", 500, None)]
    r = spark.createDataFrame(hops, "url string, status int, location string")
    start = spark.createDataFrame([("https://a.test/0",), ("https://a.test/6",), ("https://a.test/e",)], "url string")
    out = {x.url[-1]: (x.outcome, x.hops) for x in crawl.redirect_chains(start, r).collect()}
    assert out["6"] == ("ok", 3) and out["0"][0] == "too many redirects" and out["e"][0] == "HTTP 500"


def test_csv_field(spark):
    df = spark.createDataFrame([(None,), ("a",), ('a"b',), ("a,b",), ("a\rb",)], "x string")
    assert [r[0] for r in df.select(export.csv_field(F.col("x"))).collect()] == ["", "a", '"a""b"', '"a,b"', "a\rb"]


def test_log_events(spark, tmp_path):
    rows = [(1, None, "INFO", "[Sitemap] Found sitemap x"), (2, None, None, "[API]  "), (3, None, "info", "Warning: error"), (4, None, None, None), (5, None, "x", "✗ no")]
    df = spark.createDataFrame(rows, "log_id long, ts timestamp, level string, message string")
    out = {r.log_id: (r.level, r.message, r.icon) for r in logs.events(df).collect()}
    assert out == {1: ("success", "Found sitemap x", "✓"), 3: ("warning", "Warning: error", "⚠"), 5: ("error", "✗ no", "✗")}
    df.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    seen = []
    logs.run(stream, lambda b, _: seen.extend(r.log_id for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [1, 3, 5]


def test_join_by_group_keeps_all(spark):
    rows = spark.range(5000).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id"))).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert join_by_group(rows, groups, ["k"], "n", 5000).count() == 5000
