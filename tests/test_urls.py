import pytest
from pyspark.sql import functions as F

from sitegauge.functions import urls

BASE = "https://www.site.test/a/b.html?x#y"
CANONICAL = [
    (None, None), ("", None), ("  ", None), ("#top", None), ("mailto:a@b", None), ("JavaScript:x()", None), ("ftp://x/y", None),
    ("/x/", "https://www.site.test/x"), ("c", "https://www.site.test/a/c"), ("../up/./z", "https://www.site.test/up/z"), ("//cdn.test/p", "https://cdn.test/p"),
    ("http://site.test//a//index.HTML?q#f", "https://www.site.test/a"), ("https:///site.test/k", "https://www.site.test/k"), ("HTTP://SITE.test:443", "https://www.site.test/"),
    ("/für", "https://www.site.test/f%C3%BCr"), ("https://blog.site.test/default.aspx", "https://blog.site.test/"),
]


def test_canonical(spark):
    df = spark.createDataFrame([(u, BASE) for u, _ in CANONICAL], "u string, b string")
    got = [r.c for r in df.select(urls.canonical(F.col("u"), F.col("b")).alias("c")).collect()]
    assert got == [c for _, c in CANONICAL]
    again = spark.createDataFrame([(c,) for c in got if c], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    assert all(r.u == r.c for r in again)


@pytest.mark.parametrize("href,want", [("?p=1", "https://www.site.test/a/b.html?p=1"), ("#z", "https://www.site.test/a/b.html?x#z"), ("", "https://www.site.test/a/b.html?x"), ("..", "https://www.site.test/"), (None, None)])
def test_resolve(spark, href, want):
    df = spark.createDataFrame([(href, BASE)], "h string, b string")
    assert df.select(urls.resolve(F.col("h"), F.col("b"))).first()[0] == want


def test_predicates(spark):
    rows = [("https://site.test/x.PDF", False, True), ("https://site.test/x", True, True), ("https://other.test/", False, True), ("http://10.0.0.1/", False, False), ("http://localhost/", False, False), (None, False, False)]
    df = spark.createDataFrame([(r[0], BASE) for r in rows], "u string, b string")
    got = df.select(urls.crawlable(F.col("u"), F.col("b")).alias("c"), urls.safe_host(F.col("u")).alias("s")).collect()
    assert [(r.c, r.s) for r in got] == [r[1:] for r in rows]
