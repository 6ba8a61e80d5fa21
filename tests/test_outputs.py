import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import urls
from sitegauge.operators import crawl, export, report, rollups
from sitegauge.plans import staging
from sitegauge.streaming import logs

REPORT = (
    "report_id long, url string, status string, h1_count int, h1_texts array<string>, has_single_h1 boolean, meta struct<title: string, description: string, robots: string, canonical: string>, "
    "og struct<title: string, description: string, image: string>, twitter struct<card: string>, json_ld struct<present: boolean, valid: boolean>, issues array<string>"
)
U = "https://a.test/"


def reports(spark, *rows):
    return spark.createDataFrame([(k, u, s, 1, ["h"], one, ("t", d, None, None), None, None, None, None) for k, (u, s, one, d) in enumerate(rows)], REPORT)


ROWS = [(U, "pass", True, "d"), (U + "en-gb/", "fail", None, ""), (U + "en-GB/x", "warn", False, None), (None, None, None, None)]


def test_crawl_file(spark):
    lines = export.crawl_file(reports(spark, *ROWS), F.lit(dt.datetime(2025, 1, 2, 3, 4, 5, 6000))).orderBy("line_no", "report_id").collect()
    assert [r.line for r in lines[:4]] == ["SEO Crawl Analysis Report", "Total Pages,4", "Generated,2025-01-02T03:04:05.006Z", ""] and lines[4].line == export.HEADER
    assert len(lines) == 9 and lines[5].line == f"{U},pass,1,h,t,d,,,,,,No,No," and lines[8].line == ",,1,h,t,,,,,,,No,No,"


def test_write_lines(spark, tmp_path):
    export.write_lines(spark.createDataFrame([("a,b",), ("",)], "line string").coalesce(1), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_status_lines_and_names(spark):
    assert [r.text for r in export.status_lines(reports(spark, *ROWS)).orderBy("line_no").collect()] == ["SEO Crawl Analysis Report", "Total Pages Analyzed: 4", "Summary", "Passed: 1", "Warnings: 1", "Failed: 1", "Page Details"]
    name = export.file_name("k", F.lit("https://a.test/x?y"), F.lit(dt.datetime(1970, 1, 1, 0, 0, 1)), "csv")
    assert spark.range(1).select(name).first()[0] == "k-https---a-test-x-y-1000.csv"


REQUESTS = [("u", None, 200), ("u", "", 200), ("u", "1", 200), ("u", "1000", 200), ("u", "0", 400), ("u", "1001", 400), ("u", "x", 400), ("", None, 400), (None, "5", 400)]


def test_requests(spark):
    out = export.request_answer(spark.createDataFrame([r[:2] for r in REQUESTS], "url string, max_pages string")).collect()
    assert [(r.url, r.max_pages, r.http_status) for r in out] == REQUESTS and all((r.error is None) == (r.http_status == 200) for r in out)


def test_rollups(spark):
    r = reports(spark, *ROWS)
    assert {(x.display_name, x.pages) for x in rollups.regions(r).collect()} == {("United States", 2), ("United Kingdom", 2)}
    assert rollups.regions(r.filter("report_id = 0")).count() == 0
    shown = {(x.view, x.locale): (x.shown, x.total) for x in rollups.displayed(r).collect()}
    assert shown["all", "all"] == (4, 4) and shown["failed", "en-GB"] == (1, 4) and shown["missingH1", "all"] == (3, 4) and shown["missingDescription", "en-US"] == (1, 4)
    checks = spark.createDataFrame([(1, "contentSecurityPolicy", "pass"), (1, "xFrameOptions", "pass"), (2, "contentSecurityPolicy", "pass"), (2, "xFrameOptions", "warn"), (3, "etag", "pass")], "page_id long, check string, status string")
    assert {tuple(x) for x in rollups.security_headers(checks).collect()} == {(1, True), (2, False)}
    assert spark.range(1).select(rollups.words_of_key(F.lit("robotsTxtExists"))).first()[0] == "robots Txt Exists"


TYPED = [("a.test", True, "https://a.test"), (" http://a.test/x ", True, "https://a.test/x"), ("a b", False, "https://a b"), ("", False, "https://"), (None, False, None), ("https://", False, "https://"), ("a.test:80/p", True, "https://a.test:80/p")]


def test_typed_addresses(spark):
    df = spark.createDataFrame([(t,) for t, *_ in TYPED], "t string")
    assert [tuple(r) for r in df.select("t", urls.valid_input(F.col("t")), urls.with_scheme(F.col("t"), True)).collect()] == TYPED


@pytest.mark.parametrize("url,want", [("https://www.a.test/x", True), ("https://p.test/x", True), ("https://b.test/", False), ("/rel", True), (None, False)])
def test_browser_internal(spark, url, want):
    df = spark.createDataFrame([(url, U, "https://www.p.test/y")], "u string, b string, p string")
    assert df.select(urls.browser_internal(F.col("u"), F.col("b"), F.col("p"))).first()[0] == want


def test_liveness_of_a_link_on_every_page(spark):
    page = "page_id long, final_url string, facts struct<anchors: array<string>>, fetched_at timestamp, loaded_at timestamp"
    facts = spark.createDataFrame([(k, U, (["/all", "#x", f"/{k}", None],), None, None) for k in range(300)] + [(900, U, ([f"/{k}" for k in range(25)],), None, None), (901, U, None, None, None)], page)
    state = spark.createDataFrame([(U + "all", 404), (U + "7", 200), (U + "7", 200), (None, 500)], "url string, status int")
    out = report.broken_links(facts, state).collect()
    assert sum(r.link == U + "all" and r.status == 404 and r.ordinal == 1 for r in out) == 300
    assert [r.link for r in out if r.page_id == 7] == [U + "all"] and sum(r.page_id == 900 for r in out) == 19 and max(r.ordinal for r in out) == 20


def test_browser_crawl(spark):
    listed = lambda base, names: [(base, base + x, f"/{k:02}") for k, x in enumerate(names)]
    many, few = "https://m.test/", "https://f.test/"
    told = spark.createDataFrame(listed(many, [f"p{k}" for k in range(12)]) + listed(few, ["q"]), "base string, loc string, position string")
    roots = spark.createDataFrame([("m.test", many), ("f.test", few), ("s.test", "https://s.test/")], "site string, url string")
    graph = spark.createDataFrame([(many + "p0", 0, many + "linked"), (few + "q", 0, few + "linked")], "src string, ordinal int, dst string")
    pages = [many, *(many + f"p{k}" for k in range(12)), many + "linked", few, few + "q", few + "linked"]
    shown = spark.createDataFrame([(u,) for u in pages], "url string")
    fetched = shown.unionByName(spark.createDataFrame([("https://s.test/",), (few + "plain",)], "url string"))
    out = crawl.browser_crawl(told, roots, crawl.canonical_edges(graph), shown, fetched).orderBy("site", "position").collect()
    by = {s: [r.url.rsplit("/", 1)[1] for r in out if r.site == s] for s in ("m.test", "f.test", "s.test")}
    assert by == {"m.test": ["p0", "p1", "p2", "", *(f"p{k}" for k in range(3, 12))], "f.test": ["q", "", "linked"], "s.test": [""]}


def test_arguments(spark):
    rows = [(["\"a b\"", "3", '{"x": [1]}', None],), (['"say \\"hi\\""'],), ([],)]
    out = [r[0] for r in spark.createDataFrame(rows, "a array<string>").select(logs.stringified(F.col("a"))).collect()]
    assert out == ['a b 3 {"x": [1]} null', 'say "hi"', ""]


def test_frames_end_with_complete(spark):
    log = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "info", "x")], "log_id long, ts timestamp, level string, message string")
    out = {r.log_id: r.frame for r in logs.stream_frames(logs.events(log)).collect()}
    assert out == {1: 'data: {"timestamp":"2025-01-01T00:00:00.000Z","level":"info","message":"x"}\n\n', None: 'data: {"type":"complete"}\n\n'}


LOG = "log_id long, ts timestamp, message string"


def test_progress_numbers_over_minutes(spark):
    begin = dt.datetime(2025, 1, 1)
    rows = [(k, begin + dt.timedelta(seconds=7 * k), f"Analyzed {k}") for k in range(95)]
    out = {r.analysed: r.ts for r in logs.progress(spark.createDataFrame(rows + rows[:5] + [(500, begin, "other"), (501, begin, None)], LOG), total=95).collect()}
    assert out == {n: begin + dt.timedelta(seconds=7 * (n - 1)) for n in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95)}
    assert logs.progress(spark.createDataFrame([], LOG)).count() == 0


def test_streamed_progress_counts_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begin = dt.datetime(2025, 1, 1)
    for part in range(3):
        rows = [(k, begin + dt.timedelta(seconds=k), f"Analyzed page of c{k % 2}") for k in range(part * 16, part * 16 + 16)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    told = logs.stream_progress(stream, F.regexp_extract("message", "of (c.)", 1))
    seen = []
    q = told.writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend((r.crawl, r.analysed) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [("c0", 10), ("c0", 20), ("c1", 10), ("c1", 20)]


def test_staged_parts_and_spread(spark, monkeypatch):
    parts = staging.StagedParts(spark)
    assert parts.add(spark.range(3)).count() == 3
    parts.add(spark.range(3, 5))
    assert sorted(r.id for r in parts.all().collect()) == [0, 1, 2, 3, 4]
    assert staging.spread(spark.range(10)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(staging, "SPREAD_BYTES", 0)
    df = spark.range(10).coalesce(1)
    assert staging.spread(df) is df


def test_join_small_beyond_its_bound(spark, monkeypatch):
    rows, table = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).selectExpr("id as k", "id * 2 as v")
    small = sorted(map(tuple, staging.join_small(rows, table, ["k"]).collect()), key=str)
    monkeypatch.setattr(staging, "SMALL", 2)
    assert sorted(map(tuple, staging.join_small(rows, table, ["k"]).collect()), key=str) == small and len(small) == 10
