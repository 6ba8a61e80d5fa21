"""Every query of the core by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge import oracles
from sitegauge.functions import urls
from sitegauge.operators import checks, crawl, dom, export, nested, report, rollups
from sitegauge.plans.staging import spread, staged
from sitegauge.sources import sitemaps
from sitegauge.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_fetch").filter("page_id is not null").withColumn("final_url", F.coalesce("final_url", "url"))


def _inputs(spark: SparkSession, d: str, categories: tuple[str, ...] = checks.ALL, **more) -> DataFrame:
    site = table(spark, d, "site_resources") if "robots" in categories else None
    return report.with_inputs(table(spark, d, "page_fetch"), site, names=checks.needs(categories), **more)


def _facts(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Every fetch with the named facts of its page; ``checks.latest`` comes after what is read off them."""
    lean = _pages(spark, d).select("page_id", "url", "final_url", "fetched_at", "loaded_at", "html")
    return dom.page_facts(spread(lean), names).filter("facts is not null")


def _latest(rows: DataFrame, *columns) -> DataFrame:
    return checks.latest(rows.select("page_id", "fetched_at", "loaded_at", *columns))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_report").dropDuplicates(["report_id"])


@query
def score_page(spark, d):
    return report.audit(_inputs(spark, d)).withColumn("band", report.score_band(F.col("score")))


@query
def score_slice(spark, d):
    """Score over the title, https and h1 rules alone."""
    rules = [checks.meta_tags()[0], *(checks.technical()[i] for i in (0, 5, 6))]
    told = _inputs(spark, d, ("meta", "technical")).filter("facts is not null")
    told = _latest(told, sum((r.signals for r in rules), F.lit(0)).alias("s")).select("page_id", *checks.counts(F.col("s")))
    return told.select("page_id", checks.score(F.col("passed"), F.col("warnings"), F.col("failed")).alias("score"))


def _category(name: str) -> Query:
    return lambda spark, d: checks.checks(_inputs(spark, d, (name,)), (name,)).drop("category", "ordinal")


for _name, _category_name in {
    "meta_checks": "meta", "og_checks": "openGraph", "twitter_checks": "twitter", "robots_checks": "robots", "technical_checks": "technical",
    "performance_checks": "performance", "security_checks": "security", "accessibility_checks": "accessibility", "analytics_checks": "analytics", "caching_checks": "caching",
}.items():
    _QUERIES[_name] = _category(_category_name)


@query
def links_check(spark, d):
    """The links rule with liveness: a link answers as the fetch of its URL did."""
    status = table(spark, d, "page_fetch").select("url", F.col("status_code").alias("status"))
    return checks.checks(_inputs(spark, d, ("links",), link_status=status), ("links",)).drop("category", "ordinal")


@query
def link_liveness(spark, d):
    """The links of each page, among its first twenty, that don't answer."""
    status = table(spark, d, "page_fetch").select("url", F.col("status_code").alias("status"))
    return report.broken_links(_facts(spark, d, "anchors"), status).select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "link", "status")


@query
def tls_check(spark, d):
    """The certificate rule over certificates made up from host names, so that every branch is met."""
    host = urls.host(F.col("final_url"))
    hosts = _pages(spark, d).select(host.alias("host")).filter("host is not null").distinct()
    days, now = F.length("host") * 7 % 60 - 15, F.lit("2025-01-01").cast("timestamp")
    outcome = F.when(F.length("host") % 11 == 0, "timeout").when(F.length("host") % 13 == 0, "error").otherwise("ok")
    tls = hosts.select("host", F.timestamp_add("DAY", days, now).alias("valid_to"), outcome.alias("outcome"))
    told = checks.checks(_inputs(spark, d, ("security",), tls=tls, now=now), ("security",))
    return told.filter("check = 'sslCertificate'").drop("category", "ordinal")


def _all_checks(spark, d):
    return checks.checks(_inputs(spark, d))


@query
def category_pivot(spark, d):
    return _all_checks(spark, d).groupBy("category").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))


@query
def page_json(spark, d):
    """The answer to a request for one page, as JSON."""
    return report.json_bodies(_all_checks(spark, d))


@query
def heading_counts(spark, d):
    counts = [F.size("facts.h1_texts").cast("bigint").alias("h1"), *(F.col(f"facts.{h}").cast("bigint").alias(h) for h in ("h2", "h3", "h4", "h5", "h6"))]
    return _latest(_facts(spark, d, "h1_texts", "h2", "h3", "h4", "h5", "h6"), *counts)


@query
def element_counts(spark, d):
    told = _latest(dom.tag_counts(spread(_pages(spark, d).select("page_id", "fetched_at", "loaded_at", "html"))), F.map_entries("tags").alias("tags"))
    return told.select(F.inline("tags")).groupBy(F.col("key").alias("tag")).agg(F.sum("value").alias("elements"))


@query
def links_extract(spark, d):
    return report.page_links(_facts(spark, d, "anchors")).select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "href", "link", "kind")


@query
def link_counts(spark, d):
    told = _latest(_inputs(spark, d, ("links",)).filter("facts is not null"), "total_links", "internal_links", "external_links")
    return told.select("page_id", *(F.col(c).cast("bigint").alias(c) for c in ("total_links", "internal_links", "external_links")))


@query
def link_set(spark, d):
    return crawl.link_set(_facts(spark, d, "links", "base_href"))


@query
def link_set_browser(spark, d):
    return crawl.link_set(_facts(spark, d, "links", "base_href"), crawl.BROWSER_KINDS)


@query
def page_size(spark, d):
    size = F.octet_length(F.encode("html", "UTF-8")).cast("bigint")
    told = _latest(_pages(spark, d).filter("html <> ''"), size.alias("bytes"))
    return told.select("page_id", "bytes", checks.hundredths_of_mb(F.col("bytes")).alias("mb_hundredths"))


@query
def third_party_hosts(spark, d):
    return _latest(_facts(spark, d, "script_srcs"), checks.third_party_hosts().alias("h")).select("page_id", F.explode("h").alias("host"))


@query
def json_ld_pages(spark, d):
    s = _latest(_facts(spark, d, "json_ld"), report.json_ld_summary("facts.json_ld").alias("s"))
    return s.select("page_id", "s.count", "s.valid", F.array_join("s.errors", "; ").alias("errors"), F.array_join("s.types", ",").alias("types"))


def _page_reports(spark, d):
    return report.page_report(report.with_inputs(table(spark, d, "page_fetch"), names=report.NEEDS))


@query
def page_report_flat(spark, d):
    r = _page_reports(spark, d)
    return r.select("page_id", "url", "h1_count", "has_single_h1", "meta.title", "meta.description", "meta.canonical", F.col("json_ld.valid").alias("json_ld_valid"), "status", F.array_join("issues", "; ").alias("issues"))


@query
def site_report(spark, d):
    """Reports of the pages that the crawl of each site takes, in its order, with the site's sitemap."""
    crawled = _crawl(spark, d).select("url", F.col("position").alias("page_no"))
    pages = _page_reports(spark, d).withColumn("canonical", urls.canonical(F.col("url")))
    found = pages.join(crawled.withColumnRenamed("url", "canonical"), "canonical").drop("canonical")
    maps = sitemaps.discovered(table(spark, d, "site_resources")).withColumnRenamed("sitemap", "sitemap_url")
    return report.with_site_sitemap(found, maps).select("page_id", "url", "page_no", F.col("sitemap.url").alias("sitemap_url"), "status")


@query
def url_canonical(spark, d):
    return table(spark, d, "page_fetch").select("url", urls.canonical(F.col("url")).alias("canonical")).distinct()


@query
def url_canonical_links(spark, d):
    g = table(spark, d, "link_graph").select("src", "dst").distinct()
    return g.select("src", "dst", urls.canonical(F.col("dst"), F.col("src")).alias("canonical"))


@query
def url_crawlable(spark, d):
    g = table(spark, d, "link_graph").select("src", "dst").distinct()
    return g.select("src", "dst", urls.crawlable(F.col("dst"), F.col("src")).alias("crawlable"))


@query
def url_internal_external(spark, d):
    g = table(spark, d, "link_graph").filter("dst is not null")
    return g.select(urls.link_kind(F.col("dst"), F.col("src")).alias("kind")).groupBy("kind").agg(F.count("*").alias("links"))


@query
def url_host_safe(spark, d):
    return table(spark, d, "page_fetch").select("url", urls.safe_host(F.col("url")).alias("safe"), urls.inner_page(F.col("url")).alias("inner_page"), urls.file_stem(F.col("url")).alias("stem")).distinct()


@query
def url_dedup(spark, d):
    p = table(spark, d, "page_fetch").select("page_id", urls.canonical(F.col("url")).alias("canonical")).distinct()
    return p.groupBy("canonical").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query
def locale_detect(spark, d):
    return table(spark, d, "page_fetch").select("url", rollups.locale_of(F.col("url")).alias("l")).distinct().select("url", "l.*")


@query
def locale_rollup(spark, d):
    return rollups.by_locale(_reports(spark, d)).select("locale", "region", "display_name", "pages", "pass", "warn", "fail", F.col("rank").cast("bigint").alias("rank"))


@query
def site_stats(spark, d):
    return rollups.status_counts(_reports(spark, d))


@query
def page_issues(spark, d):
    return _reports(spark, d).select("report_id", F.array_join(report.page_issues(), "; ").alias("issues"))


@query
def page_status(spark, d):
    return _reports(spark, d).withColumn("found", report.page_issues()).select("report_id", report.page_status(F.col("found")).alias("status"))


@query
def filter_failed(spark, d):
    return rollups.filtered(_reports(spark, d), "failed").select("report_id")


@query
def filter_missing_h1(spark, d):
    return rollups.filtered(_reports(spark, d), "missingH1").select("report_id")


@query
def filter_missing_description(spark, d):
    return rollups.filtered(_reports(spark, d), "missingDescription").select("report_id")


@query
def filter_locale(spark, d):
    return rollups.filtered(_reports(spark, d), "all", "en-GB").select("report_id")


@query
def card_flags(spark, d):
    flags = rollups.card_flags()
    return _reports(spark, d).select("report_id", flags["indexable"].alias("indexable"), flags["no_twitter"].alias("no_twitter"), flags["more_issues"].cast("bigint").alias("more_issues"), rollups.badge(F.col("status"))["icon"].alias("icon"))


@query
def csv_lines(spark, d):
    return export.crawl_lines(_reports(spark, d))


@query
def crawl_file(spark, d):
    return export.crawl_file(_reports(spark, d), F.lit("2025-01-01").cast("timestamp")).select(F.col("line_no").cast("bigint").alias("line_no"), "report_id", "line")


@query
def crawl_print_summary(spark, d):
    return export.status_lines(_reports(spark, d))


@query
def crawl_json(spark, d):
    return export.crawl_json(_reports(spark, d))


@query
def request_answer(spark, d):
    """Crawl requests made up of fetched addresses and numbers of pages, right and wrong."""
    n = F.when(F.col("page_id") % 4 == 0, F.lit(None)).when(F.col("page_id") % 4 == 1, "many").otherwise((F.col("page_id") % 1500).cast("string"))
    rows = table(spark, d, "page_fetch").select(F.when(F.col("page_id") % 7 > 0, F.col("url")).alias("url"), n.alias("max_pages")).distinct()
    return export.request_answer(rows)


@query
def export_names(spark, d):
    now = F.coalesce("analyzed_at", F.lit("2025-01-01").cast("timestamp"))
    return _reports(spark, d).select("report_id", export.file_name("page-report", F.col("url"), now, "csv").alias("name"))


@query
def region_list(spark, d):
    return rollups.regions(_reports(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query
def displayed_counts(spark, d):
    return rollups.displayed(_reports(spark, d))


@query
def security_header_flags(spark, d):
    return rollups.security_headers(checks.checks(_inputs(spark, d, ("security",)), ("security",)))


@query
def crawlable_counts(spark, d):
    """How many distinct links of each host's pages are crawlable and how many aren't."""
    g = table(spark, d, "link_graph").select("src", "dst").distinct()
    told = g.select(urls.host(F.col("src")).alias("host"), urls.crawlable(F.col("dst"), F.col("src")).alias("c"))
    return told.groupBy("host").agg(F.count_if("c").alias("crawlable"), F.count_if(~F.col("c")).alias("not_crawlable"))


@query
def url_typed(spark, d):
    """Addresses as a user types them: without scheme, with blanks, with none."""
    u = table(spark, d, "page_fetch").select("url", (F.length("url") % 4).alias("k")).distinct()
    bare = F.regexp_replace("url", "^https?://", "")
    typed = F.when(F.col("k") == 0, F.concat(F.lit("  "), bare)).when(F.col("k") == 1, F.col("url")).when(F.col("k") == 2, F.concat(F.lit("a b "), "url")).otherwise(F.lit(" "))
    rows = u.select(typed.alias("typed")).distinct()
    return rows.select("typed", urls.valid_input(F.col("typed")).alias("valid"), urls.with_scheme(F.col("typed"), True).alias("full"))


@query
def url_browser_internal(spark, d):
    g = table(spark, d, "link_graph").filter("dst is not null").select("src", "dst").distinct()
    base = F.concat(F.lit("https://"), urls.bare_host(urls.host(F.col("src"))), F.lit("/"))
    return g.select("src", "dst", urls.browser_internal(F.col("dst"), base, F.col("src")).alias("internal"))


@query
def check_words(spark, d):
    """Names of checks as words."""
    keys = spark.createDataFrame([(r.check,) for rules in checks.CATEGORIES.values() for r in rules()], "check string")
    return keys.select("check", rollups.words_of_key(F.col("check")).alias("words"))


@query
def print_lines(spark, d):
    return export.report_lines(_reports(spark, d)).select("report_id", F.col("line_no").cast("bigint").alias("line_no"), "text", "style")


@query
def page_csv_lines(spark, d):
    return export.page_lines(_all_checks(spark, d)).select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "line")


def _page_file(spark, d):
    inputs = staged(_inputs(spark, d))
    counts = checks.latest(inputs.filter("facts is not null").select("page_id", "url", "fetched_at", "loaded_at", "total_links", "internal_links", "external_links"))
    return checks.checks(inputs), report.audit(inputs), counts


@query
def page_csv(spark, d):
    """The whole single-page export as numbered lines: preamble, summary, checks, links, broken links."""
    rows, scores, counts = _page_file(spark, d)
    broken = link_liveness(spark, d)
    return export.page_file(rows, scores, counts, broken)


@query
def page_print_lines(spark, d):
    rows, scores, counts = _page_file(spark, d)
    return export.page_print(rows, scores, link_liveness(spark, d))


@query
def sitemap_urls(spark, d):
    return sitemaps.parsed(table(spark, d, "site_resources")).select("url", "is_index", "loc", F.col("position").cast("bigint").alias("position"))


@query
def robots_sitemaps(spark, d):
    return sitemaps.robots_sitemaps(table(spark, d, "site_resources")).select("site_host", F.col("ordinal").cast("bigint").alias("ordinal"), "sitemap")


@query
def sitemap_discovery(spark, d):
    return sitemaps.discovered(table(spark, d, "site_resources"))


@query
def site_probe(spark, d):
    return sitemaps.site_probe(table(spark, d, "site_resources"))


def _sitemap_pages(spark, d):
    r = table(spark, d, "site_resources")
    roots = sitemaps.discovered(r).select(F.concat(F.lit("https://"), "site_host", F.lit("/")).alias("base"), "sitemap")
    return sitemaps.expand(roots, r)


@query
def sitemap_expand(spark, d):
    return _sitemap_pages(spark, d).select("base", "sitemap", "loc", "position")


def _fetched(spark, d):
    return crawl.html_pages(table(spark, d, "page_fetch")).select(urls.canonical(F.col("url")).alias("url")).distinct()


def _roots(fetched):
    return fetched.groupBy(urls.bare_host(urls.host(F.col("url"))).alias("site")).agg(F.min("url").alias("url"))


def _crawl(spark, d):
    fetched = _fetched(spark, d)
    seeds = crawl.crawl_seeds(_sitemap_pages(spark, d), _roots(fetched))
    return crawl.breadth_first(seeds, crawl.canonical_edges(table(spark, d, "link_graph")), fetched)


@query
def crawl_bfs(spark, d):
    return _crawl(spark, d)


@query
def crawl_batches(spark, d):
    """The crawled pages of each site in batches of five, as they are analysed together."""
    return _crawl(spark, d).select("site", "url", F.floor((F.col("position") - 1) / 5).cast("bigint").alias("batch"))


@query
def crawl_browser(spark, d):
    fetched = _fetched(spark, d)
    shown = crawl.rendered_pages(table(spark, d, "page_fetch")).select(urls.canonical(F.col("url")).alias("url"))
    edges = crawl.canonical_edges(table(spark, d, "link_graph"))
    return crawl.browser_crawl(_sitemap_pages(spark, d), _roots(fetched), edges, shown, fetched)


@query
def redirect_chains(spark, d):
    """Redirects as fetches tell them: a URL whose final URL is another one redirects there."""
    p = table(spark, d, "page_fetch").select("url", "status_code", "final_url").distinct()
    moved = F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url"))
    told = p.select("url", F.when(moved, 301).otherwise(F.col("status_code")).alias("status"), F.when(moved, F.col("final_url")).alias("location"))
    out = crawl.redirect_chains(p.select("url").distinct(), told)
    return out.select("url", "final_url", F.col("hops").cast("bigint").alias("hops"), "http_redirects", "outcome")


@query
def crawl_sitemap_first(spark, d):
    return crawl.sitemap_first(_sitemap_pages(spark, d), _fetched(spark, d))


@query
def crawl_statistics(spark, d):
    pages = table(spark, d, "page_fetch").select("page_id", "url", "status_code").distinct()
    fetched, listed = staged(_fetched(spark, d)), staged(_sitemap_pages(spark, d))
    known = _roots(fetched)
    silent = _roots(pages.select(urls.canonical(F.col("url")).alias("url"))).join(known, "site", "left_anti")  # sites where no page answers
    roots, edges = staged(known.unionByName(silent).filter("site is not null")), staged(crawl.canonical_edges(table(spark, d, "link_graph")))
    crawled = crawl.breadth_first(crawl.crawl_seeds(listed, roots), edges, fetched)
    return crawl.crawl_statistics(crawled, listed, roots, edges, pages)


@query
def fetch_gate(spark, d):
    p = table(spark, d, "page_fetch")
    kept = crawl.html_pages(p).select("page_id", F.lit("html").alias("gate")).unionByName(crawl.rendered_pages(p).select("page_id", F.lit("rendered").alias("gate")))
    return kept.distinct()


@query
def log_levels(spark, d):
    return logs.events(table(spark, d, "crawl_log")).groupBy("level", "icon").agg(F.count("*").alias("events"))


@query
def log_events(spark, d):
    return logs.events(table(spark, d, "crawl_log")).select("log_id", "level", "message").distinct()


@query
def log_frames(spark, d):
    return logs.stream_frames(logs.events(table(spark, d, "crawl_log"))).distinct()


@query
def log_arguments(spark, d):
    """Log rows as a logging call's arguments (its message, a number, an object), put together again."""
    args = F.array(F.to_json(F.struct("message")).substr(F.lit(12), F.length(F.to_json(F.struct("message"))) - 12), F.col("log_id").cast("string"), F.lit('{"n":1}'))
    rows = table(spark, d, "crawl_log").filter("message <> ''").select("log_id", "message").distinct()
    return rows.select("log_id", logs.stringified(args).alias("text"))


@query
def log_progress(spark, d):
    return logs.progress(table(spark, d, "crawl_log")).select(F.col("analysed").cast("bigint").alias("analysed"), "ts")


@query
def p3_found(spark, d):
    return nested.objects_table(table(spark, d, "page_report"))


@query
def p3_members(spark, d):
    return nested.members_table(table(spark, d, "page_report"))


@query
def p3_tables(spark, d):
    return nested.schema_tables(table(spark, d, "page_report"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in _QUERIES}
