"""Sitemaps and robots.txt as tables, from fetched site resources (url, status, content_type, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import urls
from sitegauge.functions.text import js_trim
from sitegauge.plans.staging import staged

#: Where sitemaps are looked for, best first.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml", "/sitemap1.xml", "/sitemap/sitemap.xml")
MAX_DEPTH = 10


def _bare(body: Column) -> Column:
    """XML without name-space prefixes on its tags, so one pattern fits all sitemaps."""
    return F.regexp_replace(body, r"<(/?)[A-Za-z_][\w.-]*:(?=[A-Za-z])", "<$1")


def _locs(xml: Column, parent: str) -> Column:
    blocks = F.regexp_extract_all(xml, F.lit(rf"(?is)<{parent}(?:\s[^>]*)?>(.*?)</{parent}\s*>"), F.lit(1))
    locs = F.transform(blocks, lambda b: js_trim(F.regexp_extract(b, r"(?is)<loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc", 1)))
    return F.filter(F.transform(locs, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))), lambda x: x != "")


def parsed(resources: DataFrame) -> DataFrame:
    """(url, is_index, loc, position): the locations that each fetched sitemap lists.

    An index lists sitemaps, a urlset pages; where neither has any, every location that starts with
    http(s) counts. Null bodies, other statuses than 200 and non-XML bodies list nothing; repeated rows
    count once, of differing bodies of one URL the greatest.
    """
    live = resources.filter("status = 200 and body is not null").groupBy("url").agg(F.max("body").alias("body"))
    xml = live.select("url", _bare(F.col("body")).alias("xml")).filter(F.col("xml").rlike("(?i)<(urlset|sitemapindex|loc)[\\s>]"))
    found = xml.select("url", _locs(F.col("xml"), "sitemap").alias("index"), _locs(F.col("xml"), "url").alias("pages"), F.regexp_extract_all("xml", F.lit(r"(?is)<loc(?:\s[^>]*)?>\s*(https?://.*?)\s*</loc"), F.lit(1)).alias("any"))
    locs = F.when(F.size("index") > 0, F.col("index")).when(F.size("pages") > 0, F.col("pages")).otherwise(F.col("any"))
    return found.select("url", (F.size("index") > 0).alias("is_index"), F.posexplode(locs).alias("position", "loc")).select("url", "is_index", "loc", "position")


def expand(roots: DataFrame, resources: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(base, sitemap, loc, position): pages listed by each root sitemap and the sitemaps below it.

    ``roots`` is (base, sitemap). A sitemap met again on the way is not followed, and a missing child is
    dropped, so cycles end; at most ``max_depth`` levels. Duplicates between sitemaps stay.
    """
    told = staged(parsed(resources))
    now = roots.select("base", "sitemap", F.array("sitemap").alias("path"), F.lit("").alias("place"))
    out = None
    for _ in range(max_depth + 1):
        step = now.join(told, now["sitemap"] == told["url"]).select(
            "base", "sitemap", "path", "is_index", urls.resolve(F.col("loc"), F.col("url")).alias("loc"), F.concat("place", F.format_string("/%08d", "position")).alias("place")
        )
        pages = step.filter("not is_index").select("base", "sitemap", "loc", "place")
        out = pages if out is None else out.unionByName(pages)
        below = step.filter(F.col("is_index") & ~F.array_contains("path", F.col("loc")))
        now = staged(below.select("base", F.col("loc").alias("sitemap"), F.array_append("path", F.col("loc")).alias("path"), "place"))
        if not now.limit(1).count():
            break
    return out.withColumnRenamed("place", "position")


def robots_sitemaps(resources: DataFrame) -> DataFrame:
    """(site_host, ordinal, sitemap): the Sitemap lines of each robots.txt, comments cut, resolved."""
    live = resources.filter("status = 200 and body is not null").filter(urls.path(F.col("url")) == "/robots.txt").groupBy("url").agg(F.max("body").alias("body"))
    lines = F.regexp_extract_all("body", F.lit(r"(?i)sitemap:[ \t]*([^\r\n]+)"), F.lit(1))
    rows = live.select("url", F.posexplode(lines).alias("ordinal", "line"))
    named = js_trim(F.regexp_replace("line", "#.*$", ""))
    return rows.select(urls.host(F.col("url")).alias("site_host"), "ordinal", urls.resolve(named, F.col("url")).alias("sitemap")).filter("sitemap <> ''")


def discovered(resources: DataFrame) -> DataFrame:
    """(site_host, sitemap): each host's sitemap: the best well-known place that answers 200, else the
    first robots.txt line whose sitemap answers. Hosts with none have no row."""
    live = resources.filter("status = 200").select("url").distinct()
    rank = F.array_position(F.array(*map(F.lit, WELL_KNOWN)), urls.path(F.col("url")))
    known = live.filter(rank > 0).select(urls.host(F.col("url")).alias("site_host"), rank.alias("rank"), F.col("url").alias("sitemap"))
    named = robots_sitemaps(resources).join(live.withColumnRenamed("url", "sitemap"), "sitemap", "left_semi")
    both = known.unionByName(named.select("site_host", (F.col("ordinal") + 1 + len(WELL_KNOWN)).cast("bigint").alias("rank"), "sitemap"))
    return both.groupBy("site_host").agg(F.min_by("sitemap", "rank").alias("sitemap"))


def site_probe(resources: DataFrame) -> DataFrame:
    """(site_host, robots, sitemap): robots.txt and the sitemap as a crawl's answer shows them: the first
    line of robots.txt unverified, else one of the two usual places."""
    lines = robots_sitemaps(resources).groupBy("site_host").agg(F.min_by("sitemap", "ordinal").alias("named"))
    path = urls.path(F.col("url"))
    live = resources.filter("status = 200").groupBy(urls.host(F.col("url")).alias("site_host")).agg(
        F.max(F.when(path == "/robots.txt", F.col("body"))).alias("robots"),
        F.max(F.when(path == WELL_KNOWN[0], F.col("url"))).alias("a"), F.max(F.when(path == WELL_KNOWN[1], F.col("url"))).alias("b"),
    )
    return live.join(lines, "site_host", "left").select("site_host", "robots", F.coalesce("named", "a", "b").alias("sitemap"))
