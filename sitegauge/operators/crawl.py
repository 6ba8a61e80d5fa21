"""Link sets, crawls over fetched pages and crawl statistics.

A crawl is breadth-first over tables: the frontier of a depth joins the link table, loses what was seen by
an anti join, and is cut to the free slots of its site in first-seen order. Every depth is written to the
shared folder as one more part of what was seen, so plans stay short and a lost executor costs one depth at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import urls
from sitegauge.operators.checks import latest
from sitegauge.plans.staging import StagedParts, staged

#: Kinds of links that a browser follows; ``link_set`` follows all.
BROWSER_KINDS = ("a", "area", "form", "link", "data")
#: Sitemap pages below which a browser crawl follows links too, and how many of them come before the root.
FEW_LISTED, BEFORE_ROOT = 10, 3


def link_set(facts: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(page_id, ordinal, kind, raw, resolved, canonical): distinct crawlable links of each page.

    All link sources are united; of links with one canonical form the first in source and document order
    stays. A page's ``base`` changes what relative links mean, not which host is its own.
    """
    base = F.coalesce(urls.resolve(F.col("facts.base_href"), F.col("final_url")), F.col("final_url"))
    found = F.filter("facts.links", lambda l: l["kind"].isin(*kinds)) if kinds else F.col("facts.links")

    def seen(l: Column) -> Column:
        return F.struct(l["kind"].alias("kind"), l["raw"].alias("raw"), urls.resolve(F.trim(l["raw"]), F.col("base")).alias("resolved"), urls.canonical(l["raw"], F.col("base")).alias("canonical"))

    rows = facts.filter("facts is not null").select("page_id", "fetched_at", "loaded_at", "final_url", base.alias("base"), found.alias("found"))
    own = F.filter(F.transform("found", seen), lambda x: urls.crawlable(x["resolved"], F.col("final_url")))
    rows = latest(rows.select("page_id", "fetched_at", "loaded_at", own.alias("own")))
    # the first of the links with one canonical form stays, inside the page's own row
    forms = F.transform("own", lambda x: x["canonical"])
    first = F.filter("own", lambda x, i: F.array_position(forms, x["canonical"]) == i + 1)
    rows = rows.select("page_id", F.posexplode(first).alias("at", "l"))
    return rows.select("page_id", (F.col("at") + 1).alias("ordinal"), "l.kind", "l.raw", "l.resolved", "l.canonical")


def canonical_edges(graph: DataFrame) -> DataFrame:
    """(site, src, dst, ordinal): distinct links within a site between canonical URLs, first ordinal kept."""
    rows = graph.filter(urls.crawlable(F.col("dst"), F.col("src")))
    rows = rows.select(urls.canonical(F.col("src")).alias("src"), urls.canonical(F.col("dst"), F.col("src")).alias("dst"), "ordinal")
    site = urls.bare_host(urls.host(F.col("src")))
    return rows.groupBy(site.alias("site"), "src", "dst").agg(F.min("ordinal").alias("ordinal"))


def breadth_first(seeds: DataFrame, edges: DataFrame, fetched: DataFrame, max_pages: int = 200) -> DataFrame:
    """(site, url, depth, position): the pages a crawl of each site takes, in order.

    ``seeds`` is (site, url, position), ``edges`` (site, src, dst, ordinal), ``fetched`` (url): pages that
    answer. Links to pages that don't answer take no slot. At most ``max_pages`` per site; ties in order
    fall to the smaller URL. Seeds beyond the limit are left out; null URLs never count. Depth has no limit:
    each takes a page of some site at least, so ``max_pages`` ends the crawl.
    """
    if not 1 <= max_pages <= 1000:
        raise ValueError("max_pages must be from 1 to 1000")
    # links that can be followed at all are read again at every depth
    alive = staged(fetched.filter("url is not null").select("url").distinct())
    edges = staged(edges.join(alive.withColumnRenamed("url", "dst"), "dst", "left_semi"))
    order = Window.partitionBy("site").orderBy("position", "url")
    first = seeds.filter("url is not null").groupBy("site", "url").agg(F.min("position").alias("position")).join(alive, "url", "left_semi")
    first = first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max_pages)
    seen = StagedParts(seeds.sparkSession)
    frontier = seen.add(first.select("site", "url", F.lit(0).alias("depth"), F.col("position").cast("bigint").alias("position")))
    for depth in count(1):
        taken = seen.all().groupBy("site").agg(F.count("*").alias("taken")).filter(F.col("taken") < max_pages)
        step = frontier.select("site", F.col("url").alias("src"), F.col("position").alias("before")).join(edges, ["site", "src"])
        new = step.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("before", "ordinal")).alias("place"))
        new = new.join(seen.all().select("site", "url"), ["site", "url"], "left_anti")
        # the limit on the rank is applied in every task before sites meet, so a large site never gathers in one
        rank = F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))
        new = new.withColumn("rank", rank).filter(F.col("rank") <= max_pages).join(taken, "site").filter(F.col("rank") + F.col("taken") <= max_pages)
        frontier = seen.add(new.select("site", "url", F.lit(depth).alias("depth"), (F.col("rank") + F.col("taken")).alias("position")))
        if not frontier.limit(1).count():
            return seen.all()


def sitemap_listed(sitemap_urls: DataFrame, roots: DataFrame) -> DataFrame:
    """(site, url, position): the pages that sitemaps list of each site in ``roots``, canonical, in order, each once.

    ``sitemap_urls`` is (base, loc, position), ``roots`` (site, url), one per site: URLs take the root's www form.
    """
    rows = sitemap_urls.withColumn("site", urls.bare_host(urls.host(F.col("base")))).join(roots.select("site", F.col("url").alias("root")), "site")
    rows = rows.filter(urls.crawlable(F.col("loc"), F.col("root"))).select("site", urls.canonical(F.col("loc"), F.col("root")).alias("url"), "position")
    rows = rows.groupBy("site", "url").agg(F.min("position").alias("position"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy("position", "url")))


def crawl_seeds(sitemap_urls: DataFrame, roots: DataFrame, max_pages: int = 200) -> DataFrame:
    """(site, url, position): where the crawl of each site starts: the root, then its sitemap pages in order.

    Sitemap pages are cut to ``max_pages`` before they meet the fetched pages. A root that the sitemap lists
    keeps its place there; another one comes first, if the sitemap leaves a slot.
    """
    listed = sitemap_listed(sitemap_urls, roots).filter(F.col("position") <= max_pages)
    full = listed.filter(F.col("position") == max_pages).select("site")
    own = roots.join(full, "site", "left_anti").join(listed, ["site", "url"], "left_anti")
    return listed.unionByName(own.select("site", "url", F.lit(0).alias("position")))


def sitemap_first(sitemap_urls: DataFrame, fetched: DataFrame, max_pages: int = 200) -> DataFrame:
    """(site, url, position): the production crawl: sitemap pages in order, the root always first.

    ``sitemap_urls`` is (base, loc, position). URLs are filtered, made canonical, deduplicated and cut to
    ``max_pages`` before they meet the fetched pages; the root comes first and may make one page more.
    """
    site = urls.bare_host(urls.host(F.col("base")))
    rows = sitemap_urls.filter(urls.crawlable(F.col("loc"), F.col("base")))
    rows = rows.select(site.alias("site"), urls.canonical(F.col("loc"), F.col("base")).alias("url"), "position")
    rows = rows.groupBy("site", "url").agg(F.min("position").alias("position"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy("position", "url"))).filter(F.col("position") <= max_pages)
    roots = sitemap_urls.select(site.alias("site"), urls.canonical(F.col("base")).alias("url"), F.lit(0).alias("position")).distinct()
    alive = fetched.filter("url is not null").select("url").distinct()
    return rows.unionByName(roots).groupBy("site", "url").agg(F.min("position").alias("position")).join(alive, "url", "left_semi").select("site", "url", "position")


def browser_crawl(sitemap_urls: DataFrame, roots: DataFrame, edges: DataFrame, rendered: DataFrame, fetched: DataFrame, max_pages: int = 200) -> DataFrame:
    """(site, url, depth, position): the crawl of a browser, which renders pages.

    Sitemap pages come first, the root after the first ``BEFORE_ROOT`` of them. Links are followed only on sites
    that list fewer than ``FEW_LISTED`` pages, depth by depth. ``rendered`` (url) are pages that a browser shows;
    on a site with none of them, ``fetched`` (url), what plain requests get, stands in. Else as ``breadth_first``.
    """
    listed = staged(sitemap_listed(sitemap_urls, roots).filter(F.col("position") <= max_pages))
    own = roots.join(listed.select("site", "url"), ["site", "url"], "left_anti").select("site", "url", F.lit(BEFORE_ROOT + 0.5).alias("position"))
    seeds = listed.withColumn("position", F.col("position").cast("double")).unionByName(own)
    many = listed.groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") >= FEW_LISTED).select("site")
    site = urls.bare_host(urls.host(F.col("url"))).alias("site")
    shown = staged(rendered.filter("url is not null").select("url", site).distinct())
    silent = fetched.filter("url is not null").select("url", site).distinct().join(shown.select("site").distinct(), "site", "left_anti")
    return breadth_first(seeds, edges.join(many, "site", "left_anti"), shown.select("url").unionByName(silent.select("url")), max_pages)


def crawl_statistics(crawled: DataFrame, sitemap_urls: DataFrame, roots: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per site in ``roots``, of what its crawl met.

    sitemap_urls counts the locations of its sitemaps, html_discovered the links of crawled pages (each page's
    distinct links, summed), discovered the distinct pages that its sitemaps list or the crawl took,
    total_crawled those it took, errors the fetches of these with status 400 or more. ``pages`` is (page_id,
    url, status_code), without repeats; the others are as for ``breadth_first`` and ``crawl_seeds``.
    """
    mapped = sitemap_urls.groupBy(urls.bare_host(urls.host(F.col("base"))).alias("site")).agg(F.count("*").alias("sitemap_urls"))
    took = crawled.groupBy("site").agg(F.count("*").alias("total_crawled"))
    links = edges.join(crawled.select("site", F.col("url").alias("src")), ["site", "src"]).groupBy("site").agg(F.count("*").alias("html_discovered"))
    met = sitemap_listed(sitemap_urls, roots).select("site", "url").unionByName(crawled.select("site", "url")).distinct()
    met = met.groupBy("site").agg(F.count("*").alias("discovered"))
    failed = pages.filter("status_code >= 400").select(urls.canonical(F.col("url")).alias("url")).join(crawled.select("site", "url"), "url")
    failed = failed.groupBy("site").agg(F.count("*").alias("errors"))
    out = roots.select("site")
    for part in (mapped, links, met, took, failed):
        out = out.join(part, "site", "left")
    return out.select("site", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sitemap_urls", "html_discovered", "discovered", "total_crawled", "errors")))


def html_pages(pages: DataFrame) -> DataFrame:
    """Fetches that are pages: content type of html, or a body that starts as markup; status below 500."""
    kind = F.lower(F.try_element_at(F.try_element_at(F.col("headers"), F.lit("content-type")), F.lit(1)))
    markup = F.coalesce(F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml")), F.lit(False))
    return pages.filter((markup | F.coalesce(F.ltrim("html").startswith("<"), F.lit(False))) & (F.coalesce("status_code", F.lit(200)) < 500))


def rendered_pages(pages: DataFrame) -> DataFrame:
    """Fetches that a browser crawl keeps: status below 400 and an html content type."""
    kind = F.lower(F.try_element_at(F.try_element_at(F.col("headers"), F.lit("content-type")), F.lit(1)))
    return pages.filter((F.coalesce("status_code", F.lit(200)) < 400) & F.coalesce(F.contains(kind, F.lit("html")), F.lit(False)))


def redirect_chains(start: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """(url, final_url, hops, http_redirects, outcome): redirects followed from each url, ``hops`` at most.

    ``redirects`` is (url, status, location). outcome is ok, 'HTTP n' for another status than 200, or
    'too many redirects'. A hop to, or a start at, a plain http address marks the row.
    """
    told = redirects.groupBy("url").agg(F.max(F.struct("status", "location")).alias("r"))
    now = start.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.col("url").startswith("http://").alias("http_redirects"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(hops + 1):
        step = now.join(told.select(F.col("url").alias("final_url"), "r"), "final_url", "left")
        moved = F.col("outcome").isNull() & (F.col("r.status") >= 300) & (F.col("r.status") < 400) & F.col("r.location").isNotNull()
        to = urls.resolve(F.col("r.location"), F.col("final_url"))
        end = F.when(F.col("r").isNull() | (F.col("r.status") == 200), "ok").otherwise(F.concat(F.lit("HTTP "), F.col("r.status").cast("string")))
        now = step.select(
            "url", F.when(moved, to).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + moved.cast("int")).alias("hops"),
            (F.col("http_redirects") | F.coalesce(moved & to.startswith("http://"), F.lit(False))).alias("http_redirects"),
            F.when(~F.coalesce(moved, F.lit(False)), F.coalesce("outcome", end)).alias("outcome"),
        )
    return now.withColumn("outcome", F.coalesce("outcome", F.lit("too many redirects")))
