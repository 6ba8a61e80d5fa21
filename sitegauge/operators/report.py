"""Composite operators: page audits, page reports, and what they are joined with."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions import urls
from sitegauge.functions.text import blank_to_null
from sitegauge.operators import checks as C
from sitegauge.operators.dom import page_facts
from sitegauge.plans.staging import join_by_group, join_small, spread, staged

LIVENESS_LIMIT = 20
#: Page facts that a page report reads.
NEEDS = ("title", "canonical", "meta", "prop", "h1_texts", "h2", "h3", "h4", "h5", "h6", "json_ld", "sitemap_href")
_COMMENT = re.compile(r"<!--.*?-->", re.S)


SUMMARY = T.StructType(
    [
        T.StructField("count", T.IntegerType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("types", T.ArrayType(T.StringType())),
    ]
)


def with_inputs(
    pages: DataFrame, site: DataFrame | None = None, tls: DataFrame | None = None, link_status: DataFrame | None = None,
    now: Column | None = None, names: tuple[str, ...] | None = None,
) -> DataFrame:
    """Pages with facts and everything the rules read; see ``checks``. Repeated pages stay, for ``checks.latest``.

    ``site`` is (url, status, body) of fetched site resources, ``tls`` (host, valid_to, outcome) and
    ``link_status`` (url, status); each may be absent. A header map's keys become lower-case. ``names`` are the
    page facts wanted, all if none are named.
    """
    stamps = {c: F.lit(None).cast("timestamp") for c in ("fetched_at", "loaded_at") if c not in pages.columns}
    lean = pages.filter("page_id is not null").withColumns(
        {
            "html_bytes": F.octet_length(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).cast("bigint"),
            "final_url": F.coalesce("final_url", "url"),
            "headers": F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]), e["value"]))),
            **stamps,
        }
    ).select("page_id", "url", "final_url", "status_code", "headers", "response_ms", "http_redirects", "html_bytes", "fetched_at", "loaded_at", "html")
    out = page_facts(spread(lean), names)
    out = out.withColumn("site_host", urls.host(F.col("final_url")))
    if site is not None:
        told = site.filter("status = 200 and body is not null").filter(urls.path(F.col("url")) == "/robots.txt")
        told = told.groupBy(urls.host(F.col("url")).alias("site_host")).agg(F.min(F.lower("body")).alias("body"))
        flags = F.struct(F.lit(True).alias("there"), F.contains("body", F.lit("disallow: /")).alias("closed"), F.contains("body", F.lit("sitemap:")).alias("named"))
        out = join_small(out, told.select("site_host", flags.alias("robots")), ["site_host"])
    else:
        out = out.withColumn("robots", F.lit(None).cast("struct<there boolean, closed boolean, named boolean>"))
    if tls is not None:
        days = F.floor((F.unix_millis("valid_to") - F.unix_millis(now if now is not None else F.current_timestamp())) / 86_400_000)
        certs = tls.groupBy(F.lower("host").alias("site_host")).agg(F.max(F.struct("valid_to", days.alias("days"), "outcome")).alias("c"))
        certs = certs.select("site_host", F.col("c.days").alias("tls_days"), F.col("c.outcome").alias("tls_outcome"))
        out = join_small(out, certs, ["site_host"])
    else:
        out = out.withColumns({"tls_days": F.lit(None).cast("bigint"), "tls_outcome": F.lit(None).cast("string")})
    if names is not None and "anchors" not in names:
        return out
    out = out.withColumns(link_counts())
    if link_status is None:
        return out.withColumn("broken_links", F.lit(0))
    broken = broken_links(out, link_status).groupBy("page_id").agg(F.count("*").cast("int").alias("broken_links"))
    return out.join(broken, "page_id", "left").withColumn("broken_links", F.coalesce("broken_links", F.lit(0)))


def _links() -> Column:
    """Array of (href, link, kind): the counted anchors of a page in order, duplicates included."""
    page = F.col("final_url")

    def link(h: Column) -> Column:
        return urls.let(urls.resolve(h, page), lambda u: F.struct(h.alias("href"), u.alias("link"), urls.link_kind(u, page).alias("kind")))

    return F.transform(F.filter("facts.anchors", urls.counted_link), link)


def page_links(facts: DataFrame) -> DataFrame:
    """(page_id, ordinal, href, link, kind) of each counted anchor of each page, numbered from 1."""
    rows = C.latest(facts.filter("facts is not null").select("page_id", "fetched_at", "loaded_at", _links().alias("l")))
    return rows.select("page_id", F.posexplode("l").alias("at", "l")).select("page_id", (F.col("at") + 1).alias("ordinal"), "l.*")


def link_counts() -> dict[str, Column]:
    """Columns total_links, internal_links and external_links, counted inside the page's own row; 0 without facts."""
    kinds = F.transform(F.filter("facts.anchors", urls.counted_link), lambda h: urls.link_kind(urls.resolve(h, F.col("final_url")), F.col("final_url")))
    both = urls.let(kinds, lambda k: F.struct(F.size(k).alias("n"), F.size(F.filter(k, lambda x: x == "internal")).alias("inner")))
    n, inner = F.coalesce(both["n"], F.lit(0)), F.coalesce(both["inner"], F.lit(0))
    return {"total_links": n, "internal_links": inner, "external_links": n - inner}


def broken_links(facts: DataFrame, link_status: DataFrame) -> DataFrame:
    """(page_id, ordinal, link, status): those of the first ``LIVENESS_LIMIT`` links of a page that don't answer.

    ``link_status`` is (url, status). A link is broken from status 400 on, and where there is no status.
    """
    rows = page_links(facts).filter(F.col("ordinal") <= LIVENESS_LIMIT).select("page_id", "ordinal", "link")
    state = link_status.filter("url is not null").groupBy(F.col("url").alias("link")).agg(F.max("status").alias("status"))
    # every distinct link is looked up once, so that a link of a third of all pages is no hot key
    counted = staged(rows.groupBy("link").agg(F.count("*").alias("n")).join(state, "link", "left").filter("status is null or status >= 400"))
    total = int(counted.agg(F.sum("n")).first()[0] or 0)
    found = join_by_group(rows.filter("link is not null"), counted.filter("link is not null"), ["link"], "n", total)
    return found.unionByName(rows.filter("link is null").withColumn("status", F.lit(None).cast(found.schema["status"].dataType))).select("page_id", "ordinal", "link", "status")


def audit(inputs: DataFrame, categories: tuple[str, ...] = C.ALL) -> DataFrame:
    """(page_id, url, passed, warnings, failed, score) of every page with facts."""
    told = inputs.filter("facts is not null").select("page_id", "url", "fetched_at", "loaded_at", C.all_signals(categories).alias("s"))
    told = C.latest(told).select("page_id", "url", *C.counts(F.col("s")))
    return told.withColumn("score", C.score(F.col("passed"), F.col("warnings"), F.col("failed")))


def json_bodies(checks: DataFrame) -> DataFrame:
    """(page_id, body): the audit of each page as one JSON text, checks in their order, nulls kept."""
    each = F.struct("ordinal", "category", "check", "status", "value")
    told = checks.groupBy("page_id").agg(F.array_sort(F.collect_list(each)).alias("checks"), *(F.sum(b).alias(b) for b in C.BUCKETS))
    total = C.score(*(F.col(b) for b in C.BUCKETS))
    rows = F.transform("checks", lambda c: F.struct(c["category"].alias("category"), c["check"].alias("check"), c["status"].alias("status"), c["value"].alias("value")))
    body = F.struct(F.lit(True).alias("success"), "page_id", total.alias("score"), *C.BUCKETS, rows.alias("checks"))
    return told.select("page_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


@F.pandas_udf(SUMMARY)
def json_ld_summary(scripts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Validity and types of a page's structured-data scripts.

    Types are the ``@type`` texts in first-seen pre-order. A script counts as an error where it isn't
    JSON, isn't an object or array, is an empty array, or names neither ``@context`` nor ``@type``. Only
    the last leaves the page valid by itself; yet a page with more scripts than errors is valid.
    """

    def types(value: object, out: list[str]) -> None:
        todo = [value]
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                kind = v.get("@type")
                out += [kind] if isinstance(kind, str) else [x for x in kind if isinstance(x, str)] if isinstance(kind, list) else []
                todo += reversed([x for x in v.values() if isinstance(x, dict | list)])
            elif isinstance(v, list):
                todo += reversed([x for x in v if isinstance(x, dict | list)])

    def one(texts) -> tuple[int, bool, list[str], list[str]]:
        texts = [] if texts is None else list(texts)
        errors: list[str] = []
        kinds: list[str] = []
        valid = bool(texts)
        for n, text in enumerate(texts, 1):
            try:
                v = json.loads(_COMMENT.sub("", text))
            except (ValueError, RecursionError):
                errors.append(f"JSON-LD {n}: invalid JSON")
                valid = False
                continue
            types(v, kinds)
            named = lambda o: isinstance(o, dict) and bool(o.get("@context") or o.get("@type"))
            if not isinstance(v, dict | list):
                errors.append(f"JSON-LD {n}: no object or array")
                valid = False
            elif v == []:
                errors.append(f"JSON-LD {n}: empty array")
                valid = False
            elif not (any(map(named, v)) if isinstance(v, list) else named(v)):
                errors.append(f"JSON-LD {n}: neither context nor type")
        return len(texts), valid or (bool(texts) and len(errors) < len(texts)), errors, list(dict.fromkeys(kinds))

    for s in scripts:
        yield pd.DataFrame([one(x) for x in s], columns=["count", "valid", "errors", "types"])


def page_issues(r: Column | None = None) -> Column:
    """Ordered critical issues of a report row (columns h1_count, meta, json_ld)."""
    h1 = F.col("h1_count")
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    noindex = F.coalesce(F.contains(F.lower("meta.robots"), F.lit("noindex")), F.lit(False))
    present, valid = F.coalesce("json_ld.present", F.lit(False)), F.coalesce("json_ld.valid", F.lit(False))
    found = F.array(
        F.when(h1 == 0, "missing h1"), F.when(h1 > 1, "several h1"), F.when(empty(F.col("meta.title")), "missing title"),
        F.when(empty(F.col("meta.description")), "missing description"), F.when(noindex, "noindex"), F.when(empty(F.col("meta.canonical")), "missing canonical"),
        F.when(~present, "missing structured data"), F.when(present & ~valid, F.concat(F.lit("invalid structured data: "), F.array_join("json_ld.errors", ", "))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def page_status(issues: Column) -> Column:
    """pass without critical issues, warn for one or two, else fail; issues about twitter don't count."""
    n = F.size(F.filter(issues, lambda x: ~F.lower(x).rlike("twitter:|missing twitter")))
    return F.when(n == 0, "pass").when(n <= 2, "warn").otherwise("fail")


def page_report(facts: DataFrame) -> DataFrame:
    """One report row per page: headings, meta, og, twitter, structured data, sitemap, issues, status.

    A page that couldn't be parsed has the constant failed report: status fail, one issue. Pages with
    null or empty html report as empty documents do.
    """
    f = C.fact
    size = F.coalesce(F.size(f("h1_texts")), F.lit(0))
    size = F.when(F.col("facts").isNull(), 0).otherwise(size)
    base = facts.select(
        "page_id", "url", "fetched_at", "loaded_at", "failed", size.alias("h1_count"),
        F.filter(F.coalesce(f("h1_texts"), F.array().cast("array<string>")), lambda x: x != "").alias("h1_texts"),
        (size == 1).alias("has_single_h1"), F.struct(*(F.coalesce(f(h), F.lit(0)).alias(h) for h in ("h2", "h3", "h4", "h5", "h6"))).alias("heading_counts"),
        F.struct(f("title").alias("title"), *(C.meta(n).alias(n) for n in ("description", "keywords", "robots")), f("canonical").alias("canonical")).alias("meta"),
        F.struct(*(C.prop(f"og:{n}").alias(n) for n in ("title", "description", "image"))).alias("og"),
        F.struct(*(C.meta(f"twitter:{n}").alias(n) for n in ("card", "title", "description", "image"))).alias("twitter"),
        json_ld_summary(F.coalesce(f("json_ld"), F.array().cast("array<string>"))).alias("ld"),
        F.transform(f("json_ld"), lambda x, i: F.struct(x.alias("content"), (i + 1).alias("index"))).alias("data"),
        F.coalesce(urls.resolve(f("sitemap_href"), F.col("url")), f("sitemap_href")).alias("sitemap_url"),
    )
    base = base.withColumn(
        "json_ld", F.struct((F.col("ld.count") > 0).alias("present"), "ld.valid", "ld.count", "ld.errors", "ld.types", "data")
    ).withColumn("sitemap", F.struct(F.col("sitemap_url").isNotNull().alias("present"), F.col("sitemap_url").alias("url"))).drop("ld", "data", "sitemap_url")
    issues = F.when(F.col("failed"), F.array(F.lit("analysis failed"))).otherwise(page_issues())
    base = base.withColumn("issues", issues).withColumn("status", F.when(F.col("failed"), "fail").otherwise(page_status(F.col("issues"))))
    return C.latest(base.drop("failed"))


def with_site_sitemap(reports: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Reports whose sitemap is the one found for their host; ``sitemaps`` is (site_host, sitemap_url)."""
    told = reports.withColumn("site_host", urls.host(F.col("url"))).join(sitemaps, "site_host", "left")
    return told.withColumn("sitemap", F.struct(F.col("sitemap_url").isNotNull().alias("present"), F.col("sitemap_url").alias("url"))).drop("site_host", "sitemap_url")


def score_band(s: Column) -> Column:
    return F.when(s >= 80, "green").when(s >= 60, "yellow").otherwise("red")


def robots_flag(robots: Column) -> Column:
    """Whether a robots text is there and doesn't hide the page."""
    return F.coalesce(~F.contains(F.lower(blank_to_null(robots)), F.lit("noindex")), F.lit(False))
