"""Locale labels, report filters and site roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: URL marks and what they stand for, first match wins, the last is the default.
LOCALES = (("en-au", "en-AU", "AU", "Australia"), ("en-gb", "en-GB", "GB", "United Kingdom"), ("", "en-US", "US", "United States"))


def locale_of(url: Column) -> Column:
    """Locale struct of a URL by its marks; null and unmarked URLs are en-US."""
    pick = lambda row: F.struct(*(F.lit(v).alias(n) for v, n in zip(row[1:], ("locale", "region", "display_name"), strict=True)))
    out = pick(LOCALES[-1])
    for row in reversed(LOCALES[:-1]):
        out = F.when(F.contains(F.lower(url), F.lit(row[0])), pick(row)).otherwise(out)
    return out


def by_locale(reports: DataFrame) -> DataFrame:
    """(locale, region, display_name, pages, pass, warn, fail, rank): counts per locale, en-US first."""
    rows = reports.select(locale_of(F.col("url")).alias("l"), "status")
    out = rows.groupBy("l.locale", "l.region", "l.display_name").agg(F.count("*").alias("pages"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))
    order = F.struct(F.col("locale") != "en-US", F.col("display_name"))
    all_orders = F.array(*(F.struct(F.lit(r[1] != "en-US"), F.lit(r[3])) for r in LOCALES))
    return out.withColumn("rank", F.size(F.filter(all_orders, lambda o: o <= order)))


def regions(reports: DataFrame) -> DataFrame:
    """(display_name, pages, rank): the regions that a site has, if they are more than one."""
    found = by_locale(reports).select("display_name", "pages", "rank")
    return found.join(F.broadcast(found.agg(F.count("*").alias("all"))), F.col("all") > 1).drop("all")


def displayed(reports: DataFrame) -> DataFrame:
    """(view, locale, shown, total): how many of all reports each view of each locale shows; locale 'all' is every one."""
    counts = [F.count_if(c).alias(v) for v, c in _views().items()]
    by = reports.groupBy(locale_of(F.col("url"))["locale"].alias("locale")).agg(*counts)
    whole = by.agg(*(F.sum(v).alias(v) for v in _views())).withColumn("locale", F.lit("all"))
    rows = by.unionByName(whole).select("locale", F.inline(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("shown")) for v in _views()))))
    total = reports.agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(total)).select("view", "locale", F.coalesce("shown", F.lit(0)).alias("shown"), "total")


def security_headers(checks: DataFrame) -> DataFrame:
    """(page_id, secure_headers): whether both the content policy and the frame options of a page pass."""
    told = checks.filter(F.col("check").isin("contentSecurityPolicy", "xFrameOptions"))
    return told.groupBy("page_id").agg((F.count_if(F.col("status") == "pass") == 2).alias("secure_headers"))


def status_counts(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("pages"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))


def _views() -> dict[str, Column]:
    return {
        "all": F.lit(True), "failed": F.col("status") == "fail", "missingH1": ~F.coalesce("has_single_h1", F.lit(False)),
        "missingDescription": F.coalesce(F.col("meta.description") == "", F.lit(True)),
    }


def filtered(reports: DataFrame, view: str = "all", locale: str | None = None) -> DataFrame:
    """Reports of a view: all, failed, missingH1 (any page without exactly one) or missingDescription."""
    out = reports.filter(_views()[view])
    return out if locale is None else out.filter(locale_of(F.col("url"))["locale"] == locale)


def card_flags() -> dict[str, Column]:
    """Display flags of a report card: robots allows, no twitter data at all, issues beyond the first five."""
    robots = F.col("meta.robots")
    return {
        "indexable": F.coalesce((robots != "") & ~F.contains(F.lower(robots), F.lit("noindex")), F.lit(False)),
        "no_twitter": F.coalesce("twitter.card", "twitter.title", "twitter.description", "twitter.image").isNull(),
        "more_issues": F.greatest(F.coalesce(F.size("issues"), F.lit(0)) - 5, F.lit(0)),
    }


def badge(status: Column) -> Column:
    return F.struct(F.initcap(status).alias("label"), F.when(status == "pass", "✓").when(status == "warn", "⚠").when(status == "fail", "✗").alias("icon"))


def words_of_key(key: Column) -> Column:
    """A check's key as words: a space before every capital."""
    return F.trim(F.regexp_replace(key, "([A-Z])", " $1"))
