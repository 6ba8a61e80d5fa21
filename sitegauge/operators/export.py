"""Exports as line tables, to be written by ``DataFrame.write``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import file_stem
from sitegauge.operators.rollups import words_of_key

#: Titles, column names and lines of exports, and the answers to bad requests.
PAGE_TITLE, CRAWL_TITLE = "SEO Analysis Report", "SEO Crawl Analysis Report"
CHECK_COLUMNS = "Category,Status,Message,Value,Recommendation"
LINK_LINES = (("Total", "Total links found", "total_links"), ("Internal", "Internal links", "internal_links"), ("External", "External links", "external_links"))
NO_URL, BAD_LIMIT = "URL parameter is required", "maxPages must be a number between 1 and 1000"
PRINTED_BROKEN = 10
#: Names of the categories in exports, in order; columns of the crawl export.
LABELS = {
    "meta": "Meta Tags", "openGraph": "Open Graph", "twitter": "Twitter", "robots": "Robots", "links": "Links", "technical": "Technical",
    "performance": "Performance", "security": "Security", "accessibility": "Accessibility", "analytics": "Analytics", "caching": "Caching",
}
HEADER = "URL,Status,H1 Count,H1 Text,Title,Meta Description,Canonical,OG Title,OG Description,OG Image,Twitter Card,JSON-LD Present,JSON-LD Valid,Issues"


def csv_field(value: Column) -> Column:
    """A CSV field: null is empty; quoted only where it holds a comma, quote or line feed."""
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def crawl_lines(reports: DataFrame) -> DataFrame:
    """(report_id, line): one CSV line per report, in ``HEADER``'s columns."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")
    fields = [
        csv_field(F.col("url")), F.coalesce("status", F.lit("")), F.coalesce(F.col("h1_count").cast("string"), F.lit("")), csv_field(F.array_join("h1_texts", "; ")),
        *(csv_field(F.col(c)) for c in ("meta.title", "meta.description", "meta.canonical", "og.title", "og.description", "og.image", "twitter.card")),
        yes(F.col("json_ld.present")), yes(F.col("json_ld.valid")), csv_field(F.array_join("issues", "; ")),
    ]
    return reports.select("report_id", F.concat_ws(",", *fields).alias("line"))


def crawl_file(reports: DataFrame, generated: Column) -> DataFrame:
    """(line_no, report_id, line): the crawl export with its preamble; line_no orders the preamble, reports follow by url.

    Reports all have line_no 6: a sink that needs one ordered file sorts by line_no, url; nothing is numbered here, since
    numbering billions of lines would take one task.
    """
    count = reports.agg(F.concat(F.lit("Total Pages,"), F.count("*").cast("string")).alias("total"))
    head = F.array(F.lit(CRAWL_TITLE), F.col("total"), F.concat(F.lit("Generated,"), iso_time(generated)), F.lit(""), F.lit(HEADER))
    top = count.select(F.posexplode(head).alias("at", "line")).select((F.col("at") + 1).alias("line_no"), F.lit(None).cast("bigint").alias("report_id"), "line")
    return top.unionByName(crawl_lines(reports).select(F.lit(6).alias("line_no"), "report_id", "line"))


def iso_time(ts: Column) -> Column:
    """A UTC time stamp as ISO 8601 text with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def message(check: Column, status: Column) -> Column:
    """What a check's line says: its key as words, and how it ended."""
    told = F.when(status == "pass", "is fine").when(status == "warn", "needs attention").otherwise("fails")
    return F.concat_ws(" ", F.initcap(words_of_key(check)), told)


def advice(check: Column, status: Column) -> Column:
    """What to do about a check that didn't pass; null for one that did."""
    return F.when(status != "pass", F.concat(F.lit("Review "), F.lower(words_of_key(check))))


def page_lines(checks: DataFrame) -> DataFrame:
    """(page_id, ordinal, category, line): one CSV line per check of a page."""
    label = F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.col("category"))
    fields = ["status", csv_field(message(F.col("check"), F.col("status"))), csv_field(F.col("value")), csv_field(advice(F.col("check"), F.col("status")))]
    line = F.concat_ws(",", F.concat_ws(" - ", label, "check"), *fields)
    return checks.select("page_id", "ordinal", "category", line.alias("line"))


def _by_page(rows: DataFrame, order: str, *fields: str) -> DataFrame:
    """The rows of each page as one ordered array; pages have a bounded number of them."""
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("rows"))


def page_file(checks: DataFrame, scores: DataFrame, counts: DataFrame, broken: DataFrame) -> DataFrame:
    """(page_id, line_no, line): the whole export of each page.

    ``checks`` is as ``checks.checks`` gives it, ``scores`` (page_id, url, passed, warnings, failed, score),
    ``counts`` (page_id, total_links, internal_links, external_links), ``broken`` (page_id, ordinal, link, status).
    Pages without scores give nothing.
    """
    text = lambda c: F.col(c).cast("string")
    lines = page_lines(checks)
    at_links = min(k for k, c in enumerate(LABELS) if c == "links")
    early = F.col("category").isin(*list(LABELS)[:at_links])
    before = _by_page(lines.filter(early), "ordinal", "line").withColumnRenamed("rows", "before")
    after = _by_page(lines.filter(~early & (F.col("category") != "links")), "ordinal", "line").withColumnRenamed("rows", "after")
    bad = F.concat(F.lit("Broken Link,broken,"), csv_field(F.col("link")), F.lit(",Status: "), F.coalesce(text("status"), F.lit("none")), F.lit(","))
    bad = _by_page(broken.select("page_id", "ordinal", bad.alias("line")), "ordinal", "line").withColumnRenamed("rows", "broken")
    page = scores.join(counts.drop("url"), "page_id").join(before, "page_id", "left").join(after, "page_id", "left").join(bad, "page_id", "left")
    head = [
        F.lit(PAGE_TITLE), F.concat(F.lit("URL,"), csv_field(F.col("url"))), F.concat(F.lit("Overall Score,"), text("score"), F.lit("/100")),
        F.concat(F.lit("Passed Checks,"), text("passed")), F.concat(F.lit("Warnings,"), text("warnings")), F.concat(F.lit("Failed Checks,"), text("failed")),
        F.lit(""), F.lit("Summary"), F.lit(CHECK_COLUMNS),
    ]
    links = [
        F.concat(F.lit(f"Links - {name} Links,info,{told},"), text(c), F.lit(","))
        for name, told, c in LINK_LINES
    ]
    none = F.array().cast("array<string>")
    part = lambda c: F.coalesce(F.transform(c, lambda x: x["line"]), none)
    title = F.when(F.size("broken") > 0, F.array(F.lit("Links - Broken Links"))).otherwise(none)
    whole = F.concat(F.array(*head), part("before"), F.array(*links), title, part("broken"), part("after"))
    return page.select("page_id", F.posexplode(whole).alias("at", "line")).select("page_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def page_print(checks: DataFrame, scores: DataFrame, broken: DataFrame) -> DataFrame:
    """(page_id, line_no, text, style): the text of a printed page report; the first ten broken links are shown."""
    line = lambda text, style: F.struct(text.alias("text"), style.alias("style"))
    lit, text = F.lit, lambda c: F.col(c).cast("string")
    none = F.array().cast("array<struct<text string, style string>>")
    label = F.element_at(F.create_map(*(lit(x) for pair in LABELS.items() for x in pair)), F.col("category"))
    told = line(F.concat(lit("  "), "check", lit(": "), message(F.col("check"), F.col("status"))), F.col("status"))
    more = F.when(F.col("status") != "pass", F.array(line(F.concat(lit("    Recommendation: "), advice(F.col("check"), F.col("status"))), lit("note")))).otherwise(none)
    rows = checks.filter("category <> 'links'").select("page_id", "ordinal", label.alias("label"), F.concat(F.array(told), more).alias("lines"))
    body = _by_page(rows, "ordinal", "label", "lines")
    # a section's title stands before the first check of its category
    with_titles = F.transform("rows", lambda r, i: F.concat(F.when((i == 0) | (F.get("rows", i - 1)["label"] != r["label"]), F.array(line(r["label"], lit("section")))).otherwise(none), r["lines"]))
    body = body.select("page_id", F.flatten(with_titles).alias("body"))
    bad = _by_page(broken, "ordinal", "link", "status").withColumnRenamed("rows", "broken")
    shown = F.transform(F.slice("broken", 1, PRINTED_BROKEN), lambda b: line(F.concat(lit("    - "), F.coalesce(b["link"], lit("")), lit(" ("), F.coalesce(b["status"].cast("string"), lit("none")), lit(")")), lit("fail")))
    count = F.array(line(F.concat(lit("  Broken Links: "), F.size("broken").cast("string")), lit("fail")))
    page = scores.join(body, "page_id", "left").join(bad, "page_id", "left")
    band = F.when(F.col("score") >= 80, "pass").when(F.col("score") >= 60, "warn").otherwise("fail")
    head = F.array(
        line(lit(PAGE_TITLE), lit("title")), line(F.concat(lit("URL: "), "url"), lit("link")), line(F.concat(lit("Overall SEO Score: "), text("score"), lit("/100")), band),
        line(lit("Summary"), lit("section")), *(line(F.concat(lit(f"{n}: "), text(c)), lit("text")) for n, c in (("Passed", "passed"), ("Warnings", "warnings"), ("Failed", "failed"))),
    )
    whole = F.concat(head, F.coalesce("body", none), F.when(F.size("broken") > 0, F.concat(count, shown)).otherwise(none))
    return page.select("page_id", F.posexplode(whole).alias("at", "l")).select("page_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "l.text", "l.style")


def crawl_json(reports: DataFrame) -> DataFrame:
    """(report_id, body): each report of a crawl's answer as one JSON text, nulls kept."""
    body = F.struct("url", "status", F.col("h1_count").alias("h1Count"), F.struct("meta.title", "meta.description").alias("meta"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
    return reports.select("report_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def request_answer(requests: DataFrame) -> DataFrame:
    """(url, max_pages, http_status, error): what a crawl request is refused with; status 200 and a null error if it isn't."""
    n = F.try_to_number(F.col("max_pages"), F.lit("S9999999999"))
    bad = F.col("max_pages").isNotNull() & (F.col("max_pages") != "") & F.coalesce((n < 1) | (n > 1000), F.lit(True))
    missing = F.coalesce(F.col("url") == "", F.lit(True))
    error = F.when(missing, NO_URL).when(bad, BAD_LIMIT)
    return requests.select("url", "max_pages", F.when(error.isNull(), 200).otherwise(400).alias("http_status"), error.alias("error"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write column ``line`` as text files, replacing what is there."""
    lines.select("line").write.mode("overwrite").text(path)


def file_name(kind: str, url: Column, now: Column, ending: str) -> Column:
    """Name of an exported file: its kind, the address as a stem, milliseconds since 1970, its ending."""
    return F.concat(F.lit(f"{kind}-"), file_stem(url), F.lit("-"), F.unix_millis(now).cast("string"), F.lit(f".{ending}"))


def status_lines(reports: DataFrame) -> DataFrame:
    """(line_no, text, style): the summary that a printed crawl report begins with."""
    counts = reports.agg(F.count("*").alias("pages"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))
    line = lambda text, style: F.struct(text.alias("text"), F.lit(style).alias("style"))
    said = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    rows = F.array(line(F.lit(CRAWL_TITLE), "title"), line(said("Total Pages Analyzed", "pages"), "text"), line(F.lit("Summary"), "section"), line(said("Passed", "pass"), "pass"), line(said("Warnings", "warn"), "warn"), line(said("Failed", "fail"), "fail"), line(F.lit("Page Details"), "section"))
    return counts.select(F.posexplode(rows).alias("at", "l")).select((F.col("at") + 1).cast("bigint").alias("line_no"), "l.text", "l.style")


def report_lines(reports: DataFrame) -> DataFrame:
    """(report_id, line_no, text, style): the text of a printed crawl report, description and issues cut
    as the layout shows them (100 characters, three issues)."""
    desc = F.when(F.length("meta.description") > 100, F.concat(F.substring("meta.description", 1, 100), F.lit("..."))).otherwise(F.col("meta.description"))
    head = [F.struct(F.col("url").alias("text"), F.lit("heading").alias("style")), F.struct(F.upper("status").alias("text"), F.col("status").alias("style")), F.struct(F.col("meta.title").alias("text"), F.lit("text").alias("style")), F.struct(desc.alias("text"), F.lit("text").alias("style"))]
    issues = F.transform(F.slice(F.coalesce("issues", F.array().cast("array<string>")), 1, 3), lambda x: F.struct(x.alias("text"), F.lit("issue").alias("style")))
    lines = F.filter(F.concat(F.array(*head), issues), lambda l: l["text"].isNotNull())
    return reports.select("report_id", F.posexplode(lines).alias("line_no", "l")).select("report_id", "line_no", "l.text", "l.style")
