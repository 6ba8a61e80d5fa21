"""Audit rules as column expressions.

A rule has a status, a value with its kind, and *signals*: how much it adds to the buckets passed, warnings and
failed. Some rules add none, some two, so scores count signals and never statuses. The signals of a rule are one
number, a bucket being ``BITS`` of it, so those of all rules add up without an array. Rules read the columns of ``with_inputs``: the page's facts, its headers as a map with
lower-case keys, final_url, status_code, response_ms, http_redirects, and the joined site inputs robots,
tls_outcome, tls_days, total_links, internal_links, broken_links. A missing header, fact or site input is
null and takes the rule's branch for missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import urls
from sitegauge.functions.text import blank_to_null, utf16_length
from sitegauge.plans.staging import staged

BUCKETS = ("passed", "warnings", "failed")
BITS = 16
P, W, X = 1, 1 << BITS, 1 << 2 * BITS
CHECK = "struct<category string, check string, status string, value string, value_kind string, signals bigint>"
#: Limits of the audit.
TITLE, DESCRIPTION = (30, 60), (120, 160)
LOAD_MS, TTFB_MS, READY_MS = (2000, 3000), (600, 800), 2000
PAGE_MB, CERT_DAYS, ASSET_SECONDS = (3, 5), 30, 86_400
CDN = ("cloudflare", "cloudfront", "fastly", "keycdn", "cdn", "akamai", "maxcdn", "jsdelivr", "cdnjs")


def fact(name: str) -> Column:
    return F.col(f"facts.{name}")


def meta(name: str) -> Column:
    return blank_to_null(F.try_element_at(fact("meta"), F.lit(name)))


def prop(name: str) -> Column:
    return blank_to_null(F.try_element_at(fact("prop"), F.lit(name)))


def header(name: str) -> Column:
    """First value of a header; empty and absent are null."""
    return blank_to_null(F.try_element_at(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(1)))


@dataclass(frozen=True)
class Rule:
    category: str
    check: str
    status: Column
    signals: Column
    value: Column
    kind: str

    def struct(self) -> Column:
        text = self.value.cast("string")
        kind = F.when(text.isNull(), "null").otherwise(self.kind)
        return F.struct(F.lit(self.category), F.lit(self.check), self.status, text, kind, self.signals).cast(CHECK)


def _ladder(*steps: tuple[Column | bool, str, int]) -> tuple[Column, Column]:
    """Status and signals of the first step whose condition holds."""

    def choose(at: int) -> Column:
        out = F.lit(steps[-1][at])
        for step in reversed(steps[:-1]):
            out = F.when(step[0], F.lit(step[at])).otherwise(out)
        return out

    return choose(1), choose(2).cast("bigint")


def _rule(category: str, check: str, ladder: tuple[Column, Column], value: Column, kind: str) -> Rule:
    return Rule(category, check, *ladder, value, kind)


def _present(category: str, check: str, value: Column, missing: str = "warn") -> Rule:
    return _rule(category, check, _ladder((value.isNull(), missing, X if missing == "fail" else W), (True, "pass", P)), value, "string")


def _sized(category: str, check: str, value: Column, low: int, high: int) -> Rule:
    n = utf16_length(value)
    return _rule(category, check, _ladder((value.isNull(), "fail", X), (n < low, "warn", W), (n > high, "warn", W), (True, "pass", P)), value, "string")


def _flag(category: str, check: str, bad: Column, status: str, value: Column) -> Rule:
    return _rule(category, check, _ladder((bad, status, X if status == "fail" else W), (True, "pass", P)), value, "boolean")


def meta_tags() -> list[Rule]:
    robots = meta("robots")
    noindex = F.contains(F.lower(robots), F.lit("noindex"))
    return [
        _sized("meta", "title", fact("title"), *TITLE),
        _sized("meta", "description", meta("description"), *DESCRIPTION),
        _rule("meta", "robots", _ladder((robots.isNull(), "warn", W), (noindex, "fail", X), (True, "pass", P)), robots, "string"),
        _present("meta", "canonical", fact("canonical")),
    ]


def open_graph() -> list[Rule]:
    return [_present("openGraph", f"og:{x}", prop(f"og:{x}")) for x in ("title", "description", "image", "url", "type")]


def twitter() -> list[Rule]:
    card = meta("twitter:card")
    known = card.isin("summary", "summary_large_image")
    first = _rule("twitter", "twitter:card", _ladder((card.isNull(), "warn", W), (~known, "warn", W), (True, "pass", P)), card, "string")
    return [first, *(_present("twitter", f"twitter:{x}", meta(f"twitter:{x}")) for x in ("title", "description", "image"))]


def robots() -> list[Rule]:
    there, closed, named = (F.coalesce(F.col(f"robots.{x}"), F.lit(False)) for x in ("there", "closed", "named"))
    noindex = F.coalesce(F.contains(F.lower(meta("robots")), F.lit("noindex")), F.lit(False))
    return [
        _flag("robots", "robotsTxtExists", ~there, "warn", there),
        _flag("robots", "disallowAll", closed, "fail", closed),
        _flag("robots", "sitemapReference", ~named, "warn", named),
        _flag("robots", "noindexMeta", noindex, "fail", noindex),
    ]


def links() -> list[Rule]:
    broken = F.col("broken_links")
    return [_rule("links", "links", _ladder((broken > 0, "warn", W), (True, "pass", P)), broken, "number")]


def technical() -> list[Rule]:
    https = F.coalesce(F.col("final_url").startswith("https://"), F.lit(False))
    code, h1 = F.col("status_code"), F.size(fact("h1_texts"))
    hop = F.coalesce(F.col("http_redirects"), F.lit(False))
    return [
        _flag("technical", "httpsEnabled", ~https, "fail", https),
        _flag("technical", "httpRedirect", hop, "warn", hop),
        _rule("technical", "statusCode", _ladder((~code.eqNullSafe(F.lit(200)), "fail", X), (True, "pass", P)), code, "number"),
        _present("technical", "viewport", meta("viewport"), "fail"),
        _present("technical", "charset", fact("charset"), "fail"),
        _rule("technical", "h1Count", _ladder((h1 == 0, "fail", X), (True, "pass", P)), h1, "number"),
        _flag("technical", "multipleH1", h1 > 1, "warn", h1 > 1),
    ]


def _timed(check: str, ms: Column, warn: int, fail: int) -> Rule:
    return _rule("performance", check, _ladder((ms == 0, "warn", 0), (ms > fail, "fail", X), (ms > warn, "warn", W), (True, "pass", P)), ms, "number")


def hundredths_of_mb(size: Column) -> Column:
    """Bytes as hundredths of a megabyte, rounded half up."""
    return F.floor((200 * size + (1 << 20)) / (1 << 21)).cast("bigint")


def mb_text(size: Column) -> Column:
    """Bytes as megabytes with two decimals."""
    cents = hundredths_of_mb(size)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def third_party_hosts() -> Column:
    own = urls.host(F.col("final_url"))
    named = F.transform(fact("script_srcs"), lambda s: urls.host(urls.resolve(s, F.col("final_url"))))
    return F.array_distinct(F.filter(named, lambda h: h.isNotNull() & urls.third_party(h, own)))


def performance() -> list[Rule]:
    ms = F.coalesce(F.col("response_ms"), F.lit(0))
    size = F.col("html_bytes")
    mb = 1 << 20
    images = fact("images")
    hosts = F.size(third_party_hosts())
    blocking = (fact("blocking_scripts") > 3) | (fact("blocking_styles") > 3)
    slow_images = (2 * fact("modern_images") < images) & (2 * fact("lazy_images") < images)
    return [
        _timed("pageLoadTime", ms, *LOAD_MS),
        _timed("ttfb", ms, *TTFB_MS),
        _rule("performance", "domContentLoaded", _ladder((ms > READY_MS, "warn", W), (True, "pass", P)), ms, "number"),
        _rule("performance", "totalPageSize", _ladder((size > PAGE_MB[1] * mb, "fail", X), (size > PAGE_MB[0] * mb, "warn", W), (True, "pass", P)), mb_text(size), "number"),
        _rule("performance", "imageOptimization", _ladder((images == 0, "pass", 0), (slow_images, "warn", W), (True, "pass", P)), images, "number"),
        _rule("performance", "renderBlockingResources", _ladder((blocking, "warn", W), (True, "pass", P)), fact("blocking_scripts") + fact("blocking_styles"), "number"),
        _rule("performance", "fontLoading", _ladder(((fact("font_links") > 0) & ~fact("font_display"), "warn", W), (True, "pass", P)), fact("font_links"), "number"),
        _rule("performance", "thirdPartyScripts", _ladder((hosts > 5, "warn", W), (True, "pass", P)), hosts, "number"),
    ]


def security() -> list[Rule]:
    https = F.coalesce(F.col("final_url").startswith("https://"), F.lit(False))
    csp, frame, sniff = header("content-security-policy"), header("x-frame-options"), header("x-content-type-options")
    hsts = header("strict-transport-security")
    policy = F.coalesce(header("permissions-policy"), header("feature-policy"))
    days, outcome, mixed = F.col("tls_days"), F.col("tls_outcome"), fact("mixed_content")
    cookies = F.filter(F.coalesce(F.try_element_at(F.col("headers"), F.lit("set-cookie")), F.array().cast("array<string>")), lambda c: c != "")
    open_cookie = F.exists(cookies, lambda c: ~reduce(lambda a, b: a & b, (F.contains(F.lower(c), F.lit(x)) for x in ("secure", "httponly", "samesite"))))
    unsafe = F.contains(csp, F.lit("unsafe-inline")) | F.contains(csp, F.lit("unsafe-eval"))
    return [
        _rule("security", "contentSecurityPolicy", _ladder((csp.isNull(), "warn", W), (unsafe, "warn", W), (True, "pass", P)), csp, "string"),
        _rule("security", "xFrameOptions", _ladder((frame.isNull(), "warn", W), (~F.upper(frame).isin("DENY", "SAMEORIGIN"), "warn", W), (True, "pass", P)), frame, "string"),
        _rule("security", "xContentTypeOptions", _ladder((sniff.isNull(), "warn", W), (F.lower(sniff) != "nosniff", "warn", W), (True, "pass", P)), sniff, "string"),
        _rule("security", "strictTransportSecurity", _ladder((~https, "warn", 0), (hsts.isNull(), "warn", W), (~F.contains(hsts, F.lit("max-age")), "warn", W), (True, "pass", P)), hsts, "string"),
        _present("security", "referrerPolicy", header("referrer-policy")),
        _present("security", "permissionsPolicy", policy),
        _rule("security", "sslCertificate", _ladder((~https, "fail", 0), (outcome.isin("error", "timeout") | outcome.isNull(), "warn", W), (days.isNull() | (days < 0), "fail", X), (days < CERT_DAYS, "warn", W), (True, "pass", P)), days, "number"),
        _rule("security", "mixedContent", _ladder((~https, "warn", 0), (mixed > 0, "fail", X), (True, "pass", P)), mixed, "number"),
        _rule("security", "cookieSecurity", _ladder((F.size(cookies) == 0, "warn", 0), (open_cookie, "warn", W), (True, "pass", P)), F.size(cookies), "number"),
    ]


def accessibility() -> list[Rule]:
    images, missing, empty = fact("images"), fact("alt_missing"), fact("alt_empty")
    fine = (missing + empty == 0) & (images > 0)
    alt_signals = F.when(fine, P).otherwise(F.when(missing > 0, F.lit(X).cast("bigint")).otherwise(0) + F.when(empty > 0, W).otherwise(0))
    alt_status = F.when(fine, "pass").when(missing > 0, "fail").otherwise("warn")
    controls, bare, levels = fact("controls"), fact("unlabelled"), fact("headings")
    jumps = F.size(F.filter(F.arrays_zip(levels.alias("now"), F.concat(F.array(F.lit(0)), levels).alias("before")), lambda p: (p["before"] > 0) & (p["now"] > p["before"] + 1)))
    jumps = jumps + F.when(F.size(fact("h1_texts")) > 1, 1).otherwise(0)
    plain = (fact("semantic") == 0) & ((fact("divs") > 10) | (fact("spans") > 10))
    return [
        _rule("accessibility", "altText", (alt_status, alt_signals), images, "number"),
        _rule("accessibility", "formLabels", _ladder(((bare == 0) & (controls > 0), "pass", P), (bare > 0, "warn", W), (True, "pass", 0)), bare, "number"),
        _rule("accessibility", "ariaAttributes", _ladder((fact("aria_issues") > 0, "warn", W), (True, "pass", P)), fact("aria_issues"), "number"),
        _rule("accessibility", "headingHierarchy", _ladder((jumps > 0, "warn", W), (F.size(levels) > 0, "pass", P), (True, "warn", 0)), jumps, "number"),
        _rule("accessibility", "semanticHtml", _ladder((plain, "warn", W), (True, "pass", P)), fact("semantic"), "number"),
        _rule("accessibility", "keyboardNavigation", _ladder((fact("keyboard_issues") > 0, "warn", W), (True, "pass", P)), fact("keyboard_issues"), "number"),
        _rule("accessibility", "focusIndicators", _ladder((fact("outline_removed") > 0, "warn", W), (True, "pass", P)), fact("outline_removed"), "number"),
    ]


def analytics() -> list[Rule]:
    found = lambda check, name: _rule("analytics", check, _ladder((fact(name), "pass", P), (True, "warn", 0)), fact(name), "boolean")
    consent = _rule("analytics", "trackingConsent", _ladder((~fact("tracking"), "pass", 0), (fact("consent"), "pass", P), (True, "warn", W)), fact("consent"), "boolean")
    return [found("googleAnalytics", "analytics"), found("googleTagManager", "tag_manager"), found("facebookPixel", "pixel"), consent]


def caching() -> list[Rule]:
    control = header("cache-control")
    never = F.contains(control, F.lit("no-cache")) | F.contains(control, F.lit("no-store"))
    age = F.expr("try_cast(regexp_extract(headers['cache-control'][0], 'max-age=(\\\\d+)', 1) as bigint)")
    many = "|".join(CDN)
    cdn = F.coalesce(F.lower(header("server")).rlike(many), F.lit(False)) | F.coalesce(F.lower(header("via")).rlike(many), F.lit(False))
    cdn = cdn | header("x-cdn").isNotNull() | header("x-cache").isNotNull()
    asset = urls.static_asset(F.col("final_url"))
    return [
        _rule("caching", "cacheControl", _ladder((control.isNull(), "warn", W), (never, "warn", W), (~F.contains(control, F.lit("max-age")), "warn", W), (True, "pass", P)), control, "string"),
        _present("caching", "etag", header("etag")),
        _flag("caching", "cdnUsage", ~cdn, "warn", cdn),
        _rule("caching", "staticAssetCaching", _ladder((~asset, "pass", 0), (control.isNull(), "warn", W), (F.coalesce(age, F.lit(0)) < ASSET_SECONDS, "warn", W), (True, "pass", P)), control, "string"),
    ]


CATEGORIES = {
    "meta": meta_tags, "openGraph": open_graph, "twitter": twitter, "robots": robots, "links": links, "technical": technical,
    "performance": performance, "security": security, "accessibility": accessibility, "analytics": analytics, "caching": caching,
}
#: Page facts that the rules of a category read.
NEEDS = {
    "meta": ("title", "meta", "canonical"), "openGraph": ("prop",), "twitter": ("meta",), "robots": ("meta",), "links": ("anchors",),
    "technical": ("meta", "charset", "h1_texts"), "performance": ("images", "modern_images", "lazy_images", "blocking_scripts", "blocking_styles", "font_links", "font_display", "script_srcs"),
    "security": ("mixed_content",), "accessibility": ("images", "alt_missing", "alt_empty", "controls", "unlabelled", "headings", "h1_texts", "semantic", "divs", "spans", "aria_issues", "keyboard_issues", "outline_removed"),
    "analytics": ("analytics", "tag_manager", "pixel", "tracking", "consent"), "caching": (),
}
ALL = tuple(CATEGORIES)


def needs(categories: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(["nodes", *(f for c in categories for f in NEEDS[c])]))


def latest(rows: DataFrame) -> DataFrame:
    """One row per page_id; of several fetches the latest stays. ``rows`` has page_id, fetched_at and loaded_at.

    Applied to what was read off the pages, never to the pages: html doesn't move.
    """
    rest = [c for c in rows.columns if c not in ("page_id", "fetched_at", "loaded_at")]
    pick = F.max_by(F.struct(*rest), F.struct("fetched_at", "loaded_at", F.hash(*rest)))
    return rows.groupBy("page_id").agg(pick.alias("row")).select("page_id", "row.*")


def checks(inputs: DataFrame, categories: tuple[str, ...] = ALL) -> DataFrame:
    """(page_id, category, check, ordinal, status, value, value_kind, passed, warnings, failed): a row per page and rule.

    Pages without facts (null or empty html) give no row. Unasked categories are never computed.
    """
    if len(categories) > 1:
        # read back by category, each reading only its own columns, rather than one plan of all rules
        inputs = staged(inputs)
    out, start = None, 0
    for c in categories:
        rules = CATEGORIES[c]()
        rows = inputs.filter("facts is not null").select("page_id", "fetched_at", "loaded_at", F.array(*(r.struct() for r in rules)).alias("rules"))
        rows = latest(rows).select("page_id", F.posexplode("rules").alias("at", "c"))
        rows = rows.select("page_id", "c.category", "c.check", (F.col("at") + start).alias("ordinal"), "c.status", "c.value", "c.value_kind", *counts(F.col("c.signals")))
        out, start = rows if out is None else out.unionByName(rows), start + len(rules)
    return out


def all_signals(categories: tuple[str, ...] = ALL) -> Column:
    """The added signals of all rules of a page."""
    return reduce(lambda a, b: a + b, (rule.signals for c in categories for rule in CATEGORIES[c]()))


def counts(signals: Column) -> list[Column]:
    """Columns passed, warnings and failed of added signals."""
    return [F.shiftright(signals, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(b) for k, b in enumerate(BUCKETS)]


def score(p: Column, w: Column, x: Column) -> Column:
    """Share of signals passed, half for warnings, as a whole percentage rounded half up; 0 where none."""
    total = p + w + x
    return F.when(total > 0, F.floor((200 * p + 100 * w + total) / (2 * total)).cast("int")).otherwise(0)
