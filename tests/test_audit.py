import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import checks, dom, export, report
from sitegauge.plans import staging

PAGE = "page_id long, url string, final_url string, status_code int, headers map<string,array<string>>, html string, response_ms long, http_redirects boolean"


def page(html="<p>x</p>", headers=None, ms=100, code=200, url="https://a.test/", hop=False):
    return (1, url, None, code, headers, html, ms, hop)


def signals(r):
    return [b for b in checks.BUCKETS for _ in range(r[b])]


def status(spark, check, category, *rows, **inputs):
    df = report.with_inputs(spark.createDataFrame(list(rows), PAGE), **inputs)
    r = checks.checks(df, (category,)).filter(F.col("check") == check).first()
    return r.status, signals(r)


def m(name, value, attr="name"):
    return {"html": f'<meta {attr}="{name}" content="{value}">'}


def h(**kw):
    return {"headers": {k.replace("_", "-"): [v] for k, v in kw.items()}}


S, HTTP = "<script src='https://t{}.other/x.js'></script>", {"url": "http://a.test/"}
DIVS, N = "<div>" * 11, []
P, W, X = ["passed"], ["warnings"], ["failed"]
#: (check, what the page has, status, signals): every branch of every rule.
BRANCHES = [
    *(("title", {"html": f"<title>{'t' * n}</title>"}, s, g) for n, s, g in ((0, "fail", X), (29, "warn", W), (30, "pass", P), (60, "pass", P), (61, "warn", W))),
    ("title", {"html": f"<title>{'😀' * 15}</title>"}, "pass", P),
    *(("description", m("description", "d" * n), s, g) for n, s, g in ((0, "fail", X), (119, "warn", W), (120, "pass", P), (160, "pass", P), (161, "warn", W))),
    ("robots", {}, "warn", W), ("robots", m("robots", "NOINDEX, follow"), "fail", X), ("robots", m("robots", "index"), "pass", P),
    ("canonical", {}, "warn", W), ("canonical", {"html": "<link rel=canonical href=/x>"}, "pass", P),
    *((f"og:{x}", m(f"og:{x}", "v", "property"), "pass", P) for x in ("title", "description", "image", "url", "type")), *((f"og:{x}", {}, "warn", W) for x in ("title", "description", "image", "url", "type")),
    ("twitter:card", {}, "warn", W), ("twitter:card", m("twitter:card", "player"), "warn", W), ("twitter:card", m("twitter:card", "summary"), "pass", P), ("twitter:card", m("twitter:card", "summary_large_image"), "pass", P),
    *((f"twitter:{x}", m(f"twitter:{x}", "v"), "pass", P) for x in ("title", "description", "image")), *((f"twitter:{x}", {}, "warn", W) for x in ("title", "description", "image")),
    ("noindexMeta", m("robots", "noindex"), "fail", X), ("noindexMeta", {}, "pass", P),
    ("httpsEnabled", {}, "pass", P), ("httpsEnabled", HTTP, "fail", X), ("httpRedirect", {"hop": True}, "warn", W), ("httpRedirect", {"hop": None}, "pass", P),
    ("statusCode", {}, "pass", P), ("statusCode", {"code": 404}, "fail", X), ("statusCode", {"code": None}, "fail", X),
    ("viewport", {}, "fail", X), ("viewport", m("viewport", "v"), "pass", P), ("charset", {}, "fail", X), ("charset", {"html": "<meta charset=utf-8>"}, "pass", P), ("charset", m("content-type", "text/html; charset=x", "http-equiv"), "pass", P),
    ("h1Count", {}, "fail", X), ("h1Count", {"html": "<h1>a"}, "pass", P), ("multipleH1", {"html": "<h1>a</h1><h1>b"}, "warn", W), ("multipleH1", {}, "pass", P),
    *(("pageLoadTime", {"ms": n}, s, g) for n, s, g in ((None, "warn", N), (2000, "pass", P), (2001, "warn", W), (3000, "warn", W), (3001, "fail", X))),
    *(("ttfb", {"ms": n}, s, g) for n, s, g in ((0, "warn", N), (600, "pass", P), (601, "warn", W), (800, "warn", W), (801, "fail", X))),
    ("domContentLoaded", {"ms": 2000}, "pass", P), ("domContentLoaded", {"ms": 2001}, "warn", W),
    ("totalPageSize", {}, "pass", P), ("totalPageSize", {"html": "x" * (3 << 20) + "y"}, "warn", W), ("totalPageSize", {"html": "x" * (5 << 20) + "y"}, "fail", X),
    ("imageOptimization", {}, "pass", N), ("imageOptimization", {"html": "<img src=a.png>" * 3 + "<img src=a.webp>"}, "warn", W), ("imageOptimization", {"html": "<img src=a.png loading=lazy>"}, "pass", P), ("imageOptimization", {"html": "<img src=a.avif>"}, "pass", P),
    ("renderBlockingResources", {"html": "<script src=/a></script>" * 4}, "warn", W), ("renderBlockingResources", {"html": "<script async src=/a></script>" * 9}, "pass", P), ("renderBlockingResources", {"html": "<link rel=stylesheet href=/a>" * 4}, "warn", W), ("renderBlockingResources", {"html": "<link rel=stylesheet media=print href=/a>" * 4}, "pass", P),
    ("fontLoading", {}, "pass", P), ("fontLoading", {"html": "<link rel=stylesheet href=/font.css>"}, "warn", W), ("fontLoading", {"html": "<link rel=stylesheet href=/font.css><style>@font-face{font-display:swap}</style>"}, "pass", P),
    ("thirdPartyScripts", {"html": "".join(S.format(k) for k in range(5))}, "pass", P), ("thirdPartyScripts", {"html": "".join(S.format(k) for k in range(6))}, "warn", W), ("thirdPartyScripts", {"html": "".join(f"<script src=https://s{k}.a.test/x></script>" for k in range(9))}, "pass", P),
    ("contentSecurityPolicy", {}, "warn", W), ("contentSecurityPolicy", h(Content_Security_Policy="script-src 'unsafe-eval'"), "warn", W), ("contentSecurityPolicy", h(content_security_policy="default-src 'self'"), "pass", P),
    ("xFrameOptions", {}, "warn", W), ("xFrameOptions", h(x_frame_options="allow"), "warn", W), ("xFrameOptions", h(x_frame_options="sameorigin"), "pass", P),
    ("xContentTypeOptions", {}, "warn", W), ("xContentTypeOptions", h(x_content_type_options="no"), "warn", W), ("xContentTypeOptions", h(x_content_type_options="NoSniff"), "pass", P),
    ("strictTransportSecurity", HTTP, "warn", N), ("strictTransportSecurity", {}, "warn", W), ("strictTransportSecurity", h(strict_transport_security="x"), "warn", W), ("strictTransportSecurity", h(strict_transport_security="max-age=1"), "pass", P),
    ("referrerPolicy", {}, "warn", W), ("referrerPolicy", h(referrer_policy="x"), "pass", P), ("permissionsPolicy", {}, "warn", W), ("permissionsPolicy", h(feature_policy="x"), "pass", P), ("permissionsPolicy", h(permissions_policy="x"), "pass", P),
    ("sslCertificate", HTTP, "fail", N), ("sslCertificate", {}, "warn", W),
    ("mixedContent", HTTP, "warn", N), ("mixedContent", {"html": "<img src=http://x/y>"}, "fail", X), ("mixedContent", {"html": "<img src=https://x/y>"}, "pass", P),
    ("cookieSecurity", {}, "warn", N), ("cookieSecurity", h(set_cookie="a; Secure"), "warn", W), ("cookieSecurity", h(Set_Cookie="a; Secure; HttpOnly; SameSite=Lax"), "pass", P),
    ("altText", {}, "warn", N), ("altText", {"html": "<img><img alt=' '>"}, "fail", ["warnings", "failed"]), ("altText", {"html": "<img alt=''>"}, "warn", W), ("altText", {"html": "<img alt=x>"}, "pass", P),
    ("formLabels", {}, "pass", N), ("formLabels", {"html": "<label for=i>x</label><input id=i>"}, "pass", P), ("formLabels", {"html": "<label>x<input></label><select></select>"}, "warn", W), ("formLabels", {"html": "<input type=hidden>"}, "pass", P),
    ("ariaAttributes", {}, "pass", P), ("ariaAttributes", {"html": "<button></button>"}, "warn", W), ("ariaAttributes", {"html": "<input aria-required=true>"}, "warn", W), ("ariaAttributes", {"html": "<a href=/ aria-hidden=true>x</a>"}, "warn", W), ("ariaAttributes", {"html": "<button class=c aria-label=x></button>"}, "pass", P),
    ("headingHierarchy", {}, "warn", N), ("headingHierarchy", {"html": "<h1>a</h1><h3>b</h3>"}, "warn", W), ("headingHierarchy", {"html": "<h1>a</h1><h2>b</h2>"}, "pass", P), ("headingHierarchy", {"html": "<h1>a</h1><h1>b</h1>"}, "warn", W),
    ("semanticHtml", {}, "pass", P), ("semanticHtml", {"html": DIVS}, "warn", W), ("semanticHtml", {"html": DIVS + "<main>"}, "pass", P), ("semanticHtml", {"html": "<span>" * 11}, "warn", W),
    ("keyboardNavigation", {}, "pass", P), ("keyboardNavigation", {"html": "<a tabindex=2 href=/>x</a>"}, "warn", W), ("keyboardNavigation", {"html": "<a disabled href=/>x</a>"}, "warn", W), ("keyboardNavigation", {"html": "<a tabindex=0 href=/>x</a>"}, "pass", P),
    ("focusIndicators", {}, "pass", P), ("focusIndicators", {"html": "<a style='outline: none' href=/>x</a>"}, "warn", W),
    ("googleAnalytics", {}, "warn", N), ("googleAnalytics", {"html": "<script>gtag('x')</script>"}, "pass", P), ("googleTagManager", {}, "warn", N), ("googleTagManager", {"html": "<noscript><iframe src=https://www.googletagmanager.com/ns></iframe></noscript>"}, "pass", P),
    ("facebookPixel", {}, "warn", N), ("facebookPixel", {"html": "<script>fbq('x')</script>"}, "pass", P),
    ("trackingConsent", {}, "pass", N), ("trackingConsent", {"html": "<script>fbq('x')</script>"}, "warn", W), ("trackingConsent", {"html": "<script>fbq('x')</script><div id=cookie-bar>"}, "pass", P),
    ("cacheControl", {}, "warn", W), ("cacheControl", h(cache_control="no-store"), "warn", W), ("cacheControl", h(cache_control="public"), "warn", W), ("cacheControl", h(cache_control="max-age=9"), "pass", P),
    ("etag", {}, "warn", W), ("etag", h(etag="x"), "pass", P), ("cdnUsage", {}, "warn", W), ("cdnUsage", h(server="Fastly"), "pass", P), ("cdnUsage", h(x_cache="HIT"), "pass", P),
    ("staticAssetCaching", {}, "pass", N), ("staticAssetCaching", {"url": "https://a.test/css/x"}, "warn", W), ("staticAssetCaching", {"url": "https://a.test/x.css", **h(cache_control="max-age=86399")}, "warn", W), ("staticAssetCaching", {"url": "https://a.test/x.css", **h(cache_control="max-age=86400")}, "pass", P),
]


def test_every_branch_of_every_rule(spark):
    rows = [(k, *page(**{"html": "<p>x</p>", **has})[1:]) for k, (_, has, _, _) in enumerate(BRANCHES)]
    told = checks.checks(report.with_inputs(spark.createDataFrame(rows, PAGE)))
    got = {(r.page_id, r.check): (r.status, signals(r)) for r in told.collect()}
    wrong = [(c, str(has)[:80], got[k, c], (s, g)) for k, (c, has, s, g) in enumerate(BRANCHES) if got[k, c] != (s, g)]
    assert not wrong
    assert {c for c, *_ in BRANCHES} | {"robotsTxtExists", "disallowAll", "sitemapReference", "links"} == {c for _, c in got}


def test_robots_txt(spark):
    site = lambda body: spark.createDataFrame([("https://a.test/robots.txt", 200, body), ("https://b.test/robots.txt", 200, "x")], "url string, status int, body string")
    got = lambda check, body: status(spark, check, "robots", page(), site=site(body))
    assert got("robotsTxtExists", "x") == ("pass", P) and got("robotsTxtExists", None) == ("warn", W)
    assert got("disallowAll", "Disallow: /a") == ("fail", X) and got("disallowAll", "x") == ("pass", P)
    assert got("sitemapReference", "SITEMAP: /s") == ("pass", P) and got("sitemapReference", "x") == ("warn", W)


def test_links_rule(spark):
    row = page("<a href=/x>1</a>")
    for code, want in ((404, ("warn", W)), (200, ("pass", P))):
        links = spark.createDataFrame([("https://a.test/x", code)], "url string, status int")
        assert status(spark, "links", "links", row, link_status=links) == want


@pytest.mark.parametrize("days,outcome,want", [(-1, "ok", "fail"), (0, "ok", "warn"), (29, "ok", "warn"), (30, "ok", "pass"), (99, "timeout", "warn"), (None, "ok", "fail")])
def test_certificate(spark, days, outcome, want):
    now = dt.datetime(2025, 1, 1)
    tls = spark.createDataFrame([("a.test", None if days is None else now + dt.timedelta(days=days), outcome)], "host string, valid_to timestamp, outcome string")
    assert status(spark, "sslCertificate", "security", page(), tls=tls, now=F.lit(now))[0] == want


def test_repeated_pages_count_once(spark):
    old, new = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    rows = [(*page("<title>old"), old, None), (*page("<title>new"), new, None), (*page("<title>new"), new, None)]
    df = report.with_inputs(spark.createDataFrame(rows, PAGE + ", fetched_at timestamp, loaded_at timestamp"))
    assert [r.value for r in checks.checks(df, ("meta",)).filter("check = 'title'").collect()] == ["new"]
    assert report.audit(df).count() == 1 and report.page_report(df).count() == 1


def test_html_is_read_once_and_never_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "SPREAD_BYTES", 0)  # as for large inputs
    path = str(tmp_path / "pages")
    spark.createDataFrame([page("<title>x"), page(None)], PAGE).write.parquet(path)
    plan = checks.checks(report.with_inputs(spark.read.parquet(path), names=checks.needs(("openGraph",))), ("openGraph",))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.count("FileScan") == 1
    after = [x for x in text.split("\n") if "Exchange" in x]
    assert len(after) == 1 and "html" not in text.split("MapInArrow")[0]


def test_broken_links(spark):
    links = spark.createDataFrame([("https://a.test/x", 404), ("https://a.test/y", 200)], "url string, status int")
    row = page("<a href='/x'>1</a><a href='/y'>2</a><a href='/z'>3</a><a href='#t'>4</a><a href='tel:1'>5</a>")
    r = report.with_inputs(spark.createDataFrame([row], PAGE), link_status=links).first()
    assert (r.total_links, r.internal_links, r.external_links) == (4, 3, 1)
    assert r.broken_links == 3  # 404, and two without an answer


def test_score_and_nulls(spark):
    rows = [page(None), (2, "https://a.test/", None, None, None, "", None, None), (3, "https://a.test/", None, None, None, "<h1>x" * 3, None, None)]
    out = {r.page_id: r for r in report.audit(report.with_inputs(spark.createDataFrame(rows, PAGE))).collect()}
    assert set(out) == {3} and 0 <= out[3].score <= 100
    reports = {r.page_id: r for r in report.page_report(report.with_inputs(spark.createDataFrame(rows, PAGE))).collect()}
    assert reports[1].status == "fail" and reports[3].issues[0] == "several h1"
    empty = spark.createDataFrame([], PAGE)
    assert report.audit(report.with_inputs(empty)).count() == 0


def test_structured_data(spark):
    cases = [([], (0, False, 0)), (['{"@type":"A","x":{"@type":["B","A"]}}'], (1, True, 0)), (["[]"], (1, False, 1)), (['"t"'], (1, False, 1)), (["{bad", '{"@type":"A"}'], (2, True, 1)), (['{"a":1}'], (1, True, 1))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s array<string>").select("i", report.json_ld_summary("s").alias("r")).orderBy("i").collect()
    assert [(r.r["count"], r.r["valid"], len(r.r["errors"])) for r in df] == [w for _, w in cases]
    assert df[1].r["types"] == ["A", "B"]


def test_unclosed_markup():
    f = dom.facts("<P>a<b>b</P><p>c<title>t</title><SCRIPT>var x='</p><h1>'</SCRIPT><h2>y")
    assert f["h2"] == 1 and f["h1_texts"] == [] and f["title"] == "t"


@pytest.mark.parametrize("unit", ["<b>x", "<h1>x", "<a>x", "<label><input>", "</i><b>", "navigate({", "='a", "<p><i>x"])
def test_hostile_markup_takes_linear_time(unit):
    began = time.process_time()
    dom.facts(unit * 20_000)
    dom.script_urls(unit * 20_000)
    assert time.process_time() - began < 4


def test_script_urls():
    body = """x={url:'/a', "path": "/b"}; location.href = '/c'; router.push('/d'); navigate({q: 1, to:'/e'}); f('/no'); let to='/no'; <Link to='/g'> replace("javascript:1") don't href='/k' """
    assert dom.script_urls(body) == ["/a", "/b", "/c", "/d", "/e", "/g", "/k"]


def test_json_body(spark):
    df = report.with_inputs(spark.createDataFrame([page("<title>x")], PAGE))
    body = json.loads(report.json_bodies(checks.checks(df, ("meta", "technical"))).first().body)
    assert body["success"] and len(body["checks"]) == 11 and body["checks"][0] == {"category": "meta", "check": "title", "status": "warn", "value": "x"}


def test_page_file_and_print(spark):
    links = spark.createDataFrame([("https://a.test/y", 200)], "url string, status int")
    df = report.with_inputs(spark.createDataFrame([page("<title>a, b</title><a href=/x>x</a><a href=/y>y</a>")], PAGE), link_status=links)
    rows, scores, broken = checks.checks(df), report.audit(df), report.broken_links(df, links)
    lines = [r.line for r in export.page_file(rows, scores, checks.latest(df.select("page_id", "fetched_at", "loaded_at", "total_links", "internal_links", "external_links")), broken).orderBy("line_no").collect()]
    assert lines[:3] == ["SEO Analysis Report", "URL,https://a.test/", f"Overall Score,{scores.first().score}/100"] and lines[6:9] == ["", "Summary", "Category,Status,Message,Value,Recommendation"]
    at = lines.index("Links - Total Links,info,Total links found,2,")
    assert lines[at + 3 : at + 5] == ["Links - Broken Links", "Broken Link,broken,https://a.test/x,Status: none,"] and lines[at + 5].startswith("Technical - httpsEnabled,pass,")
    assert lines[9].startswith('Meta Tags - title,warn,Title needs attention,"a, b",')
    shown = export.page_print(rows, scores, broken).orderBy("line_no").collect()
    assert shown[0].text == "SEO Analysis Report" and shown[-1].text == "    - https://a.test/x (none)"
    assert sum(r.style == "section" for r in shown) == 11
