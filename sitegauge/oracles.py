"""SQL for DuckDB that gives the same rows as the core's queries, written apart from them.

Where the Spark side parses html, this side reads the same html by regular expressions, which suffice for
the regular markup of the test tables; where SQL can't say it, a query has no entry.
"""

from __future__ import annotations

_ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&eacute;": "é", "&uuml;": "ü", "&agrave;": "à", "&ntilde;": "ñ", "&#x27;": "''", "&lt;": "<", "&gt;": ">", "&#123;": "{", "&#x7d;": "}", "&#91;": "[", "&amp;": "&"}


def _text(expr: str) -> str:
    for name, char in _ENTITIES.items():
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[\\s ]+|[\\s ]+$', '', 'g')"


_PF = """pf as (select page_id, any_value(url) url, coalesce(any_value(final_url), any_value(url)) final_url, any_value(html) html,
 any_value(headers) headers, any_value(status_code) status_code, coalesce(any_value(response_ms), 0) ms, coalesce(any_value(http_redirects), false) hop
 from page_fetch where page_id is not null group by page_id),
h as (select *, regexp_replace(html, '(?s)<!--.*?-->|(?i:<(?:script|style)\\b.*?</(?:script|style)\\s*>)', '', 'g') doc,
 regexp_replace(html, '(?s)<!--.*?-->', '', 'g') raw from pf where html <> '')"""


def _meta(name: str, attr: str = "name") -> str:
    return f"nullif({_text(f'''regexp_extract(doc, '(?is)<meta {attr}=\"{name}\" content=\"([^\"]*)\"', 1)''')}, '')"


def _header(name: str) -> str:
    return f"nullif(headers['{name}'][1], '')"


_TITLE = f"""nullif({_trim(_text('''regexp_extract(doc, '(?is)<title[^>]*>(.*?)</title>', 1)'''))}, '')"""
_H1 = r"len(regexp_extract_all(doc, '(?i)<h1[\s>]'))"


#: Signals by status, where a rule doesn't say otherwise.
_BY_STATUS = {"passed": "pass", "warnings": "warn", "failed": "fail"}


def _rows(rules: dict[str, tuple], source: str) -> str:
    """A row per page and rule; a rule is (status, value, kind) and may add the condition under which it adds no signal,
    or its three numbers of signals."""
    out = []
    for check, (status, value, kind, *more) in rules.items():
        quiet = more[0] if len(more) == 1 else "false"
        numbers = more if len(more) == 3 else [f"case when s = '{v}' and not coalesce(q, false) then 1 else 0 end" for v in _BY_STATUS.values()]
        told = ", ".join(f"({n})::int as {b}" for n, b in zip(numbers, _BY_STATUS, strict=True))
        out.append(f"""select page_id, '{check}' as "check", s as status, v as value, case when v is null then 'null' else '{kind}' end as value_kind, {told} from (select *, {status} as s, ({value})::varchar as v, {quiet} as q from {source})""")
    return " union all ".join(out)


def _checks(rules: dict[str, tuple], source: str = "h", more: str = "") -> str:
    return f"with {_PF}{more} {_rows(rules, source)}"


def _sized(e: str, low: int, high: int) -> str:
    # characters beyond U+FFFF count twice
    n = f"(length({e}) + length(regexp_replace({e}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    return f"case when {e} is null then 'fail' when {n} < {low} or {n} > {high} then 'warn' else 'pass' end"


def _there(e: str, missing: str = "warn") -> str:
    return f"case when {e} is null then '{missing}' else 'pass' end"


_CANON_LINK = r"nullif(regexp_extract(doc, '(?is)<link rel=\"canonical\" href=\"([^\"]*)\"', 1), '')".replace('\\"', '"')
_HOST = lambda c: f"lower(regexp_extract({c}, '^(?i:https?)://([^/?#]*)', 1))"
_PATH = lambda c: f"regexp_extract({c}, '^(?i:https?)://[^/?#]*([^?#]*)', 1)"


def _canonical(c: str, own: str | None = None) -> str:
    host = f"regexp_replace({_HOST(c)}, ':(80|443)?$', '')"
    if own:
        host = f"case when regexp_replace({host}, '^www\\.', '') = regexp_replace({_HOST(own)}, '^www\\.', '') then {_HOST(own)} else {host} end"
    path = f"regexp_replace(regexp_replace({_PATH(c)}, '/+', '/', 'g'), '/(index\\.(html?|php|aspx?|jsp|cgi)|default\\.(html?|php|aspx?))$', '/', 'i')"
    path = f"case when {path} in ('', '/') then '/' else regexp_replace({path}, '/$', '') end"
    return f"case when regexp_matches({c}, '^(?i:https?)://[^/?#]') then 'https://' || {host} || {path} end"


_R = "r as (select report_id, any_value(url) url, any_value(h1_count) h1_count, any_value(h1_texts) h1_texts, any_value(has_single_h1) has_single_h1, any_value(meta) meta, any_value(og) og, any_value(twitter) twitter, any_value(json_ld) json_ld, any_value(issues) issues, any_value(status) status from page_report group by report_id)"
_ISSUES = """list_filter([case when h1_count = 0 then 'missing h1' end, case when h1_count > 1 then 'several h1' end,
 case when coalesce(meta.title, '') = '' then 'missing title' end, case when coalesce(meta.description, '') = '' then 'missing description' end,
 case when contains(lower(coalesce(meta.robots, '')), 'noindex') then 'noindex' end, case when coalesce(meta.canonical, '') = '' then 'missing canonical' end,
 case when not coalesce(json_ld.present, false) then 'missing structured data' end,
 case when coalesce(json_ld.present, false) and not coalesce(json_ld.valid, false) then 'invalid structured data: ' || coalesce(array_to_string(json_ld.errors, ', '), '') end], lambda x: x is not null)"""
_CSV = lambda e: f"coalesce(case when regexp_matches({e}, '[,\"\\n]') then '\"' || replace({e}, '\"', '\"\"') || '\"' else {e} end, '')"
_LOCALE = [("en-au", "en-AU", "AU", "Australia"), ("en-gb", "en-GB", "GB", "United Kingdom")]


def _locale(i: int, default: str) -> str:
    return "case " + " ".join(f"when contains(lower(url), '{r[0]}') then '{r[i]}'" for r in _LOCALE) + f" else '{default}' end"


_LEVEL = """case when regexp_matches(message, '✓|Successfully|Found sitemap') then 'success' when contains(message, '⚠') or contains(lower(message), 'warning') then 'warning'
 when contains(message, '✗') or contains(lower(message), 'error') or contains(lower(message), 'failed') then 'error' else coalesce(lower(level), 'info') end"""
_CLEAN = _trim(r"regexp_replace(message, '\[(SitemapCrawler|Sitemap|SitemapDiscovery|API)\]\s*', '', 'g')")
_LIVE = "live as (select url, max(body) body from site_resources where status = 200 and body is not null group by url)"
_LINES = r"lines as (select lower(regexp_extract(url, '://([^/]*)', 1)) site_host, unnest(range(len(l))) as ordinal, trim(regexp_replace(unnest(l), '#.*$', '')) sitemap from (select url, regexp_extract_all(body, '(?i)sitemap:[ \t]*([^\r\n]+)', 1) l from live where url like '%/robots.txt'))"


_XML = r"""xl as (select url, max(body) body from site_resources where status = 200 and body is not null group by url), xm as (select url, regexp_replace(body, '<(/?)[A-Za-z_][A-Za-z0-9_.-]*:([A-Za-z])', '<\1\2', 'g') xml from xl),
 xb as (select url, regexp_extract_all(xml, '(?is)<sitemap(?:\s[^>]*)?>(.*?)</sitemap\s*>', 1) si, regexp_extract_all(xml, '(?is)<url(?:\s[^>]*)?>(.*?)</url\s*>', 1) pu, regexp_extract_all(xml, '(?is)<loc(?:\s[^>]*)?>\s*(https?://.*?)\s*</loc', 1) anyl from xm where regexp_matches(xml, '(?i)<(urlset|sitemapindex|loc)[\s>]')),
 xt as (select url, list_filter(list_transform(si, lambda b: replace(trim(regexp_extract(b, '(?is)<loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc', 1)), '&amp;', '&')), lambda x: x <> '') si, list_filter(list_transform(pu, lambda b: replace(trim(regexp_extract(b, '(?is)<loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc', 1)), '&amp;', '&')), lambda x: x <> '') pu, anyl from xb),
 xc as (select url, len(si) > 0 is_index, case when len(si) > 0 then si when len(pu) > 0 then pu else anyl end l from xt), sm as (select url, is_index, unnest(l) loc, unnest(range(len(l)))::bigint as position from xc)"""
_EXPAND = f"""{_LIVE}, {_LINES}, ok as (select distinct url from site_resources where status = 200), kn as (select {_HOST('url')} site_host,
 list_position(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemaps.xml', '/sitemap1.xml', '/sitemap/sitemap.xml'], {_PATH('url')}) as rank, url sitemap from ok),
 bs as (select * from kn where rank > 0 union all select site_host, ordinal + 7, sitemap from lines where sitemap in (select url from ok)), rt as (select 'https://' || site_host || '/' as base, arg_min(sitemap, rank) sitemap from bs group by site_host),
 wk as (select base, sitemap, [sitemap] path, is_index, loc, '/' || lpad(position::varchar, 8, '0') place, 0 as depth from rt join sm on sm.url = sitemap
 union all select w.base, w.loc, list_append(w.path, w.loc), sm.is_index, sm.loc, w.place || '/' || lpad(sm.position::varchar, 8, '0'), w.depth + 1 from wk w join sm on sm.url = w.loc where w.is_index and not list_contains(w.path, w.loc) and w.depth < 10),
 ex as (select base, sitemap, loc, place as position from wk where not is_index)"""
_ALIVE = f"""alive as (select distinct {_canonical('url')} url from page_fetch where (contains(lower(coalesce(headers['content-type'][1], '')), 'text/html') or contains(lower(coalesce(headers['content-type'][1], '')), 'application/xhtml') or coalesce(starts_with(ltrim(html), '<'), false)) and coalesce(status_code, 200) < 500)"""


_NESTED = r"""with recursive src as (select distinct report_id, d.index as script_index, trim(regexp_replace(d.content, '(?s)<!--.*?-->', '', 'g'), chr(65279) || chr(32) || chr(9) || chr(10) || chr(13)) c from (select report_id, unnest(json_ld.data) d from page_report where report_id is not null) where d.content is not null),
 v as (select *, row_number() over () rid from src where json_valid(c) and not regexp_matches(regexp_replace(c, '"(?:[^"\\]|\\.)*"', '0', 'g'), ',\s*[}\]]')),
 t as materialized (select v.rid, report_id, script_index, j.id, j.parent, j.type, j.key from v, json_tree(v.c) j where j.type in ('OBJECT', 'ARRAY')),
 w as (select rid, report_id, script_index, id, type, '$' as node_path, '' as parent_path, '$' as schema_path from t where parent is null union all
 select t.rid, t.report_id, t.script_index, t.id, t.type, w.node_path || '/' || t.key, case when w.type = 'OBJECT' then w.node_path else w.parent_path end, w.schema_path || '/' || case when w.type = 'ARRAY' then '*' else t.key end from w join t on t.rid = w.rid and t.parent = w.id)"""
_MEMBERS = _NESTED.split(" t as materialized")[0] + r""" t as materialized (select v.rid, report_id, script_index, j.id, j.parent, j.type, j.key, case when j.type = 'VARCHAR' then j.atom->>'$' when j.type = 'NULL' then null else j.atom::varchar end as value,
 (row_number() over (partition by v.rid, j.parent order by j.id) - 1)::varchar as ord from v, json_tree(v.c) j),
 m as (select rid, report_id, script_index, id, type, value, '$' as leaf, '$' as sp, '' as obj, '' as osp, null::varchar as key, '' as pos from t where parent is null union all
 select t.rid, t.report_id, t.script_index, t.id, t.type, t.value, m.leaf || case when m.type = 'OBJECT' then '.k' else '.e' end || t.ord, m.sp || '/' || case when m.type = 'ARRAY' then '*' else t.key end,
 case when m.type = 'OBJECT' then m.leaf else m.obj end, case when m.type = 'OBJECT' then m.sp else m.osp end, case when m.type = 'OBJECT' then t.key else m.key end, case when m.type = 'OBJECT' then '' when m.pos = '' then t.ord else m.pos || '.' || t.ord end from m join t on t.rid = m.rid and t.parent = m.id)"""
_DEPTHS = 24


def _crawl(browser: bool = False) -> str:
    """A crawl, depth by depth, as common table expressions; ``_DEPTHS`` are more than the test tables have."""
    bare = lambda u: f"regexp_replace({_HOST(u)}, '^www\\.', '')"
    skipped = "'\\.(pdf|jpe?g|png|gif|svg|webp|ico|zip|exe|dmg|css|js|json|xml|txt|mp4|mp3|avi|mov|wmv|flv|webm|woff2?|ttf|eot|otf)$'"
    crawls = lambda u, base: f"coalesce({bare(u)} = {bare(base)} and not regexp_matches(lower({_PATH(_canonical(u, base))}), {skipped}), false)"
    if browser:
        seeds = "select * from lo where position <= 200 union all select site, url, 3.5 from ro where (site, url) not in (select site, url from lo where position <= 200)"
        shown = f"select distinct {_canonical('url')} url from page_fetch where coalesce(status_code, 200) < 400 and contains(lower(coalesce(headers['content-type'][1], '')), 'html')"
        answers = f"{shown} union select url from alive where {bare('url')} not in (select {bare('url')} from ({shown}))"
        unfollowed = "select site from lo where position = 10"
    else:
        seeds = """select * from lo where position <= 200 union all select site, url, 0 from ro where site not in (select site from lo where position = 200)
 and (site, url) not in (select site, url from lo where position <= 200)"""
        answers, unfollowed = "select url from alive", "''"
    out = f"""with recursive {_XML}, {_EXPAND}, {_ALIVE}, ro as materialized (select {bare('url')} site, min(url) url from alive group by 1),
 lr as (select ro.site, loc, ro.url root, position from ex join ro on ro.site = {bare('base')}), li as (select site, {_canonical('loc', 'root')} url, min(position) p from lr where {crawls('loc', 'root')} group by 1, 2),
 lo as materialized (select site, url, row_number() over (partition by site order by p, url) position from li), sd as ({seeds}), ans as materialized ({answers}),
 edges as materialized (select {bare('src')} site, {_canonical('src')} as src, {_canonical('dst', 'src')} dst, min(ordinal) ordinal from link_graph where {crawls('dst', 'src')} and {bare('src')} not in ({unfollowed}) group by 1, 2, 3),
 f0 as materialized (select * from (select site, url, 0 as depth, row_number() over (partition by site order by position, url) as position from sd where url in (select url from ans)) where position <= 200), s0 as (select * from f0)"""
    for k in range(1, _DEPTHS):
        out += f""", n{k} as (select f.site, e.dst url, min({{'b': f.position, 'o': e.ordinal}}) place from f{k - 1} f join edges e on e.site = f.site and e.src = f.url group by 1, 2),
 r{k} as (select site, url, row_number() over (partition by site order by place, url) as rank from n{k} where url in (select url from ans) and (site, url) not in (select site, url from s{k - 1})),
 f{k} as materialized (select r.site, url, {k} as depth, rank + taken as position from r{k} r join (select site, count(*) taken from s{k - 1} group by 1) t on t.site = r.site where rank + taken <= 200),
 s{k} as materialized (select * from s{k - 1} union all select * from f{k})"""
    return out + f", seen as (select * from s{_DEPTHS - 1})"


_CRAWL = _crawl()


def sql() -> dict[str, str]:
    noindex = f"contains(lower({_meta('robots')}), 'noindex')"
    img = r"len(regexp_extract_all(doc, '(?i)<img\s'))"
    modern = r"len(regexp_extract_all(doc, '(?i)<img src=\"[^\"]*\.(?:webp|avif)'))".replace('\\"', '"')
    lazy = r"len(regexp_extract_all(doc, '(?i)<img[^>]* loading=\"lazy\"'))".replace('\\"', '"')
    scripts = r"regexp_extract_all(raw, '(?is)<script([^>]*)>', 1)"
    blocking = f"len(list_filter({scripts}, lambda x: contains(x, 'src=') and not contains(x, 'async') and not contains(x, 'defer')))"
    styles = r"len(regexp_extract_all(doc, '(?i)<link rel=\"stylesheet\"'))".replace('\\"', '"')
    body = r"array_to_string(regexp_extract_all(raw, '(?is)<script[^>]*>.*?</script'), ' ')"
    https = "final_url like 'https://%'"
    csp, frame, sniff, hsts = map(_header, ("content-security-policy", "x-frame-options", "x-content-type-options", "strict-transport-security"))
    cc, cookies = _header("cache-control"), "list_filter(coalesce(headers['set-cookie'], []), lambda c: c <> '')"
    levels = r"regexp_extract_all(doc, '(?i)<h([1-6])[\s>]', 1)"
    jumps = f"(len(list_filter(range(2, len({levels}) + 1), lambda i: {levels}[i]::int > {levels}[i - 1]::int + 1)) + case when {_H1} > 1 then 1 else 0 end)"
    alt_missing = r"len(list_filter(regexp_extract_all(doc, '(?i)<img\s[^>]*>'), lambda x: not regexp_matches(x, ' alt=')))"
    alt_empty = r"len(regexp_extract_all(doc, '(?i)<img\s[^>]* alt=\"\s*\"'))".replace('\\"', '"')
    title, desc = _sized(_TITLE, 30, 60), _sized(_meta("description"), 120, 160)
    href = r"regexp_extract_all(doc, '(?i)<a\s[^>]*href=\"([^\"]*)\"', 1)".replace('\\"', '"')
    resolved = "case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when href like '/%' then regexp_extract(final_url, '^((?i:https?)://[^/?#]*)', 1) || href end"
    links = f"links as (select page_id, final_url, unnest({href}) href, unnest(range(len({href}))) pos from h), l as (select page_id, row_number() over (partition by page_id order by pos) ordinal, href, {resolved} link, case when {_HOST(resolved)} = {_HOST('final_url')} then 'internal' else 'external' end kind from links where href <> '' and not regexp_matches(href, '^(#|javascript:|mailto:)'))"
    slice_t = f"({title})"
    charset = """nullif(coalesce(nullif(regexp_extract(doc, '(?i)<meta charset="([^"]*)"', 1), ''), regexp_extract(doc, '(?i)<meta http-equiv="content-type" content="([^"]*)"', 1)), '')"""
    src = """regexp_extract_all(raw, '(?i)<script[^>]* src="([^"]*)"', 1)"""
    third = f"list_distinct(list_filter(list_transform({src}, lambda u: {_HOST('u')}), lambda n: n <> '' and n <> {_HOST('final_url')} and not contains(n, regexp_replace({_HOST('final_url')}, '^(.*?)www\\.', '\\1'))))"
    link_tags = "regexp_extract_all(doc, '(?i)<link [^>]*>')"
    fonts = f"len(list_filter({link_tags}, lambda t: (regexp_matches(t, '(?i)rel=\"stylesheet\"') and regexp_matches(t, 'href=\"[^\"]*font')) or contains(t, 'googleapis.com/fonts') or contains(t, 'fonts.googleapis.com')))".replace('\\"', '"')
    swapped = "(len(list_filter(regexp_extract_all(raw, '(?is)<style[^>]*>.*?</style'), lambda t: contains(t, 'font-display'))) > 0 or len(list_filter(" + link_tags + ", lambda t: contains(t, 'font-display') and contains(t, 'stylesheet'))) > 0)"
    sheets = f"len(list_filter({link_tags}, lambda t: regexp_matches(t, '(?i)rel=\"stylesheet\"') and not regexp_matches(t, '(?i)media=\"print\"')))".replace('\\"', '"')
    mixed = """(len(regexp_extract_all(doc, '(?i)<(?:img|iframe)[^>]* src="http://')) + len(regexp_extract_all(raw, '(?i)<script[^>]* src="http://')) + len(regexp_extract_all(doc, '(?i)<link rel="stylesheet" href="http://')))"""
    tags = lambda names: f"regexp_extract_all(doc, '(?i)<(?:{names})(?:\\s[^>]*)?>')"
    bare_doc = "regexp_replace(doc, '(?is)<label\\b.*?</label>', '', 'g')"
    controls = f"len({tags('input|textarea|select')})"
    named_for = """list_transform(regexp_extract_all(doc, '(?i)<label[^>]* for="([^"]+)"', 1), lambda x: x)"""
    unlabelled = f"len(list_filter({tags('input|textarea|select').replace('(doc', '(' + bare_doc)}, lambda t: not regexp_matches(t, '(?i)type=.?hidden') and not regexp_matches(t, '(?i)aria-label(ledby)?=\"[^\"]') and not coalesce(list_contains({named_for}, nullif(regexp_extract(t, ' id=\"([^\"]+)\"', 1), '')), false)))".replace('\\"', '"')
    aria = (
        f"(len(list_filter({tags('[a-z][a-z0-9-]*')}, lambda t: contains(t, 'aria-required=\"true\"') and not regexp_matches(t, '\\srequired')))"
        f" + len(list_filter({tags('[a-z][a-z0-9-]*')}, lambda t: contains(t, 'aria-hidden=\"true\"') and regexp_matches(t, '(?i)^<(a|button|input|select|textarea)[\\s>]|tabindex')))"
        " + len(list_filter(regexp_extract_all(doc, '(?is)<(?:button[^>]*|a(?:\\s+[^>]*)?)>.*?</(?:button|a)'), lambda t: not regexp_matches(t, '(?i)^<a\\s[^>]*href') and not regexp_matches(t, '(?i)^<[^>]*aria-label') and trim(regexp_replace(regexp_replace(t, '</(?i:button|a)$', ''), '<[^>]*>', '', 'g')) = '')))"
    ).replace('\\"', '"')
    semantic, divs, spans = (f"len({tags(n)})" for n in ("nav|main|article|section|aside|header|footer|figure|figcaption", "div", "span"))
    keyboard = f"(len(list_filter({tags('[a-z][a-z0-9-]*')}, lambda t: regexp_matches(t, 'tabindex=.?\\+?0*[1-9]'))) + len(list_filter({tags('[a-z][a-z0-9-]*')}, lambda t: regexp_matches(t, '\\sdisabled') and (regexp_matches(t, '(?i)^<a\\s') or contains(t, 'tabindex')))))"
    outline = f"len(list_filter({tags('[a-z][a-z0-9-]*')}, lambda t: regexp_matches(t, 'style=\"[^\"]*(outline: none|outline:0)')))".replace('\\"', '"')
    asset = f"regexp_matches(lower({_PATH('final_url')}), '/(static|assets|css|js|images|img)/|\\.(css|js|jpg|jpeg|png|gif|svg|woff|woff2|ttf|eot|ico)$')"
    age = f"coalesce(try_cast(regexp_extract({cc}, 'max-age=(\\d+)', 1) as bigint), 0)"
    cents = "((200 * strlen(html)::bigint + 1048576) // 2097152)"
    images_quiet = f"{img} = 0"
    ga = f"(regexp_matches({body}, 'ga\\(|gtag\\(|GoogleAnalyticsObject') or len(list_filter({src}, lambda u: contains(u, 'googletagmanager.com/gtag') or contains(u, 'google-analytics.com'))) > 0)"
    gtm = f"(regexp_matches({body}, 'dataLayer|GTM-') or len(list_filter({src}, lambda u: contains(u, 'googletagmanager.com/gtm.js'))) > 0)"
    pixel = f"regexp_matches({body}, 'fbq\\(|facebook.net')"
    tracks = f"regexp_matches({body}, 'google-analytics|googletagmanager|facebook.net|gtag\\(|fbq\\(|dataLayer')"
    consent = f"""(regexp_matches(doc, '(?i)(class|id)="[^"]*(cookie|consent|gdpr|privacy)') or len(list_filter(regexp_extract_all(raw, '(?is)<script[^>]*>(.*?)</script', 1), lambda t: contains(t, 'cookie') and regexp_matches(t, 'consent|accept'))) > 0)"""
    cdn = f"(regexp_matches(lower(coalesce({_header('server')}, '')), 'cloudflare|cloudfront|fastly|keycdn|cdn|akamai') or regexp_matches(lower(coalesce({_header('via')}, '')), 'cloudflare|cloudfront|fastly|keycdn|cdn|akamai') or {_header('x-cdn')} is not null or {_header('x-cache')} is not null)"
    policy = f"coalesce({_header('permissions-policy')}, {_header('feature-policy')})"
    there = lambda v, missing="warn": (_there(v, missing), v, "string")
    flag = lambda bad, worse, v: (f"case when {bad} then '{worse}' else 'pass' end", v, "boolean")
    site = f"(select h.*, robots is not null there, coalesce(contains(lower(robots), 'disallow: /'), false) closed, coalesce(contains(lower(robots), 'sitemap:'), false) named from h left join (select {_HOST('url')} site, min(lower(body)) robots from site_resources where status = 200 and body is not null and url like '%/robots.txt' group by 1) on site = {_HOST('final_url')})"
    live = "dead as (select l.page_id, l.ordinal, l.link, f.status from l left join (select url, max(status_code) status from page_fetch where url is not null group by 1) f on f.url = l.link where l.ordinal <= 20 and (f.status is null or f.status >= 400))"
    broken = "hb as (select h.*, coalesce(n, 0) broken from h left join (select page_id, count(*) n from dead group by 1) d using (page_id))"
    #: (name of the category, its rules, where they read from), in order.
    rules = {
        "meta": ("meta", {"title": (title, _TITLE, "string"), "description": (desc, _meta("description"), "string"), "robots": (f"case when {_meta('robots')} is null then 'warn' when {noindex} then 'fail' else 'pass' end", _meta("robots"), "string"), "canonical": there(_CANON_LINK)}, ()),
        "og": ("openGraph", {f"og:{x}": there(_meta(f"og:{x}", "property")) for x in ("title", "description", "image", "url", "type")}, ()),
        "twitter": ("twitter", {"twitter:card": (f"case when {_meta('twitter:card')} in ('summary', 'summary_large_image') then 'pass' else 'warn' end", _meta("twitter:card"), "string")} | {f"twitter:{x}": there(_meta(f"twitter:{x}")) for x in ("title", "description", "image")}, ()),
        "robots": ("robots", {"robotsTxtExists": flag("not there", "warn", "there"), "disallowAll": flag("closed", "fail", "closed"), "sitemapReference": flag("not named", "warn", "named"), "noindexMeta": flag(f"coalesce({noindex}, false)", "fail", f"coalesce({noindex}, false)")}, (site,)),
        "links": ("links", {"links": ("case when broken > 0 then 'warn' else 'pass' end", "broken", "number")}, ("hb", f", {links}, {live}, {broken}")),
        "technical": ("technical", {
            "httpsEnabled": flag(f"not {https}", "fail", https), "httpRedirect": flag("hop", "warn", "hop"), "statusCode": ("case when status_code = 200 then 'pass' else 'fail' end", "status_code", "number"),
            "viewport": there(_meta("viewport"), "fail"), "charset": there(charset, "fail"), "h1Count": (f"case when {_H1} = 0 then 'fail' else 'pass' end", _H1, "number"), "multipleH1": flag(f"{_H1} > 1", "warn", f"{_H1} > 1")}, ()),
        "performance": ("performance", {
            "pageLoadTime": ("case when ms = 0 then 'warn' when ms > 3000 then 'fail' when ms > 2000 then 'warn' else 'pass' end", "ms", "number", "ms = 0"), "ttfb": ("case when ms = 0 then 'warn' when ms > 800 then 'fail' when ms > 600 then 'warn' else 'pass' end", "ms", "number", "ms = 0"),
            "domContentLoaded": ("case when ms > 2000 then 'warn' else 'pass' end", "ms", "number"),
            "totalPageSize": ("case when strlen(html) > 5242880 then 'fail' when strlen(html) > 3145728 then 'warn' else 'pass' end", f"({cents} // 100)::varchar || '.' || lpad(({cents} % 100)::varchar, 2, '0')", "number"),
            "imageOptimization": (f"case when {img} > 0 and 2 * {modern} < {img} and 2 * {lazy} < {img} then 'warn' else 'pass' end", img, "number", images_quiet),
            "renderBlockingResources": (f"case when {blocking} > 3 or {sheets} > 3 then 'warn' else 'pass' end", f"{blocking} + {sheets}", "number"),
            "fontLoading": (f"case when {fonts} > 0 and not {swapped} then 'warn' else 'pass' end", fonts, "number"), "thirdPartyScripts": (f"case when len({third}) > 5 then 'warn' else 'pass' end", f"len({third})", "number")}, ()),
        "security": ("security", {
            "contentSecurityPolicy": (f"case when {csp} is null or contains({csp}, 'unsafe-inline') or contains({csp}, 'unsafe-eval') then 'warn' else 'pass' end", csp, "string"),
            "xFrameOptions": (f"case when upper({frame}) in ('DENY', 'SAMEORIGIN') then 'pass' else 'warn' end", frame, "string"), "xContentTypeOptions": (f"case when lower({sniff}) = 'nosniff' then 'pass' else 'warn' end", sniff, "string"),
            "strictTransportSecurity": (f"case when not {https} then 'warn' when contains({hsts}, 'max-age') then 'pass' else 'warn' end", hsts, "string", f"not {https}"), "referrerPolicy": there(_header("referrer-policy")), "permissionsPolicy": there(policy),
            "sslCertificate": (f"case when not {https} then 'fail' else 'warn' end", "null", "number", f"not {https}"),
            "mixedContent": (f"case when not {https} then 'warn' when {mixed} > 0 then 'fail' else 'pass' end", mixed, "number", f"not {https}"),
            "cookieSecurity": (f"case when len({cookies}) = 0 then 'warn' when len(list_filter({cookies}, lambda c: not (contains(lower(c), 'secure') and contains(lower(c), 'httponly') and contains(lower(c), 'samesite')))) > 0 then 'warn' else 'pass' end", f"len({cookies})", "number", f"len({cookies}) = 0")}, ()),
        "accessibility": ("accessibility", {
            "altText": (f"case when {img} > 0 and {alt_missing} + {alt_empty} = 0 then 'pass' when {alt_missing} > 0 then 'fail' else 'warn' end", img, "number", f"case when {img} > 0 and {alt_missing} + {alt_empty} = 0 then 1 else 0 end", f"case when {alt_empty} > 0 then 1 else 0 end", f"case when {alt_missing} > 0 then 1 else 0 end"),
            "formLabels": (f"case when {unlabelled} > 0 then 'warn' else 'pass' end", unlabelled, "number", f"{controls} = 0"), "ariaAttributes": (f"case when {aria} > 0 then 'warn' else 'pass' end", aria, "number"),
            "headingHierarchy": (f"case when {jumps} > 0 then 'warn' when len({levels}) > 0 then 'pass' else 'warn' end", jumps, "number", f"{jumps} = 0 and len({levels}) = 0"),
            "semanticHtml": (f"case when {semantic} = 0 and ({divs} > 10 or {spans} > 10) then 'warn' else 'pass' end", semantic, "number"), "keyboardNavigation": (f"case when {keyboard} > 0 then 'warn' else 'pass' end", keyboard, "number"), "focusIndicators": (f"case when {outline} > 0 then 'warn' else 'pass' end", outline, "number")}, ()),
        "analytics": ("analytics", {
            "googleAnalytics": (f"case when {ga} then 'pass' else 'warn' end", ga, "boolean", f"not {ga}"), "googleTagManager": (f"case when {gtm} then 'pass' else 'warn' end", gtm, "boolean", f"not {gtm}"), "facebookPixel": (f"case when {pixel} then 'pass' else 'warn' end", pixel, "boolean", f"not {pixel}"),
            "trackingConsent": (f"case when not {tracks} then 'pass' when {consent} then 'pass' else 'warn' end", consent, "boolean", f"not {tracks}")}, ()),
        "caching": ("caching", {
            "cacheControl": (f"case when {cc} is null or contains({cc}, 'no-cache') or contains({cc}, 'no-store') or not contains({cc}, 'max-age') then 'warn' else 'pass' end", cc, "string"), "etag": there(_header("etag")),
            "cdnUsage": flag(f"not {cdn}", "warn", cdn), "staticAssetCaching": (f"case when not {asset} then 'pass' when {cc} is null or {age} < 86400 then 'warn' else 'pass' end", cc, "string", f"not {asset}")}, ()),
    }
    # an audit without liveness data finds no link broken
    silent = {"links": ("'pass'", "0", "number")}
    parts, start = [], 0
    for n, (category, r, where) in rules.items():
        r, where = (silent, ()) if n == "links" else (r, where)
        for k, (check, rule) in enumerate(r.items()):
            parts.append(f"select *, '{category}' as category, {start + k} as ordinal from ({_rows({check: rule}, *(where[:1] or ('h',)))})")
        start += len(r)
    every = f"with {_PF}, {links}, c as materialized ({' union all '.join(parts)})"
    words = """trim(regexp_replace("check", '([A-Z])', ' \\1', 'g'))"""
    title_case = f"""array_to_string(list_transform(string_split({words}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"""
    label = "case category when 'meta' then 'Meta Tags' when 'openGraph' then 'Open Graph' else upper(category[1]) || category[2:] end"
    said = f"{title_case} || case status when 'pass' then ' is fine' when 'warn' then ' needs attention' else ' fails' end"
    advice = f"case when status <> 'pass' then 'Review ' || lower({words}) end"
    csv = f"""select page_id, ordinal, {label} || ' - ' || "check" || ',' || status || ',' || {_CSV(said)} || ',' || {_CSV('value')} || ',' || {_CSV(advice)} as line from c"""
    csv_at = f"csv as ({csv})"
    csv_lines = (
        f"""select report_id, concat_ws(',', {_CSV('url')}, coalesce(status, ''), coalesce(h1_count::varchar, ''), {_CSV("array_to_string(h1_texts, '; ')")}, """
        + ", ".join(_CSV(c) for c in ("meta.title", "meta.description", "meta.canonical", "og.title", "og.description", "og.image", "twitter.card"))
        + f""", case when json_ld.present then 'Yes' else 'No' end, case when json_ld.valid then 'Yes' else 'No' end, {_CSV("array_to_string(issues, '; ')")}) line from r"""
    )
    skipped = "'\\.(pdf|jpe?g|png|gif|svg|webp|ico|zip|exe|dmg|css|js|json|xml|txt|mp4|mp3|avi|mov|wmv|flv|webm|woff2?|ttf|eot|otf)$'"
    crawls = lambda u, base: f"coalesce(regexp_replace({_HOST(u)}, '^www\\.', '') = regexp_replace({_HOST(base)}, '^www\\.', '') and not regexp_matches(lower({_PATH(_canonical(u, base))}), {skipped}), false)"
    crawlable = f"select src, dst, {crawls('dst', 'src')} crawlable from (select distinct src, dst from link_graph)"
    rel = """list_filter(regexp_extract_all(doc, '(?i)<link [^>]*>'), lambda t: regexp_matches(t, '(?i)rel="(canonical|alternate|next|prev)"') and regexp_matches(t, 'href="[^"]'))"""
    full = "case when regexp_matches(trim(raw), '^[A-Za-z][A-Za-z0-9+.-]*:') then trim(raw) when trim(raw) like '//%' then regexp_extract(final_url, '^((?i:https?):)', 1) || trim(raw) when trim(raw) like '/%' then regexp_extract(final_url, '^((?i:https?)://[^/?#]*)', 1) || trim(raw) end"
    sets = (
        f"s0 as (select page_id, final_url, unnest(list_transform({href}, lambda x: {{'k': 'a', 'u': x}}) || list_transform({rel}, lambda t: {{'k': 'link', 'u': regexp_extract(t, 'href=\"([^\"]*)\"', 1)}})) x,"
        f" unnest(range(len({href}) + len({rel}))) as pos from h), s1 as (select page_id, final_url, pos, x.k kind, x.u raw from s0 where trim(x.u) <> ''), s2 as (select *, {full} resolved from s1), s3 as (select *, {_canonical('resolved', 'final_url')} canonical from s2 where {crawls('resolved', 'final_url')}),"
        " s4 as (select page_id, canonical, min(pos) pos, arg_min(kind, pos) kind, arg_min(raw, pos) raw, arg_min(resolved, pos) resolved from s3 group by 1, 2), ls as (select page_id, row_number() over (partition by page_id order by pos) ordinal, kind, raw, resolved, canonical from s4)"
    )
    falsy = """('null', '""', '[]', '{}', '0', 'false')"""
    rep = (
        r"""sc as (select page_id, unnest(regexp_extract_all(raw, '(?is)<script([^>]*)>.*?</script', 1)) attrs, unnest(regexp_extract_all(raw, '(?is)<script[^>]*>(.*?)</script', 1)) body, unnest(range(len(regexp_extract_all(raw, '(?is)<script([^>]*)>.*?</script', 1)))) pos from h),
 ld as materialized (select page_id, body c, row_number() over (partition by page_id order by pos) n, row_number() over () rid, json_valid(body) and not regexp_matches(regexp_replace(body, '"(?:[^"\\]|\\.)*"', '0', 'g'), ',\s*[}\]]') ok from sc
 where trim(body, chr(32) || chr(10) || chr(13) || chr(9)) <> '' and (regexp_matches(attrs, '(?i)type="[^"]*application/ld\+json') or (regexp_matches(body, '^\s*[{\[]') and regexp_matches(body, '@context|@type')))),"""
        f""" le as (select *, case when not ok then 'invalid JSON' when json_type(c) not in ('OBJECT', 'ARRAY') then 'no object or array' when json_type(c) = 'ARRAY' and json_array_length(c) = 0 then 'empty array'
 when len(list_filter(case when json_type(c) = 'ARRAY' then json_extract(c, '$[*]."@context"') || json_extract(c, '$[*]."@type"') else [json_extract(c, '$."@context"'), json_extract(c, '$."@type"')] end, lambda x: x is not null and x::varchar not in {falsy})) = 0 then 'neither context nor type' end e from ld),
 jt as materialized (select page_id, ld.n, ld.rid, j.id, j.parent, j.type, j.key, j.atom from ld, json_tree(ld.c) j where ld.ok), ty as (select a.page_id, a.n, a.parent oid, a.id eid, a.atom->>'$' t from jt a where a.key = '@type' and a.type = 'VARCHAR'
 union all select a.page_id, a.n, b.parent, a.id, a.atom->>'$' from jt a join jt b on a.rid = b.rid and a.parent = b.id where b.key = '@type' and b.type = 'ARRAY' and a.type = 'VARCHAR'),
 tf as (select page_id, t, min({{'n': n, 'o': oid, 'e': eid}}) first from ty group by 1, 2), tt as (select page_id, string_agg(t, ',' order by first) types from tf group by 1),
 lp as (select page_id, count(*)::int cnt, count(*) filter (e in ('invalid JSON', 'no object or array', 'empty array')) = 0 or count(e) < count(*) valid, coalesce(list('JSON-LD ' || n || ': ' || e order by n) filter (e is not null), []) errs from le group by 1),
 rp as (select pf.page_id, pf.url, coalesce({_H1}, 0)::int h1_count, coalesce({_H1}, 0) = 1 has_single_h1, {_TITLE} title, {_meta('description')} description, {_CANON_LINK} canonical, coalesce(valid, false) json_ld_valid, coalesce(cnt, 0) cnt, coalesce(errs, []) errs, coalesce(contains(lower({_meta('robots')}), 'noindex'), false) ni from pf left join h using (page_id) left join lp using (page_id)),
 ri as (select *, list_filter([case when h1_count = 0 then 'missing h1' end, case when h1_count > 1 then 'several h1' end, case when title is null then 'missing title' end, case when description is null then 'missing description' end, case when ni then 'noindex' end, case when canonical is null then 'missing canonical' end,
 case when cnt = 0 then 'missing structured data' end, case when cnt > 0 and not json_ld_valid then 'invalid structured data: ' || array_to_string(errs, ', ') end], lambda x: x is not null) iss from rp),
 rs as (select *, case when len(iss) = 0 then 'pass' when len(iss) <= 2 then 'warn' else 'fail' end status from ri)"""
    )
    out = {
        "score_slice": f"""with {_PF}, s as (select page_id, {slice_t} t, {https} ok, {_H1} n from h), c as (select page_id,
 (t = 'pass')::int + ok::int + (n > 0)::int + (n <= 1)::int p, (t = 'warn')::int + (n > 1)::int w, (t = 'fail')::int + (not ok)::int + (n = 0)::int x from s)
 select page_id, ((200 * p + 100 * w + (p + w + x)) // (2 * (p + w + x)))::int as score from c""",
        **{f"{name}_checks": _checks(r, *src) for name, (_, r, src) in rules.items() if name != "links"},
        "links_check": _checks(rules["links"][1], *rules["links"][2]),
        "link_liveness": f"with {_PF}, {links}, {live} select page_id, ordinal, link, status from dead",
        "tls_check": _checks({"sslCertificate": (
            f"case when not {https} then 'fail' when o <> 'ok' or o is null then 'warn' when days < 0 then 'fail' when days < 30 then 'warn' else 'pass' end", "days", "number", f"not {https}")},
            "c", f", c as (select h.*, length({_HOST('final_url')}) * 7 % 60 - 15 as days, case when length({_HOST('final_url')}) % 11 = 0 then 'timeout' when length({_HOST('final_url')}) % 13 = 0 then 'error' else 'ok' end as o from h)"),
        "score_page": f"{every}, t as (select page_id, sum(passed)::int p, sum(warnings)::int w, sum(failed)::int x from c group by 1), s as (select *, ((200 * p + 100 * w + (p + w + x)) // (2 * (p + w + x)))::int as score from t)"
        " select page_id, url, p as passed, w as warnings, x as failed, score, case when score >= 80 then 'green' when score >= 60 then 'yellow' else 'red' end as band from s join pf using (page_id)",
        "category_pivot": f"{every} select category, count(*) filter (status = 'pass') as pass, count(*) filter (status = 'warn') as warn, count(*) filter (status = 'fail') as fail from c group by 1",
        "page_json": f"""{every}, t as (select page_id, sum(passed)::bigint passed, sum(warnings)::bigint warnings, sum(failed)::bigint failed, list({{'category': category, 'check': "check", 'status': status, 'value': value}} order by ordinal) checks from c group by 1)
 select page_id, to_json({{'success': true, 'page_id': page_id, 'score': ((200 * passed + 100 * warnings + (passed + warnings + failed)) // (2 * (passed + warnings + failed)))::int, 'passed': passed, 'warnings': warnings, 'failed': failed, 'checks': checks}})::varchar as body from t""",
        "page_csv_lines": f"{every} select page_id, ordinal::bigint ordinal, line from ({csv})",
        "page_csv": f"""{every}, {csv_at}, {live}, n as (select h.page_id, url, count(l.page_id) total, count(*) filter (kind = 'internal') inn, count(*) filter (kind = 'external') ext from h left join l using (page_id) group by 1, 2),
 t as (select page_id, sum(passed)::int p, sum(warnings)::int w, sum(failed)::int x from c group by 1), b as (select page_id, list('Broken Link,broken,' || {_CSV('link')} || ',Status: ' || coalesce(status::varchar, 'none') || ',' order by ordinal) bad from dead group by 1),
 k as (select page_id, list(line order by ordinal) filter (ordinal < 17) early, list(line order by ordinal) filter (ordinal > 17) late from csv group by 1),
 f as (select page_id, ['SEO Analysis Report', 'URL,' || {_CSV('url')}, 'Overall Score,' || ((200 * p + 100 * w + (p + w + x)) // (2 * (p + w + x)))::varchar || '/100', 'Passed Checks,' || p, 'Warnings,' || w, 'Failed Checks,' || x, '', 'Summary', 'Category,Status,Message,Value,Recommendation']
 || early || ['Links - Total Links,info,Total links found,' || total || ',', 'Links - Internal Links,info,Internal links,' || inn || ',', 'Links - External Links,info,External links,' || ext || ',']
 || case when bad is null then [] else ['Links - Broken Links'] || bad end || late as lines from t join n using (page_id) join k using (page_id) left join b using (page_id))
 select page_id, unnest(range(1, len(lines) + 1))::bigint line_no, unnest(lines) as line from f""",
        "security_header_flags": f"with {_PF}, c as ({_rows({k: v for k, v in rules['security'][1].items() if k in ('contentSecurityPolicy', 'xFrameOptions')}, 'h')}) select page_id, count(*) filter (status = 'pass') = 2 as secure_headers from c group by 1",
        "third_party_hosts": f"with {_PF} select page_id, unnest({third}) as host from h",
        "element_counts": f"""with {_PF}, e as (select lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\\b[^>]*>).*?</script', '\\1</script', 'g'), '(?is)(<style\\b[^>]*>).*?</style', '\\1</style', 'g'), '<([a-zA-Z][a-zA-Z0-9-]*)', 1))) tag from pf where html <> '')
 select tag, count(*) elements from e group by 1""",
        "heading_counts": f"with {_PF} select page_id, {_H1}::bigint h1, " + ", ".join(rf"len(regexp_extract_all(doc, '(?i)<h{k}[\s>]'))::bigint h{k}" for k in range(2, 7)) + " from h",
        "links_extract": f"with {_PF}, {links} select page_id, ordinal, href, link, kind from l",
        "link_counts": f"with {_PF}, {links} select h.page_id, count(l.page_id) total_links, count(*) filter (kind = 'internal') internal_links, count(*) filter (kind = 'external') external_links from h left join l using (page_id) group by 1",
        "page_size": f"with {_PF} select page_id, strlen(html)::bigint bytes, ((200 * strlen(html)::bigint + 1048576) // 2097152)::bigint mb_hundredths from pf where html <> ''",
        "url_canonical": f"select distinct url, {_canonical('url')} canonical from page_fetch",
        "url_canonical_links": f"select src, dst, {_canonical('dst', 'src')} canonical from (select distinct src, dst from link_graph)",
        "url_crawlable": crawlable,
        "url_internal_external": f"select case when {_HOST('dst')} = {_HOST('src')} then 'internal' else 'external' end kind, count(*) links from link_graph where dst is not null group by 1",
        "url_host_safe": f"""select distinct url, not regexp_matches({_HOST('url')}, '^localhost$|^127\\.|^0\\.0\\.0\\.0|^10\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^192\\.168\\.|^169\\.254\\.') safe,
 {_PATH('url')} not in ('', '/') inner_page, substring(regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g'), 1, 50) stem from page_fetch""",
        "url_dedup": f"select canonical, count(*) pages, min(page_id) first_page from (select distinct page_id, {_canonical('url')} canonical from page_fetch) group by 1",
        "locale_detect": f"select distinct url, {_locale(1, 'en-US')} locale, {_locale(2, 'US')} region, {_locale(3, 'United States')} display_name from page_fetch",
        "locale_rollup": f"""with {_R} select {_locale(1, 'en-US')} locale, {_locale(2, 'US')} region, {_locale(3, 'United States')} display_name, count(*) pages, count(*) filter (status = 'pass') pass,
 count(*) filter (status = 'warn') warn, count(*) filter (status = 'fail') fail, (case {_locale(2, 'US')} when 'US' then 1 when 'AU' then 2 else 3 end)::bigint as rank from r group by all""",
        "site_stats": f"with {_R} select count(*) pages, count(*) filter (status = 'pass') pass, count(*) filter (status = 'warn') warn, count(*) filter (status = 'fail') fail from r",
        "page_issues": f"with {_R} select report_id, array_to_string({_ISSUES}, '; ') issues from r",
        "page_status": f"with {_R}, n as (select report_id, len(list_filter({_ISSUES}, lambda x: not contains(lower(x), 'twitter:') and not contains(lower(x), 'missing twitter'))) n from r) select report_id, case when n = 0 then 'pass' when n <= 2 then 'warn' else 'fail' end status from n",
        "filter_failed": f"with {_R} select report_id from r where status = 'fail'",
        "filter_missing_h1": f"with {_R} select report_id from r where not coalesce(has_single_h1, false)",
        "filter_missing_description": f"with {_R} select report_id from r where coalesce(meta.description, '') = ''",
        "filter_locale": f"with {_R} select report_id from r where {_locale(1, 'en-US')} = 'en-GB'",
        "card_flags": f"""with {_R} select report_id, coalesce(meta.robots <> '' and not contains(lower(meta.robots), 'noindex'), false) indexable, coalesce(twitter.card, twitter.title, twitter.description, twitter.image) is null no_twitter,
 greatest(coalesce(len(issues), 0) - 5, 0)::bigint more_issues, case status when 'pass' then '✓' when 'warn' then '⚠' when 'fail' then '✗' end icon from r""",
        "csv_lines": f"with {_R} {csv_lines}",
        "print_lines": f"""with {_R}, t as (select report_id, list_filter([{{'text': url, 'style': 'heading'}}, {{'text': upper(status), 'style': status}}, {{'text': meta.title, 'style': 'text'}},
 {{'text': case when length(meta.description) > 100 then substring(meta.description, 1, 100) || '...' else meta.description end, 'style': 'text'}}] || list_transform(coalesce(issues, [])[1:3], lambda x: {{'text': x, 'style': 'issue'}}), lambda l: l.text is not null) ls from r)
 select report_id, unnest(range(len(ls)))::bigint line_no, unnest(list_transform(ls, lambda l: l.text)) as text, unnest(list_transform(ls, lambda l: l.style)) as style from t""",
        "robots_sitemaps": f"with {_LIVE}, {_LINES} select site_host, ordinal::bigint ordinal, sitemap from lines where sitemap <> ''",
        "sitemap_discovery": f"""with {_LIVE}, {_LINES}, ok as (select distinct url from site_resources where status = 200), k as (select {_HOST('url')} site_host,
 list_position(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemaps.xml', '/sitemap1.xml', '/sitemap/sitemap.xml'], {_PATH('url')}) as rank, url sitemap from ok),
 b as (select * from k where rank > 0 union all select site_host, ordinal + 7, sitemap from lines where sitemap in (select url from ok)) select site_host, arg_min(sitemap, rank) sitemap from b group by 1""",
        "site_probe": f"""with {_LIVE}, {_LINES}, f as (select site_host, arg_min(sitemap, ordinal) named from lines group by 1), a as (select {_HOST('url')} site_host, max(body) filter ({_PATH('url')} = '/robots.txt') robots,
 max(url) filter ({_PATH('url')} = '/sitemap.xml') a, max(url) filter ({_PATH('url')} = '/sitemap_index.xml') b from site_resources where status = 200 group by 1) select a.site_host, robots, coalesce(named, a, b) sitemap from a left join f using (site_host)""",
        "fetch_gate": """with k as (select page_id, html, coalesce(status_code, 200) c, lower(coalesce(headers['content-type'][1], '')) t from page_fetch)
 select distinct page_id, 'html' gate from k where (contains(t, 'text/html') or contains(t, 'application/xhtml') or coalesce(starts_with(ltrim(html), '<'), false)) and c < 500
 union all select distinct page_id, 'rendered' from k where c < 400 and contains(t, 'html')""",
        "crawl_file": f"""with {_R}, lines as ({csv_lines}) select 6::bigint line_no, report_id, line from lines union all
 select unnest(range(1, 6))::bigint, null, unnest(['SEO Crawl Analysis Report', 'Total Pages,' || (select count(*) from r), 'Generated,2025-01-01T00:00:00.000Z', '', 'URL,Status,H1 Count,H1 Text,Title,Meta Description,Canonical,OG Title,OG Description,OG Image,Twitter Card,JSON-LD Present,JSON-LD Valid,Issues'])""",
        "crawl_print_summary": f"""with {_R}, n as (select count(*) a, count(*) filter (status = 'pass') p, count(*) filter (status = 'warn') w, count(*) filter (status = 'fail') x from r)
 select unnest(range(1, 8))::bigint line_no, unnest(['SEO Crawl Analysis Report', 'Total Pages Analyzed: ' || a, 'Summary', 'Passed: ' || p, 'Warnings: ' || w, 'Failed: ' || x, 'Page Details']) as text, unnest(['title', 'text', 'section', 'pass', 'warn', 'fail', 'section']) as style from n""",
        "crawl_json": f"with {_R} select report_id, to_json({{'url': url, 'status': status, 'h1Count': h1_count, 'meta': {{'title': meta.title, 'description': meta.description}}, 'issues': coalesce(issues, [])}})::varchar as body from r",
        "request_answer": """with q as (select distinct case when page_id % 7 > 0 then url end url, case page_id % 4 when 0 then null when 1 then 'many' else (page_id % 1500)::varchar end max_pages from page_fetch),
 e as (select *, case when coalesce(url, '') = '' then 'URL parameter is required' when max_pages is not null and not coalesce(try_cast(max_pages as bigint) between 1 and 1000, false) then 'maxPages must be a number between 1 and 1000' end error from q)
 select url, max_pages, case when error is null then 200 else 400 end::int http_status, error from e""",
        "export_names": """select distinct report_id, 'page-report-' || substring(regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g'), 1, 50) || '-' || (epoch_us(coalesce(analyzed_at, timestamp '2025-01-01')) // 1000)::varchar || '.csv' as name from page_report""",
        "region_list": f"""with {_R}, g as (select {_locale(3, 'United States')} display_name, count(*) pages, (case {_locale(2, 'US')} when 'US' then 1 when 'AU' then 2 else 3 end)::bigint as rank from r group by all) select * from g where (select count(*) from g) > 1""",
        "displayed_counts": f"""with {_R}, v as (select {_locale(1, 'en-US')} as locale, unnest([{{'v': 'all', 'ok': true}}, {{'v': 'failed', 'ok': coalesce(status = 'fail', false)}}, {{'v': 'missingH1', 'ok': not coalesce(has_single_h1, false)}}, {{'v': 'missingDescription', 'ok': coalesce(meta.description, '') = ''}}]) x from r),
 g as (select x.v as view, locale, count(*) filter (x.ok) shown from v group by all) select view, locale, shown, (select count(*) from r) total from g union all select view, 'all', sum(shown)::bigint, (select count(*) from r) from g group by 1""",
        "crawlable_counts": f"""select {_HOST('src')} as host, count(*) filter (crawlable) crawlable, count(*) filter (not crawlable) not_crawlable from ({crawlable}) group by 1""",
        "url_typed": r"""with u as (select distinct url from page_fetch), k as (select url, unnest(['0', '1', '2', '3']) k, regexp_replace(url, '^https?://', '') bare from u), t as (select url, k, bare, case k when '0' then '  ' || bare when '1' then url when '2' then 'a b ' || url else ' ' end typed from k)
 select distinct typed, k in ('0', '1') as valid, case k when '0' then 'https://' || bare when '1' then regexp_replace(url, '^http://', 'https://') when '2' then 'https://a b ' || url else 'https://' end as full from t where k = (length(url) % 4)::varchar""",
        "url_browser_internal": f"""select distinct src, dst, case when {_HOST('dst')} = '' then true else regexp_replace({_HOST('dst')}, '^www\\.', '') = regexp_replace({_HOST('src')}, '^www\\.', '') end as internal from link_graph where dst is not null""",
        "log_arguments": """select distinct log_id, message || ' ' || log_id || ' {"n":1}' as text from crawl_log where message <> ''""",
        "log_frames": f"""with e as (select distinct log_id, ts, {_LEVEL} as level, {_CLEAN} message from crawl_log)
 select log_id, 'data: ' || to_json({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'level': level, 'message': message}})::varchar || chr(10) || chr(10) as frame from e where message <> '' union all select null, 'data: {{"type":"complete"}}' || chr(10) || chr(10)""",
        "sitemap_urls": f"with {_XML} select url, is_index, loc, position from sm",
        "sitemap_expand": f"with recursive {_XML}, {_EXPAND} select base, sitemap, loc, position from ex",
        "crawl_sitemap_first": f"""with recursive {_XML}, {_EXPAND}, {_ALIVE},
 li as (select regexp_replace({_HOST('base')}, '^www\\.', '') site, {_canonical('loc', 'base')} url, min(position) p from ex where {crawls('loc', 'base')} group by 1, 2),
 lo as (select site, url, row_number() over (partition by site order by p, url) position from li), al as (select * from lo where position <= 200 union all select distinct regexp_replace({_HOST('base')}, '^www\\.', ''), {_canonical('base')}, 0 from ex)
 select site, url, min(position)::int as position from al where url in (select url from alive) group by 1, 2""",
        "crawl_bfs": f"{_CRAWL} select site, url, depth, position from seen",
        "crawl_browser": f"{_crawl(True)} select site, url, depth, position from seen",
        "crawl_batches": f"{_CRAWL} select site, url, ((position - 1) // 5)::bigint as batch from seen",
        "crawl_statistics": f"""{_CRAWL}, pg as (select distinct page_id, url, status_code from page_fetch), st as materialized (select * from ro union all select site, min(url) from (select distinct regexp_replace({_HOST(_canonical('url'))}, '^www\\.', '') site, {_canonical('url')} url from pg) where site <> '' and site not in (select site from ro) group by 1),
 l2 as (select st.site, loc, st.url root from ex join st on st.site = regexp_replace({_HOST('base')}, '^www\\.', '')), l3 as (select distinct site, {_canonical('loc', 'root')} url from l2 where {crawls('loc', 'root')}),
 mp as (select regexp_replace({_HOST('base')}, '^www\\.', '') site, count(*) n from ex group by 1), tk as (select site, count(*) n from seen group by 1), hd as (select e.site, count(*) n from edges e join seen s on s.site = e.site and s.url = e.src group by 1),
 dc as (select site, count(distinct url) n from (select site, url from l3 union all select site, url from seen) group by 1), er as (select s.site, count(*) n from pg join seen s on s.url = {_canonical('pg.url')} where status_code >= 400 group by 1)
 select st.site, coalesce(mp.n, 0) sitemap_urls, coalesce(hd.n, 0) html_discovered, coalesce(dc.n, 0) discovered, coalesce(tk.n, 0) total_crawled, coalesce(er.n, 0) errors from st left join mp using (site) left join hd using (site) left join dc using (site) left join tk using (site) left join er using (site) where st.site <> ''""",
        "p3_found": f"{_NESTED} select report_id, script_index, node_path, parent_path from w where type = 'OBJECT'",
        "p3_members": f"{_MEMBERS} select report_id, script_index, obj as label, osp as schema_path, leaf, key, pos as position, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind, value from m where type not in ('OBJECT', 'ARRAY')",
        "p3_tables": f"{_NESTED} select schema_path, count(*) as rows from w where type = 'OBJECT' group by 1",
        "redirect_chains": f"""with recursive p as (select distinct url, status_code, final_url from page_fetch), t as (select url, max({{'s': case when final_url <> url then 301 else status_code end, 'l': case when final_url <> url then final_url end}}) r from p group by 1),
 w as (select url, url as cur, 0 as hops, starts_with(url, 'http://') http, null::varchar outcome, 0 as step from (select distinct url from p)
 union all select w.url, case when m then r.l else cur end, hops + m::int, http or (m and starts_with(r.l, 'http://')), case when not m then case when r is null or r.s is null or r.s = 200 then case when r is not null and r.s is null then null else 'ok' end else 'HTTP ' || r.s end end, step + 1
 from (select w.*, t.r, coalesce(t.r.s >= 300 and t.r.s < 400 and t.r.l is not null, false) m from w left join t on t.url = w.cur where w.outcome is null and step < 6) w)
 select url, arg_max(cur, step) final_url, arg_max(hops, step)::bigint hops, arg_max(http, step) http_redirects, coalesce(max(outcome), 'too many redirects') outcome from w group by 1""",
        "check_words": "select unnest(['" + "', '".join(c for _, r, _ in rules.values() for c in r) + "']) as \"check\", trim(regexp_replace(\"check\", '([A-Z])', ' \\1', 'g')) as words",
        # the test pages have no links of the kinds that a browser leaves out
        "link_set_browser": f"with {_PF}, {sets} select page_id, ordinal::int as ordinal, kind, raw, resolved, canonical from ls",
        "page_print_lines": f"""{every}, {live}, t as (select page_id, sum(passed)::int p, sum(warnings)::int w, sum(failed)::int x from c group by 1), sc as (select *, ((200 * p + 100 * w + (p + w + x)) // (2 * (p + w + x)))::int score from t),
 m as (select page_id, ordinal, {label} lab, lag(category) over (partition by page_id order by ordinal) is distinct from category as first, "check", status, {said} said, {advice} adv from c where category <> 'links'),
 ml as (select page_id, ordinal, case when first then [{{'t': lab, 's': 'section'}}] else [] end || [{{'t': '  ' || "check" || ': ' || said, 's': status}}] || case when adv is null then [] else [{{'t': '    Recommendation: ' || adv, 's': 'note'}}] end ls from m),
 bo as (select page_id, flatten(list(ls order by ordinal)) ls from ml group by 1), bl as (select page_id, [{{'t': '  Broken Links: ' || count(*), 's': 'fail'}}] || list({{'t': '    - ' || coalesce(link, '') || ' (' || coalesce(status::varchar, 'none') || ')', 's': 'fail'}} order by ordinal)[1:10] ls from dead group by 1),
 f as (select page_id, [{{'t': 'SEO Analysis Report', 's': 'title'}}, {{'t': 'URL: ' || url, 's': 'link'}}, {{'t': 'Overall SEO Score: ' || score || '/100', 's': case when score >= 80 then 'pass' when score >= 60 then 'warn' else 'fail' end}}, {{'t': 'Summary', 's': 'section'}}, {{'t': 'Passed: ' || p, 's': 'text'}}, {{'t': 'Warnings: ' || w, 's': 'text'}}, {{'t': 'Failed: ' || x, 's': 'text'}}] || bo.ls || coalesce(bl.ls, []) as lines
 from sc join pf using (page_id) join bo using (page_id) left join bl using (page_id)) select page_id, unnest(range(1, len(lines) + 1))::bigint line_no, unnest(list_transform(lines, lambda l: l.t)) as text, unnest(list_transform(lines, lambda l: l.s)) as style from f""",
        "json_ld_pages": f"with {_PF}, {rep} select h.page_id, coalesce(cnt, 0)::int as count, coalesce(valid, false) as valid, coalesce(array_to_string(errs, '; '), '') as errors, coalesce(types, '') as types from h left join lp using (page_id) left join tt using (page_id)",
        "page_report_flat": f"with {_PF}, {rep} select page_id, url, h1_count, has_single_h1, title, description, canonical, json_ld_valid, status, array_to_string(iss, '; ') as issues from rs",
        "site_report": f"{_CRAWL}, {_PF}, {rep} select page_id, rs.url, seen.position as page_no, sitemap as sitemap_url, status from rs join seen on seen.url = {_canonical('rs.url')} left join rt on rt.base = 'https://' || {_HOST('rs.url')} || '/'",
        "link_set": f"with {_PF}, {sets} select page_id, ordinal::int as ordinal, kind, raw, resolved, canonical from ls",
        "log_levels": f"with e as (select {_LEVEL} as level, {_CLEAN} message from crawl_log) select level, case level when 'success' then '✓' when 'warning' then '⚠' when 'error' then '✗' else '→' end icon, count(*) events from e where message <> '' group by 1, 2",
        "log_events": f"with e as (select distinct log_id, {_LEVEL} as level, {_CLEAN} message from crawl_log) select * from e where message <> ''",
        "log_progress": "with e as (select distinct log_id, ts from crawl_log where contains(message, 'Analyzed ')), n as (select row_number() over (order by ts, log_id) analysed, ts from e) select analysed, ts from n where analysed % 10 = 0",
    }
    return out
