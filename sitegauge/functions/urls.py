"""URL operators as column expressions: no Python worker is involved.

A URL is taken apart by three regular expressions (scheme, authority, path), changed by ``regexp_replace``
and put together again. Whatever isn't an http(s) URL in the end is null. Host names stay as written but
for case: international names aren't converted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import blank_to_null, js_trim

_URL = r"^(?i)(https?)://([^/?#\\]*)([^?#]*)"
#: Schemes that are never crawled, default documents, file types without pages.
NOT_CRAWLED = ("mailto:", "tel:", "javascript:", "data:", "ftp:", "file:")
DEFAULT_DOCUMENT = r"(?i)/(?:index\.(?:html?|php|aspx?|jsp|cgi)|default\.(?:html?|php|aspx?))$"
SKIPPED_TYPES = (
    "pdf jpg jpeg png gif svg webp ico zip exe dmg css js json xml txt mp4 mp3 avi mov wmv flv webm woff woff2 ttf eot otf"
).split()
ASSET_FOLDERS = ("static", "assets", "css", "js", "images", "img")
ASSET_TYPES = "css js jpg jpeg png gif svg woff woff2 ttf eot ico".split()


def scheme(url: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(url, _URL, 1)))


def host(url: Column) -> Column:
    """Lower-case host name without user, port and default-port; null where the URL has none."""
    authority = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"^.*@|:\d*$", "")
    return blank_to_null(F.lower(authority))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, _URL, 2)))


def path(url: Column) -> Column:
    """Path of an http(s) URL, '' where it is absent, null for other texts."""
    return F.when(url.rlike(_URL), F.regexp_extract(url, _URL, 3))


def bare_host(name: Column) -> Column:
    return F.regexp_replace(name, "^www\\.", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_dots(p: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""

    def carried(x: Column) -> Column:
        kept = F.aggregate(
            F.split(x, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .otherwise(F.array_append(acc, s)),
        )
        joined = F.array_join(kept, "/")
        ended = F.concat(F.regexp_replace(joined, "/$", ""), F.lit("/"))
        return F.when(~x.contains("/."), x).when(x.rlike(r"/\.\.?$"), ended).otherwise(joined)

    return let(p, carried)


def _resolved(href: Column, base: Column) -> Column:
    folder = F.regexp_replace(F.regexp_replace(path(base), "[^/]*$", ""), "^$", "/")
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    plain = F.regexp_replace(href, r"[?#].*$", "")
    whole_base = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), without_dots(plain), tail))
        .when(href == "", whole_base)
        .when(href.startswith("?"), F.concat(F.regexp_replace(whole_base, r"\?.*$", ""), href))
        .when(href.startswith("#"), F.concat(whole_base, href))
        .otherwise(F.concat(origin(base), without_dots(F.concat(folder, plain)), tail))
    )


def resolve(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL against an absolute ``base``; null where either is null."""
    return let(F.struct(href.alias("h"), base.alias("b")), lambda v: _resolved(v["h"], v["b"]))


def _encoded(p: Column) -> Column:
    """Percent-encode what a browser would: everything beyond printable ASCII and a few marks."""
    each = F.transform(
        F.split(p, ""),
        lambda c: F.when(c.rlike(r'[^\x21-\x7E]|["<>`{}^]'), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c),
    )
    return F.when(p.rlike(r'[^\x21-\x7E]|["<>`{}^]'), F.array_join(each, "")).otherwise(p)


def canonical(url: Column, base: Column | None = None, force_https: bool = True) -> Column:
    """The one form of a page's URL: https, host of the base's www form, clean path, no query or fragment.

    Null, blank, fragment-only and non-http(s) URLs give null. Without ``base`` only absolute URLs count.
    Applying it twice changes nothing.
    """
    refused = "^(?:" + "|".join(NOT_CRAWLED) + ")"
    text = let(
        js_trim(F.regexp_extract(js_trim(url), "^[^#]*", 0)),
        lambda t: F.when((t != "") & ~F.lower(t).rlike(refused), F.regexp_replace(t, "^([A-Za-z][A-Za-z0-9+.-]*:)/{3,}", "$1//")),
    )
    if base is None:
        return let(text, lambda u: _clean(u, None, force_https))
    return let(F.struct(resolve(text, base).alias("u"), host(base).alias("own")), lambda v: _clean(v["u"], v["own"], force_https))


def _clean(url: Column, own: Column | None, force_https: bool) -> Column:
    """The clean form of an absolute URL; ``own`` is the host whose www form it takes."""
    name = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^.*@|:(?:80|443)?$", "")
    if own is not None:
        name = let(name, lambda n: F.when(bare_host(n) == bare_host(own), own).otherwise(n))
    p = F.regexp_replace(F.regexp_replace(without_dots(F.regexp_extract(url, _URL, 3)), "/+", "/"), DEFAULT_DOCUMENT, "/")
    kind = F.lit("https") if force_https else scheme(url)
    whole = let(
        F.struct(name.alias("n"), F.regexp_replace(p, "/$", "").alias("p")),
        lambda v: F.when(v["n"] != "", F.concat(kind, F.lit("://"), v["n"], F.when(v["p"] == "", "/").otherwise(_encoded(v["p"])))),
    )
    return F.when(url.rlike(_URL), whole)


def crawlable(url: Column, base: Column) -> Column:
    """Whether a URL, made canonical, is a page of the base's site; null URLs aren't."""
    skipped = r"\.(?:" + "|".join(SKIPPED_TYPES) + ")$"
    fits = let(canonical(url, base), lambda c: (bare_host(host(c)) == bare_host(host(base))) & ~F.lower(path(c)).rlike(skipped))
    return F.coalesce(fits, F.lit(False))


def safe_host(url: Column) -> Column:
    """False for loopback, private and link-local hosts and for texts without a host."""
    blocked = r"^localhost$|^127\.|^0\.0\.0\.0|^10\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\.|^169\.254\."
    return F.coalesce(~host(url).rlike(blocked), F.lit(False))


def with_scheme(url: Column, force_https: bool = False) -> Column:
    """A typed address as a URL: trimmed, https put before it where no scheme is."""
    text = js_trim(url)
    full = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.regexp_replace(full, "^http://", "https://") if force_https else full


def valid_input(text: Column) -> Column:
    """Whether a typed address is a URL once https is put before one without a scheme; null and blank ones aren't."""
    typed = js_trim(text)
    full = F.when(typed.startswith("http"), typed).otherwise(F.concat(F.lit("https://"), typed))
    return F.coalesce((typed != "") & full.rlike(r"^(?i)https?:/*[^\s/?#:@]+(?::\d{1,5})?(?:[/?#]|$)"), F.lit(False))


def browser_internal(url: Column, base: Column, page: Column) -> Column:
    """Whether a browser crawl takes a link for its site's own: host of the base or of the page, www or not, or no host."""
    name = bare_host(host(url))
    return F.coalesce((name == bare_host(host(base))) | (name == bare_host(host(page))) | (origin(url) == origin(page)), url.isNotNull() & host(url).isNull())


def counted_link(href: Column) -> Column:
    """Whether an anchor counts as a link of its page: not empty, a fragment, a script or a mail address."""
    return F.coalesce((href != "") & ~href.rlike("^(?:#|javascript:|mailto:)"), F.lit(False))


def link_kind(link: Column, page: Column) -> Column:
    """internal where the hosts are exactly equal, else external; null links stay null."""
    return F.when(link.isNotNull(), F.when(host(link) == host(page), "internal").otherwise("external"))


def third_party(name: Column, page_host: Column) -> Column:
    return (name != page_host) & ~F.contains(name, F.regexp_replace(page_host, r"^(.*?)www\.", "$1"))


def static_asset(url: Column) -> Column:
    p = F.lower(path(url))
    return F.coalesce(p.rlike("/(?:" + "|".join(ASSET_FOLDERS) + r")/|\.(?:" + "|".join(ASSET_TYPES) + ")$"), F.lit(False))


def inner_page(url: Column) -> Column:
    return F.coalesce(~path(url).isin("", "/"), F.lit(False))


def file_stem(url: Column) -> Column:
    """A file name made of a URL: other characters than letters and digits become '-', 50 at most."""
    return F.substring(F.regexp_replace(url, "(?i)[^a-z0-9]", "-"), 1, 50)
