"""Page facts: every page is parsed once, in an Arrow batch, into one compact struct.

All audit rules are column expressions over these facts, so the Python boundary is crossed once per page.
``nodes`` gives the one-row-per-element form for queries about single elements.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of HTML and of the audit.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SEMANTIC = frozenset("nav main article section aside header footer figure figcaption".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTROLS = frozenset(("input", "textarea", "select"))
FOCUSABLE = frozenset(("a", "button", "input", "select", "textarea"))
CONSENT = ("cookie", "consent", "gdpr", "privacy")
LINK_RELS = ("canonical", "alternate", "next", "prev")
DATA_URLS = tuple(f"data-{x}" for x in "url href link path route to navigate navigation page page-url page-path".split())
#: What stands before a quoted text of a script that makes it a URL: a name or place it is given
#: to, the quoted key of an object, a function that takes it; in an object that such a function takes, or in the
#: tag of a link component, some more names.
URL_NAMES = ("href", "url", "path", "route", "window.location", "location.pathname")
URL_KEYS = ("url", "href", "link", "path", "route", "pathname", "to")
URL_CALLS = ("location.replace", "location.assign", "router.push", "router.replace", "navigate", "history.push", "history.replace", "userouter().push")
OBJECT_NAMES, TAG_NAMES = ("path", "pathname", "to"), ("to",)
NOT_URLS = ("javascript:", "#", "mailto:", "tel:")
_GIVEN = re.compile(r"""([:=(])\s*["']([^"']+)["']""")
_EDGES = re.compile(rf"(?P<object>(?:{'|'.join(map(re.escape, URL_CALLS))})\s*\(\s*\{{)|(?P<tag><(?:nav)?link\b|router-link\b)|[}}>]", re.I)
_LONGEST = 2 + max(map(len, URL_NAMES + URL_KEYS + URL_CALLS))


def script_urls(body: str) -> list[str]:
    """Quoted texts of a script, in order, that what stands before them makes URLs; one pass, whatever the text."""
    out = []
    edges = _EDGES.finditer(body)
    edge, within = next(edges, None), ""
    for m in _GIVEN.finditer(body):
        while edge and edge.end() <= m.start():
            within = edge.lastgroup or ("" if (edge[0] == "}") == (within == "object") else within)
            edge = next(edges, None)
        end = m.start()
        while end and body[end - 1].isspace():
            end -= 1
        head = body[max(0, end - _LONGEST) : end].lower()
        named = head.endswith(URL_NAMES) or (within == "object" and head.endswith(OBJECT_NAMES)) or (within == "tag" and m[1] == "=" and head.endswith(TAG_NAMES))
        keyed = m[1] == ":" and any(head.endswith((f'"{k}"', f"'{k}'")) for k in URL_KEYS)
        if (head.endswith(URL_CALLS) if m[1] == "(" else named or keyed) and len(m[2]) > 1 and not m[2].startswith(NOT_URLS):
            out.append(m[2])
    return out


LINK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType())])
FACTS = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("title", "canonical", "charset", "sitemap_href", "base_href")),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("prop", T.MapType(T.StringType(), T.StringType())),
        T.StructField("h1_texts", T.ArrayType(T.StringType())),
        T.StructField("headings", T.ArrayType(T.IntegerType())),
        T.StructField("anchors", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("script_srcs", T.ArrayType(T.StringType())),
        T.StructField("json_ld", T.ArrayType(T.StringType())),
        *(
            T.StructField(n, T.IntegerType())
            for n in (
                "nodes h2 h3 h4 h5 h6 images lazy_images modern_images alt_missing alt_empty scripts stylesheets blocking_scripts "
                "blocking_styles font_links mixed_content controls unlabelled aria_issues semantic divs spans keyboard_issues outline_removed"
            ).split()
        ),
        *(T.StructField(n, T.BooleanType()) for n in ("font_display", "analytics", "tag_manager", "pixel", "tracking", "consent")),
    ]
)
NODES = "page_id long, node_id int, parent_id int, depth int, tag string, attrs map<string,string>, text string"


class _Tree(HTMLParser):
    """Elements in document order with an open-element stack; no tree repair beyond unmatched tags.

    Text is kept once, in pieces; an element knows the first and last piece inside it. So a page costs time
    in proportion to its length, however deep it nests and whatever it leaves unclosed.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.pieces: list[str] = []
        self.start: list[int] = []
        self.end: list[int | None] = []
        #: Whether an element stands in a label or noscript element.
        self.labelled: list[bool] = []
        self.fallback: list[bool] = []
        #: Pieces so far that aren't blank, before each piece.
        self.solid = [0]
        self.open: list[int] = []
        self.opened: Counter[str] = Counter()

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            i = self.open.pop()
            self.end[i] = len(self.pieces)
            self.opened[self.tags[i]] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        mine: dict[str, str] = {}
        for k, v in attrs:
            mine.setdefault(k, v or "")
        last = self.tags[self.open[-1]] if self.open else ""
        if (tag in ("p", "li") and last == tag) or (tag in HEADINGS and last in HEADINGS):
            self._close(len(self.open) - 1)
        self.tags.append(tag)
        self.attrs.append(mine)
        self.parents.append(self.open[-1] if self.open else -1)
        self.start.append(len(self.pieces))
        self.labelled.append(self.opened["label"] > 0)
        self.fallback.append(self.opened["noscript"] > 0)
        if tag in VOID:
            self.end.append(len(self.pieces))
        else:
            self.end.append(None)
            self.open.append(len(self.tags) - 1)
            self.opened[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.opened[tag] > 0:
            k = len(self.open) - 1
            while self.tags[self.open[k]] != tag:
                k -= 1
            self._close(k)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.solid.append(self.solid[-1] + (not data.isspace()))

    def read(self, html: str) -> _Tree:
        self.feed(html)
        self.close()
        self._close(0)
        return self

    def all_text(self, i: int) -> str:
        return "".join(self.pieces[self.start[i] : self.end[i]])

    def empty(self, i: int) -> bool:
        """Whether an element holds no text but white space."""
        return self.solid[self.start[i]] == self.solid[self.end[i]]

    def own_texts(self) -> list[str]:
        """The text that lies in each element and in no element below it."""
        own: list[list[str]] = [[] for _ in self.tags]
        stack: list[int] = []
        i = 0
        for k, piece in enumerate(self.pieces):
            while i < len(self.tags) and self.start[i] <= k:
                stack.append(i)
                i += 1
            while stack and self.end[stack[-1]] <= k:
                stack.pop()
            if stack:
                own[stack[-1]].append(piece)
        return ["".join(x) for x in own]


def facts(html: str) -> dict:
    """The facts of one page; see ``FACTS``."""
    t = _Tree().read(html)
    out: dict = {f.name: 0 for f in FACTS if f.dataType == T.IntegerType()}
    out |= {f.name: False for f in FACTS if f.dataType == T.BooleanType()}
    out |= {f.name: None for f in FACTS if f.dataType == T.StringType()}
    meta: dict[str, str] = {}
    prop: dict[str, str] = {}
    titles, h1, headings, anchors, srcs, ld = [], [], [], [], [], []
    links: list[tuple[str, int, str]] = []
    fors = {a["for"] for tag, a in zip(t.tags, t.attrs, strict=True) if tag == "label" and a.get("for")}
    equiv = None
    seen: set[str] = set()
    out["nodes"] = len(t.tags)

    def first(name: str, value: str | None) -> None:
        if name not in seen:
            seen.add(name)
            out[name] = value or None

    for i, (tag, a) in enumerate(zip(t.tags, t.attrs, strict=True)):
        src, href = a.get("src", ""), a.get("href", "")
        if tag == "title":
            titles.append(t.all_text(i))
        elif tag in HEADINGS:
            headings.append(int(tag[1]))
            if tag == "h1":
                h1.append(t.all_text(i).strip())
            else:
                out[tag] += 1
        elif tag == "meta":
            if "name" in a:
                meta.setdefault(a["name"], a.get("content", ""))
            if "property" in a:
                prop.setdefault(a["property"], a.get("content", ""))
            if "charset" in a:
                first("charset", a["charset"])
            kind = a.get("http-equiv", "").lower()
            if kind == "content-type" and equiv is None:
                equiv = a.get("content", "")
            if kind == "refresh" and (m := re.search(r"url\s*=\s*([^;,\s]+)", a.get("content", ""), re.I)):
                links.append(("refresh", 5, m[1]))
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "canonical":
                first("canonical", href)
            elif rel == "sitemap":
                first("sitemap_href", href)
            elif rel == "stylesheet":
                out["stylesheets"] += 1
                out["blocking_styles"] += a.get("media", "").lower() != "print"
                out["font_display"] |= "font-display" in href
                out["mixed_content"] += href.startswith("http://")
            out["font_links"] += (rel == "stylesheet" and "font" in href) or "googleapis.com/fonts" in href or "fonts.googleapis.com" in href
            if rel in LINK_RELS and href:
                links.append(("link", 3, href))
        elif tag == "base":
            if "href" in a:
                first("base_href", href)
        elif tag == "style":
            out["font_display"] |= "font-display" in t.all_text(i)
        elif tag == "img":
            out["images"] += 1
            out["lazy_images"] += a.get("loading") == "lazy"
            out["modern_images"] += ".webp" in src or ".avif" in src
            out["alt_missing"] += "alt" not in a
            out["alt_empty"] += "alt" in a and not a["alt"].strip()
            out["mixed_content"] += src.startswith("http://")
        elif tag == "iframe":
            out["mixed_content"] += src.startswith("http://")
            out["tag_manager"] |= "googletagmanager.com" in src and t.fallback[i]
        elif tag == "script":
            body = t.all_text(i)
            if "src" in a:
                srcs.append(src)
                out["blocking_scripts"] += "async" not in a and "defer" not in a
                out["mixed_content"] += src.startswith("http://")
            if "application/ld+json" in a.get("type", "").lower() or (body.strip()[:1] in ("{", "[") and ("@context" in body or "@type" in body)):
                if body.strip():
                    ld.append(body)
            out["analytics"] |= "googletagmanager.com/gtag" in src or "google-analytics.com" in src or any(x in body for x in ("ga(", "gtag(", "GoogleAnalyticsObject"))
            out["tag_manager"] |= "googletagmanager.com/gtm.js" in src or "dataLayer" in body or "GTM-" in body
            out["pixel"] |= "fbq(" in body or "facebook.net" in body
            out["tracking"] |= any(x in src for x in ("google-analytics", "googletagmanager", "facebook.net")) or any(x in body for x in ("gtag(", "fbq(", "dataLayer"))
            out["consent"] |= "cookie" in body and ("consent" in body or "accept" in body)
            links += [("script", 6, u) for u in script_urls(body)]
        elif tag == "a":
            if "href" in a:
                anchors.append(href)
                if href.strip():
                    links.append(("a", 1, href))
        elif tag == "area":
            if href.strip():
                links.append(("area", 2, href))
        elif tag == "form":
            if a.get("action", "").strip():
                links.append(("form", 4, a["action"]))
        if tag in CONTROLS:
            out["controls"] += 1
            named = (a.get("id") and a["id"] in fors) or a.get("aria-label") or a.get("aria-labelledby") or t.labelled[i]
            out["unlabelled"] += a.get("type", "").lower() != "hidden" and not named
        out["semantic"] += tag in SEMANTIC
        out["divs"] += tag == "div"
        out["spans"] += tag == "span"
        if a:
            nameless = "aria-label" not in a and "aria-labelledby" not in a
            out["aria_issues"] += a.get("aria-required") == "true" and "required" not in a
            out["aria_issues"] += a.get("aria-hidden") == "true" and (tag in FOCUSABLE or "tabindex" in a)
            if (tag == "button" or (tag == "a" and "href" not in a)) and nameless:
                out["aria_issues"] += t.empty(i)
            if tag in FOCUSABLE or "tabindex" in a:
                m = re.match(r"\s*([+-]?\d+)", a.get("tabindex", ""))
                out["keyboard_issues"] += bool(m) and int(m[1]) > 0
                out["keyboard_issues"] += "disabled" in a and (tag == "a" or "tabindex" in a)
            style = a.get("style", "")
            out["outline_removed"] += "outline: none" in style or "outline:0" in style
            marks = a.get("class", "") + "\n" + a.get("id", "")
            out["consent"] |= any(x in marks for x in CONSENT)
            if any(k in a for k in DATA_URLS):
                value = next((a[k] for k in DATA_URLS if a.get(k)), "")
                if value.strip():
                    links.append(("data", 7, value))
        elif tag in ("button", "a"):
            out["aria_issues"] += t.empty(i)
    links.sort(key=lambda x: x[1])
    out |= {
        "title": "".join(titles).strip() or None, "meta": meta, "prop": prop, "h1_texts": h1, "headings": headings, "anchors": anchors,
        "script_srcs": srcs, "json_ld": ld, "links": [{"kind": k, "raw": r} for k, _, r in links], "scripts": len(srcs),
    }
    out["charset"] = out["charset"] or equiv or None
    return out


def page_facts(pages: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` with its html replaced by struct ``facts``; null where html is null or empty.

    ``names`` are the facts that are wanted, all if none are named; the others are not sent to the JVM. A page
    that can't be parsed has null facts and ``failed`` true. All other columns of the input stay.
    """
    wanted = FACTS if names is None else T.StructType([f for f in FACTS if f.name in names])
    schema = T.StructType([f for f in pages.schema if f.name != "html"] + [T.StructField("facts", wanted), T.StructField("failed", T.BooleanType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = target.field("facts").type
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                found, failed = [], []
                for html in part.column("html").to_pylist():
                    try:
                        found.append(facts(html) if html else None)
                        failed.append(False)
                    except (AssertionError, ValueError, RecursionError):
                        found.append(None)
                        failed.append(True)
                cols = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "html"]
                names = [n for n in part.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind), pa.array(failed)], [*names, "facts", "failed"])

    return pages.mapInArrow(run, schema)


def nodes(pages: DataFrame) -> DataFrame:
    """One row per element of every page: see ``NODES``; text is the element's own. Null or empty html has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        names = ["page_id", "node_id", "parent_id", "depth", "tag", "attrs", "text"]
        for b in batches:
            rows: list[tuple] = []
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                t = _Tree().read(html)
                depth: list[int] = []
                for p in t.parents:
                    depth.append(0 if p < 0 else depth[p] + 1)
                rows += zip([page] * len(depth), range(len(depth)), t.parents, depth, t.tags, (list(a.items()) for a in t.attrs), (x.strip() for x in t.own_texts()), strict=True)
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pages.filter(F.length("html") > 0).select("page_id", "html").mapInArrow(run, NODES)


def tag_counts(pages: DataFrame) -> DataFrame:
    """(page_id, tags): the number of elements of each tag of a page, counted where the page is parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.int64())
        for b in batches:
            told = [list(Counter(_Tree().read(html).tags).items()) for html in b.column("html").to_pylist()]
            cols = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "html"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(told, kind)], [*(n for n in b.schema.names if n != "html"), "tags"])

    lean = pages.filter(F.length("html") > 0)
    schema = T.StructType([f for f in lean.schema if f.name != "html"] + [T.StructField("tags", T.MapType(T.StringType(), T.LongType()))])
    return lean.mapInArrow(run, schema)
