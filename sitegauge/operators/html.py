"""Lean HTML scanning for Python workers.

Only what page-text operators need: one compiled regular expression finds tags, so a page costs a
few regular-expression passes instead of one Python call per tag. Rules, in the order applied:

* comments and the insides of raw or hidden elements (script, style, template) are no text;
* ``header nav aside footer noscript`` are boilerplate and lie outside the main text;
* a ``p`` ends at its end tag or where the next block element begins or the enclosing one ends;
* entities are decoded after the tags are gone.

Null or empty html gives no text. An unclosed hidden element hides nothing beyond its tag.
"""

from __future__ import annotations

import re
from html import unescape

#: Element names by role.
HIDDEN = ("script", "style", "template")
BOILERPLATE = ("header", "nav", "aside", "footer", "noscript")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
)

REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def region(names: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(rf"<!--.*?-->|<({'|'.join(names)})(?=[\s/>]){REST}.*?</\1\s*>", re.S | re.I)


_NO_TEXT = region(HIDDEN)
_OUTSIDE = region(HIDDEN + BOILERPLATE)
_NAMES = "|".join(b for b in BLOCK if b != "p")
_P = re.compile(rf"<p(?=[\s/>]){REST}(.*?)(?=</?(?:p|{_NAMES})(?=[\s/>])|\Z)", re.S | re.I)
_TAG = re.compile(rf"</?[a-z]{REST}|<![a-z]{REST}", re.S | re.I)
_SPACE = re.compile(r"\s+")


def plain(fragment: str) -> str:
    """Text of an html fragment: tags dropped, entities decoded, white space collapsed."""
    if "<" in fragment:
        fragment = _TAG.sub("", fragment)
    if "&" in fragment:
        fragment = unescape(fragment)
    return " ".join(fragment.split())


def paragraphs(html: str | None) -> list[str]:
    """Texts of the ``p`` elements of the main text in document order; empty ones stay as ''."""
    if not html:
        return []
    return [plain(x) for x in _P.findall(_OUTSIDE.sub(" ", html))]


def main_text(html: str | None) -> str:
    """The paragraphs joined by a space."""
    return " ".join(paragraphs(html))
