"""A scanner for HTML that takes time linear in the page, whatever stands in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no text of the page; it is skipped up to their end tag, or to the end of the page.
SKIPPED = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style noscript template textarea title svg iframe".split()}


def _tag_end(html: str, at: int) -> int:
    """Where the tag's ``>`` stands, -1 if nowhere. A quote counts only after ``=``, and only if it is closed."""
    while m := _STOP.search(html, at):
        p = m.start()
        if html[p] == ">":
            return p
        before = p - 1
        while html[before].isspace():
            before -= 1
        close = html.find(html[p], p + 1) if html[before] == "=" else -1
        at = close + 1 if close >= 0 else p + 1
    return -1


def scan(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text, name, attributes, closing): a piece of text and the tag after it; name is '' at the end of the page and where a piece goes on.

    Comments, declarations and what ``SKIPPED`` elements hold are left out. A tag that never ends takes the rest of the page with it.
    """
    at, end = 0, len(html)
    while at < end:
        m = _OPENS.search(html, at)
        if not m:
            yield html[at:], "", "", False
            return
        lt = m.start()
        text, sign = html[at:lt], html[lt + 1]
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 2)  # "<!-->" is a whole comment
            at, name = (stop + 3 if stop >= 0 else end), None
        elif sign in "!?" or sign == "/" and not _NAME.match(html, lt + 2):
            stop = html.find(">", lt)
            at, name = (stop + 1 if stop >= 0 else end), None
        else:
            name = _NAME.match(html, lt + 1 + (sign == "/"))
            stop = _tag_end(html, name.end())
            at = stop + 1 if stop >= 0 else end
            if stop < 0:
                name = None
        if name is None:
            if text:
                yield text, "", "", False
            continue
        lower, attributes = name[0].lower(), html[name.end() : stop]
        if lower in SKIPPED:
            if sign != "/" and not (lower == "svg" and attributes.endswith("/")):
                found = SKIPPED[lower].search(html, at)
                stop = html.find(">", found.end()) if found else -1
                at = stop + 1 if stop >= 0 else end
            if text:
                yield text, "", "", False
            continue
        yield text, lower, attributes, sign == "/"


def visible_text(html: str | None) -> str:
    """The page's text without markup: character references decoded, tags and white space made one space."""
    parts = []
    for text, name, _, _ in scan(html or ""):
        parts += (text, " " if name else "")
    return " ".join(unescape("".join(parts)).split())
