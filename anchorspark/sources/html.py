"""Hierarchical HTML to typed passages.

A page is scanned once.  Headings and structural ids move a place (chapter,
section, article, annex ...); a new place at a level clears the levels below
it.  Text gathers under the place until the place changes; a passage over the
budget of tokens is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from .budget import Budget

LEVELS = ("annex", "chapter", "section", "article", "paragraph", "litra")
_CLEARS = {"annex": LEVELS[1:], "chapter": LEVELS[2:], "section": LEVELS[3:], "article": LEVELS[4:], "paragraph": LEVELS[5:], "litra": ()}
_ID = re.compile(r"^(?:(cpt)_([IVXLCDM]+|\d+)(?:\.sct_(\d+))?|(art)_(\d+[a-z]?)|(anx)_([IVXLCDM]+|\d+))$")
_TITLE = [("chapter", re.compile(r"^(?:kapitel|chapter)\s+([ivxlcdm]+|\d+)\b", re.I)), ("section", re.compile(r"^(?:afdeling|afsnit|section)\s+([ivxlcdm]+|\d+)\b", re.I)), ("article", re.compile(r"^(?:artikel|article)\s+(\d{1,3}[a-z]?)\b", re.I)), ("annex", re.compile(r"^(?:bilag|annex)\s+([ivxlcdm]+|\d+)\b", re.I))]
_MARK = [("paragraph", re.compile(r"^(\d{1,3})\.\s")), ("litra", re.compile(r"^([a-z]{1,2})\)\s"))]
_SKIP, _BLOCK, _HEAD = {"script", "style", "nav", "head"}, {"p", "div", "li", "td", "br", "tr", "table", "article", "section", "ul", "ol"}, {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Blocks(HTMLParser):
    """(kind, text) in document order: heading, text, row, or id of a structural part."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.part: list[str] = []
        self.kind, self.skip, self.cells = "text", 0, None

    def flush(self):
        body = re.sub(r"\s+", " ", "".join(self.part)).strip()
        self.part = []
        if body:
            if self.cells is not None:
                self.cells.append(body)
            else:
                self.out.append((self.kind, body))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCK or tag in _HEAD:
            self.flush()
        if tag == "tr":
            self.cells = []
        if tag in _HEAD:
            self.kind = "heading"
        for k, v in attrs:
            if k == "id" and v and _ID.match(v):
                self.out.append(("id", v))

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag in _BLOCK or tag in _HEAD:
            self.flush()
        if tag == "tr" and self.cells is not None:
            cells, self.cells = self.cells, None
            if cells:
                self.out.append(("row", " | ".join(cells)))
        if tag in _HEAD:
            self.kind = "text"

    def handle_data(self, data):
        if not self.skip:
            self.part.append(data)


def blocks(html: str) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cells = None
    parser.flush()
    return parser.out


def chunk_html(html: str, budget: Budget) -> Iterator[dict]:
    """Passages of one page with their places."""
    place: dict[str, str | None] = dict.fromkeys(LEVELS)
    heading, held = None, []

    def move(level: str, value: str):
        for lower in _CLEARS[level]:
            place[lower] = None
        place[level] = value.upper() if level in ("annex", "chapter", "section", "article") else value

    def flush():
        if held:
            for piece, n_tokens in budget.pieces(" ".join(held)):
                yield {**place, "heading": heading, "text": piece, "n_tokens": n_tokens}
            held.clear()

    for kind, body in blocks(html):
        if kind == "id":
            yield from flush()
            m = _ID.match(body)
            if m[1]:
                move("chapter", m[2])
                if m[3]:
                    move("section", m[3])
            else:
                move("article" if m[4] else "annex", m[5] or m[7])
            continue
        title = next(((level, m[1]) for level, p in _TITLE if (m := p.match(body)) and (kind == "heading" or len(body) < 80)), None)
        if title or kind == "heading":
            yield from flush()
            if title:
                move(*title)
            heading = body
            continue
        mark = next(((level, m[1]) for level, p in _MARK if place["article"] and (m := p.match(body))), None)
        if mark:
            yield from flush()
            move(*mark)
        held.append(body)
    yield from flush()
