"""Passages of official-journal pages, whose classes and ids mark structure, titles and tables.

A page is scanned once into blocks; a place (recital, chapter, section, article,
paragraph, litra, annex and its parts) moves with structural ids, headings and
list markers.  A marker that stands alone is joined to the text after it.  Text
gathers until the place changes; a passage over the budget of tokens is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from .budget import Budget
from .html_tables import table_rows

LEVELS = ("recital", "chapter", "section", "article", "paragraph", "litra", "annex", "annex_section", "annex_point", "annex_subpoint")
TITLED = ("chapter", "section", "article", "annex", "annex_section", "annex_point", "annex_subpoint")
_ANNEX_PARTS = ("annex_section", "annex_point", "annex_subpoint")
#: What a new value of a level makes void.
CLEARS = {
    "recital": ("chapter", "section", "article", "paragraph", "litra", "annex", *_ANNEX_PARTS),
    "chapter": ("recital", "section", "article", "paragraph", "litra", "annex", *_ANNEX_PARTS),
    "section": ("article", "paragraph", "litra"),
    "article": ("recital", "paragraph", "litra"),
    "paragraph": ("litra",),
    "litra": (),
    "annex": ("recital", "chapter", "section", "article", "paragraph", "litra", *_ANNEX_PARTS),
    "annex_section": ("annex_point", "annex_subpoint", "litra"),
    "annex_point": ("annex_subpoint", "litra"),
    "annex_subpoint": ("litra",),
}
# The pages' ids, classes and marker forms.
_ID = re.compile(r"^(cpt|anx|art)_([A-Za-z0-9]+)(?:\.sct_([A-Za-z0-9]+))?$", re.I)
_KINDS = {"cpt": "chapter", "anx": "annex", "art": "article"}
_NAMED = [("chapter", r"(?:kapitel|chapter)\s+([ivxlcdm]+|\d+)"), ("section", r"(?:afdeling|section)\s+([ivxlcdm]+|\d+)"), ("article", r"(?:artikel|article)\s+(\d{1,3}[a-z]?)"), ("annex", r"(?:bilag|annex)\s+([ivxlcdm]+|\d+)")]
_NAMED = [(level, re.compile(rf"^{p}$", re.I)) for level, p in _NAMED]
_PART = [("annex_section", re.compile(r"^(?:afsnit|section)\s+([a-z0-9]+)\b[\s.–—-]*(.*)$", re.I)), ("annex_subpoint", re.compile(r"^(\d{1,3}\.\d{1,3})\.?\s+(.+)$")), ("annex_point", re.compile(r"^(\d{1,3})\.\s+(.+)$"))]
_DASH = re.compile(r"^[-–—]+$")
_ALONE = [("number", re.compile(r"^\((\d{1,4})\)$")), ("roman", re.compile(r"^([ivxlcdm]{2,12})\)$", re.I)), ("item", re.compile(r"^(\d{1,3})\)$")), ("litra", re.compile(r"^([a-z])\)$", re.I)), ("point", re.compile(r"^(\d{1,2})\.$"))]
_INLINE = [("annex_subpoint", re.compile(r"^(\d{1,3}\.\d{1,3})(\.?)\s+(.+)$")), ("annex_point", re.compile(r"^(\d{1,2})(\.)\s+(.+)$"))]
_INNER = [("paragraph", re.compile(r"^(\d{1,3})\.\s+\S")), ("litra", re.compile(r"^([a-z])\)\s+\S", re.I))]
_SKIP, _BLOCK, _HEAD = {"script", "style", "nav", "head"}, {"p", "li", "div", "td", "tr", "table"}, {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Scan(HTMLParser):
    """Blocks in document order: ("place", {level: value}), ("title", level, text), ("heading", text), ("row", fields), ("text", text)."""

    def __init__(self, tables: bool = True):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.tables, self.kept, self.depth = tables, [], 0
        self.part: list[str] = []
        self.classes, self.head, self.skip, self.last = set(), False, 0, "chapter"

    def flush(self):
        body, classes, head = re.sub(r"\s+", " ", "".join(self.part)).strip(), self.classes, self.head
        self.part, self.classes = [], set()
        if body:
            self._block(body, classes, head)

    def _block(self, body: str, classes: set, head: bool):
        named = next((level for level, p in _NAMED if p.match(body)), None)
        self.last = named or self.last
        if "oj-sti-art" in classes:
            self.out.append(("title", "article", body))
        elif "oj-ti-section-2" in classes and not named:
            self.out.append(("title", "section" if self.last == "section" else "chapter", body))
        elif "oj-doc-ti" in classes and not named:
            self.out.append(("title", "annex", body))
        elif classes & {"oj-ti-grseq-1", "oj-ti-grseq-2"}:
            part = next(((level, m) for level, p in _PART if (m := p.match(body))), None)
            if part:
                self.out.append(("place", {part[0]: part[1][1]}))
            title = part[1][2].strip() if part else body
            if title:
                self.out.append(("title", part[0] if part else "annex_section", title))
            self.out.append(("heading", body))
        else:
            self.out.append(("heading" if head or named else "text", body))

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.depth:
            self.depth += tag == "table"
            self.kept.append(self.get_starttag_text())
            return
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCK or tag in _HEAD:
            self.flush()
            self.classes = set((given.get("class") or "").split())
        if tag in _HEAD:
            self.head = True
        if tag == "div" and (m := _ID.match(given.get("id") or "")):
            place = {_KINDS[m[1].lower()]: m[2].upper()} | ({"section": m[3].upper()} if m[3] else {})
            self.last = "section" if m[3] else _KINDS[m[1].lower()]
            self.out.append(("place", place))
        if self.tables and tag == "table" and "oj-table" in (given.get("class") or "").split():
            self.depth, self.kept = 1, [self.get_starttag_text()]

    def handle_endtag(self, tag):
        if self.depth:
            self.kept.append(f"</{tag}>")
            self.depth -= tag == "table"
            if not self.depth:
                self._table("".join(self.kept))
            return
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag in _BLOCK or tag in _HEAD:
            self.flush()
        if tag in _HEAD:
            self.head = False

    def _table(self, raw: str):
        rows = list(table_rows(raw))
        kinds = {r["kind"] for r in rows}
        if "definitional" in kinds:
            self.out += [("row", r) for r in rows]
        elif "concordance" not in kinds:
            inner = _Scan(tables=False)
            inner.feed(raw)
            inner.close()
            inner.flush()
            self.out += inner.out

    def handle_data(self, data):
        if self.depth:
            self.kept.append(data.replace("&", "&amp;").replace("<", "&lt;"))
        elif not self.skip:
            self.part.append(data)


def blocks(html: str) -> list[tuple]:
    scan = _Scan()
    scan.feed(html)
    scan.close()
    if scan.depth:  # a table that isn't closed
        scan.depth = 0
        scan._table("".join(scan.kept))
    scan.flush()
    return scan.out


def chunk_official(html: str, budget: Budget) -> Iterator[dict]:
    """Passages of one page with places, titles and the last heading."""
    place: dict[str, str | None] = dict.fromkeys(LEVELS)
    titles: dict[str, str | None] = dict.fromkeys(TITLED)
    row, heading, prefix, held = {"sector": None, "subsector": None}, None, "", []

    def move(level: str, value: str):
        if place[level] == value:
            return
        for lower in (*CLEARS[level], level):
            place[lower] = None
            if lower in titles:
                titles[lower] = None
        place[level] = value

    def flush():
        if held:
            for piece, n_tokens in budget.pieces(" ".join(held)):
                yield {**place, **{f"{t}_title": v for t, v in titles.items()}, **row, "heading": heading, "text": piece, "n_tokens": n_tokens}
            held.clear()

    def marker(body: str) -> tuple[str | None, str, str, str]:
        """The level that a marker moves and its value, the marker, and the text after it; the marker is empty if there's none."""
        in_annex = place["annex"] and not place["article"]
        for kind, p in _ALONE:
            if m := p.match(body):
                if kind == "number":
                    return ("paragraph" if place["article"] else "recital", m[1], body, "") if not in_annex else (None, "", body, "")
                if kind == "litra":
                    return "litra", m[1].lower(), body.lower(), ""
                if kind == "point" and in_annex:
                    return "annex_point", m[1], body, ""
                if kind in ("item", "roman"):
                    return None, kind, body, ""
        for level, p in _INLINE if in_annex else ():
            if m := p.match(body):
                return level, m[1], m[1] + m[2], m[3]
        for level, p in _INNER if place["article"] else ():
            if m := p.match(body):
                return level, m[1].lower(), "", body
        return None, "", "", body

    for kind, *what in blocks(html):
        if kind == "title":
            titles[what[0]] = what[1]
            continue
        if kind != "text":
            yield from flush()
            prefix, row = "", {"sector": None, "subsector": None}
        if kind == "place":
            for level, value in what[0].items():
                move(level, value)
        elif kind == "heading":
            heading = what[0]
            named = next(((level, m[1].upper()) for level, p in _NAMED if (m := p.match(heading))), None)
            if named:
                move(*named)
        elif kind == "row":
            named = {"sector": what[0]["sector"] or None, "subsector": what[0]["subsector"] or None}
            row = named
            held.append(" ".join(f"{label}: {v}" for label, v in (("Sektor", named["sector"]), ("Delsektor", named["subsector"]), ("Type enhed", what[0]["entity"])) if v))
            yield from flush()
            row = {"sector": None, "subsector": None}
        elif kind == "text" and not _DASH.match(what[0]):
            level, value, mark, rest = marker(what[0])
            if level and place[level] != value:
                yield from flush()
                move(level, value)
            elif level is None and value == "roman":
                yield from flush()
                place["litra"] = None
            if mark:
                prefix = f"{prefix} {mark}".strip()
            if rest:
                held.append(f"{prefix} {rest}".strip())
                prefix = ""
    if prefix:
        held.append(prefix)
    yield from flush()
