"""What a page holds that chunking handles and what it doesn't, counted in one pass over its tags.

The open tags are kept as a stack, so that depths and enclosures are known
where an element begins; a row's table is the innermost one around it.

Defined results: a null or empty page counts nothing; tags that are never
closed count where they open; elements that close twice close once; names and
classes are matched whatever their case, but for the class of journal tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_tables import table_rows

# The ids and classes that mark structure, and what is counted under which name.
IDS = [("articles", re.compile(r"^art_\d+", re.I)), ("chapters", re.compile(r"^cpt_", re.I)), ("annexes", re.compile(r"^anx_", re.I))]
NOTE_CLASS, HEADER_CLASS = re.compile(r"footnote|endnote|note", re.I), re.compile(r"hdr|header", re.I)
HANDLED = {"p": "paragraphs", "li": "list_items", "blockquote": "blockquote"}
UNHANDLED = {"figure": "figure", "pre": "code_block", "code": "code_block", "math": "math_formula", "mrow": "math_formula", "msub": "math_formula", "msup": "math_formula"}
SEVERITY = {"unclassified_table": "warning", "suspicious_table": "warning", "figure": "warning", "math_formula": "warning", "deep_nested_list": "info", "image_with_alt": "info", "definition_list": "info", "code_block": "info"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LEAST_ROWS, _DEEPEST = 3, 3


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.handled: Counter = Counter()
        self.unhandled: Counter = Counter()
        self.open: list[tuple[str, dict | None]] = []  # with what is known of a table
        self.kept: list[str] = []  # the markup of the outermost journal table
        self.lists = self.terms = 0  # of definitions

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        journal = tag == "table" and "oj-table" in classes
        if journal or self.kept:
            self.kept.append(self.get_starttag_text())
        if tag == "div":
            for name, form in IDS:
                self.handled[name] += bool(form.search(given.get("id") or ""))
        if any(NOTE_CLASS.search(c) for c in classes):
            self.handled["footnotes"] += 1
        if tag in HANDLED:
            self.handled[HANDLED[tag]] += 1
        if tag in UNHANDLED:
            self.unhandled[UNHANDLED[tag]] += 1
        if tag == "img" and (given.get("alt") or "").strip():
            self.unhandled["image_with_alt"] += 1
        if tag == "ul" and sum(t == "ul" for t, _ in self.open) >= _DEEPEST:
            self.unhandled["deep_nested_list"] += 1
        if tag == "tr":
            for t, about in self.open:
                if t == "table":
                    about["rows"] += 1
        if tag == "th" or (tag == "td" and any(HEADER_CLASS.search(c) for c in classes)):
            for t, about in self.open:
                if t == "table":
                    about["headed"] = True
        self.lists += tag == "dl"
        self.terms += tag == "dt" and any(t == "dl" for t, _ in self.open)
        if tag not in _VOID:
            inside = any(t == "table" and about["journal"] for t, about in self.open)
            about = {"rows": 0, "headed": False, "journal": journal, "inside": inside, "from": len(self.kept) - 1} if tag == "table" else None
            self.open.append((tag, about))

    def handle_endtag(self, tag):
        if self.kept:
            self.kept.append(f"</{tag}>")
        if any(t == tag for t, _ in self.open):
            while True:
                last, about = self.open.pop()
                self._closed(last, about)
                if last == tag:
                    break

    def handle_data(self, data):
        if self.kept:
            self.kept.append(data.replace("&", "&amp;").replace("<", "&lt;"))

    def _closed(self, tag: str, about: dict | None):
        if tag == "table" and about["journal"]:
            kinds = {r["kind"] for r in table_rows("".join(self.kept[about["from"] :]))}
            kind = next((k for k in ("concordance", "definitional") if k in kinds), None)
            if kind:
                self.handled[f"{kind}_table"] += 1
            elif about["rows"] >= _LEAST_ROWS:
                self.unhandled["unclassified_table"] += 1
            if not about["inside"]:
                self.kept.clear()
        elif tag == "table" and not about["inside"] and about["headed"] and about["rows"] >= _LEAST_ROWS:
            self.unhandled["suspicious_table"] += 1

    def finish(self):
        self.close()
        while self.open:
            self._closed(*self.open.pop())
        self.unhandled["definition_list"] += self.lists if self.terms else 0


def counted(page: str) -> tuple[dict[str, int], dict[str, int]]:
    """(handled, unhandled) of one page."""
    tags = _Tags()
    tags.feed(page)
    tags.finish()
    return dict(+tags.handled), dict(+tags.unhandled)


def preflight(pages: DataFrame) -> DataFrame:
    """page_id, handled and unhandled (maps of name to count), and warnings (category, severity, count) of pages (page_id, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    counts = pa.map_(pa.string(), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(h or "") for h in batch.column(1).to_pylist()]
            columns = [pa.array([sorted(f[k].items()) for f in found], counts) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "handled", "unhandled"])

    rows = pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, handled map<string,bigint>, unhandled map<string,bigint>")
    return rows.withColumn("warnings", warnings(F.col("unhandled")))


def warnings(unhandled: Column) -> Column:
    """A warning for each kind of structure that isn't handled, warnings before notes, then by name."""
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    rows = F.transform(F.map_entries(unhandled), lambda e: F.struct((severity[e["key"]] != "warning").alias("minor"), e["key"].alias("category"), severity[e["key"]].alias("severity"), e["value"].alias("count")))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["category"].alias("category"), r["severity"].alias("severity"), r["count"].alias("count")))
