"""Rows of HTML tables as a grid: cells that span rows are carried down their column."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "page_id long, table_index int, row_index int, kind string, cells array<string>, sector string, subsector string, entity string"


class _Tables(HTMLParser):
    """Tables in document order, each a list of rows of (text, rowspan); a table within a cell is text of that cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int]]]] = []
        self.depth, self.cell, self.span = 0, None, 1

    def _close(self):
        if self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append((re.sub(r"\s+", " ", "".join(self.cell)).strip(), self.span))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self._close()
            span = dict(attrs).get("rowspan") or "1"
            self.cell, self.span = [], max(1, int(span)) if span.isdecimal() else 1
        elif self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self._close()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def grid(rows: list[list[tuple[str, int]]]) -> list[list[str]]:
    """Rows of texts in which a cell that spans rows stands in each of them."""
    open_cells: dict[int, tuple[str, int]] = {}  # column: text, rows left
    out = []
    for row in rows:
        line, given = [], iter(row)
        while True:
            column = len(line)
            if column in open_cells:
                text, left = open_cells.pop(column)
            elif (cell := next(given, None)) is not None:
                text, left = cell
            else:
                break
            line.append(text)
            if left > 1:
                open_cells[column] = (text, left - 1)
        out.append(line)
    return out


def table_kind(header: list[str]) -> str:
    """concordance (one act's places against another's), definitional (sectors and kinds of entity), or other."""
    low = [h.lower() for h in header]
    if len(low) == 2 and any("direktiv" in h for h in low) and any("nærværende" in h for h in low):
        return "concordance"
    if len(low) >= 3 and "sektor" in low[0] and ("delsektor" in low[1] or "type" in low[2]):
        return "definitional"
    return "other"


def table_rows(html: str) -> Iterator[dict]:
    """Rows below the header of each table of two rows or more; definitional tables also give sector, subsector and entity,
    without rows that lack an entity."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    for t, rows in enumerate(parser.tables):
        lines = grid(rows)
        if len(lines) < 2:
            continue
        kind = table_kind(lines[0])
        for r, line in enumerate(lines[1:], 1):
            named = (line + ["", "", ""])[:3] if kind == "definitional" else [None] * 3
            if line and (kind != "definitional" or named[2]):
                yield {"table_index": t, "row_index": r, "kind": kind, "cells": line, "sector": named[0], "subsector": named[1], "entity": named[2]}


def page_tables(pages: DataFrame) -> DataFrame:
    """table_rows of pages (page_id, html); null and broken markup give what rows they hold."""

    def run(frames):
        for pdf in frames:
            rows = [{"page_id": p, **r} for p, h in zip(pdf["page_id"], pdf["html"], strict=True) for r in table_rows(h or "")]
            if rows:
                yield pd.DataFrame(rows)

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)
