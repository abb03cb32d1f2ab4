"""Passages of HTML pages, one scan a page, as a table function.

In SQL, after ``register(spark)``::

    SELECT page_id, c.* FROM pages, LATERAL html_passages(html, 'generic', '/path/of/tokenizer.json', 500, 100) c

Defined results: a null or empty page, or one without text, has no passage;
broken markup gives what it holds; no passage holds more tokens than the budget,
whatever its words; a page of any length is read whole; repeated pages give
repeated passages; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T
from . import html, official
from .budget import Budget

_TEXTS = (*official.LEVELS, *(f"{t}_title" for t in official.TITLED), "sector", "subsector", "heading", "text")
SCHEMA = "chunk_index int, " + ", ".join(f"{x} string" for x in _TEXTS) + ", n_tokens int"
#: generic pages know headings and marks in the text; official ones classes and structural ids too.
_LAYOUTS = {"generic": html.chunk_html, "official": official.chunk_official}


@udtf(returnType=SCHEMA, useArrow=False)  # with Arrow each page would make a table of its own
class HtmlPassages:
    """The passages of one page; the tokenizer is loaded once a task."""

    def __init__(self):
        self.budgets: dict[tuple, Budget] = {}

    def eval(self, page: str, layout: str, tokenizer: str, most: int, overlap: int) -> Iterator[tuple]:
        key = (tokenizer, most, overlap)
        if key not in self.budgets:
            self.budgets[key] = Budget(*key)
        for n, found in enumerate(_LAYOUTS[layout](page or "", self.budgets[key])):
            yield (n, *(found.get(x) for x in _TEXTS), found["n_tokens"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_passages", HtmlPassages)


def passages(pages: DataFrame, tokenizer: str, layout: str = "generic", most: int = 500, overlap: int = 100) -> DataFrame:
    """page_id and the passages of pages (page_id, html)."""
    found = HtmlPassages(F.col("html").outer(), F.lit(layout), F.lit(tokenizer), F.lit(most), F.lit(overlap))
    return pages.select("page_id", "html").lateralJoin(found).drop("html")


def identified(rows: DataFrame) -> DataFrame:
    """Passages with location ids, hashes and chunk ids."""
    loc = T.location_id(**{k: F.col(k) for k in html.LEVELS})
    rows = rows.withColumn("location_id", loc).withColumn("text_hash", T.text_hash(F.col("text")))
    return rows.withColumn("chunk_id", T.chunk_id(F.concat(F.lit("page-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.col("location_id"), F.col("chunk_index"), F.col("text_hash")))
