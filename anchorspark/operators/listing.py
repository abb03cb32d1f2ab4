"""Acts found by a part of their title or number, their year, kind and force.

Titles are indexed by their trigrams, lower-case, each with and without blanks.
A term can be a part of a title only if the title has all of the term's
trigrams, so one of them, that which the fewest acts have, is joined; the acts
that it gives are then compared in full.  A term of one or two letters has no
trigram: such terms, a part of the stated questions, are held against all acts.

Defined results: null titles match nothing; an act needs a Danish or an English
title; a blank or null term matches every act of the years and kind; an act
whose force isn't known counts as in force; years out of order match nothing;
rows that repeat an act give it once for a question, and an empty table on
either side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The languages of titles, those also searched without blanks, and the letters of kinds in an act's number.
LANGUAGES, UNSPACED = ("da", "en", "de", "fr"), ("da", "en")
LETTERS = {"all": "RL", "regulation": "R", "directive": "L"}
_GRAM = 3


def _bare(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def _forms(acts: str = "") -> list[Column]:
    c = lambda name: F.col(f"{acts}{name}")
    return [*(F.lower(c(f"title_{x}")) for x in LANGUAGES), *(_bare(c(f"title_{x}")) for x in UNSPACED), F.lower(c("celex"))]


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= _GRAM, F.transform(F.sequence(F.lit(1), F.length(text) - (_GRAM - 1)), lambda i: F.substr(text, i, F.lit(_GRAM)))).otherwise(F.array().cast("array<string>"))


def listed(acts: DataFrame) -> DataFrame:
    """Acts (celex, title_da, title_en, title_de, title_fr, date, in_force) that can be listed, each once, with year and kind of their number."""
    number = r"^3(\d{4})([RL])[0-9]+$"
    rows = acts.where(F.col("celex").rlike(number) & F.coalesce("title_da", "title_en").isNotNull())
    once = rows.groupBy("celex").agg(F.min_by(F.struct(*(c for c in acts.columns if c != "celex")), F.struct(F.col("date").isNull(), -F.unix_date(F.col("date").cast("date")), F.coalesce("title_da", "title_en"))).alias("a")).select("celex", "a.*")
    return once.withColumns({"year": F.regexp_extract("celex", number, 1).cast("int"), "letter": F.regexp_extract("celex", number, 2)})


def index(acts: DataFrame) -> DataFrame:
    """(gram, celex) of listed acts, each once."""
    grams = F.array_distinct(F.flatten(F.array(*(_grams(F.coalesce(f, F.lit(""))) for f in _forms()))))
    return acts.select("celex", F.explode(grams).alias("gram"))


def search(acts: DataFrame, grams: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, celex, title, date, in_force, rank), the newest first, for questions (query_id, term, year_from, year_to, kind, in_force_only).

    acts are listed() ones and grams their index().
    """
    asked = questions.withColumn("term", F.lower(F.trim(F.coalesce("term", F.lit("")))))
    parts = asked.select("query_id", F.explode(F.array_distinct(_grams(_bare(F.col("term"))))).alias("gram")).where(F.length("gram") == _GRAM)
    seen = parts.select("gram").distinct().join(grams, "gram").groupBy("gram").agg(F.count("*").alias("seen"))
    # a gram across a blank of the term is in no spaced title, so the rarest is taken among those within its words first
    inner = asked.select("query_id", F.explode(F.split("term", " +")).alias("word")).select("query_id", F.explode(F.array_distinct(_grams(F.col("word")))).alias("gram"))
    by_word = inner.join(seen, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("seen", F.lit(0)), F.col("gram"))).alias("gram"))
    narrow = by_word.join(grams, "gram").select("query_id", "celex")
    wide = asked.join(by_word, "query_id", "left_anti").select("query_id").join(acts.select("celex"))  # stated questions without a word of three letters
    met = narrow.union(wide).join(asked, "query_id").join(acts, "celex")
    term = F.col("term")
    matches = reduce(lambda a, b: a | b, (F.coalesce(f.contains(_bare(term) if n in (4, 5) else term), F.lit(False)) for n, f in enumerate(_forms())))
    letters = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv)), F.lower(F.coalesce("kind", F.lit("all")))), F.lit(LETTERS["all"]))
    fits = F.col("year").between(F.col("year_from"), F.col("year_to")) & F.contains(letters, F.col("letter")) & (~F.coalesce("in_force_only", F.lit(False)) | F.coalesce("in_force", F.lit(True)))
    rows = met.where(matches & fits).select("query_id", "celex", F.coalesce("title_da", "title_en").alias("title"), "date", "in_force")
    return rows.withColumn("rank", F.expr("row_number() over (partition by query_id order by date desc nulls last, celex)"))
