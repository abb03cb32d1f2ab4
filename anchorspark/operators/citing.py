"""References behind what an answer names, and what was measured of an answer's citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import text as T
from . import rank


def mentioned_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, chunk_id, position): references behind the places that an answer names in words, each chunk once, in order.

    An article with a paragraph takes the first reference of that paragraph, else
    of the article; references: query_id, idx, chunk_id, article, paragraph, recital, annex.
    """
    named = answers.select("query_id", F.posexplode(R.anchor_mentions(F.col("answer"))).alias("pos", "m")).select("query_id", "pos", "m.kind", "m.value", "m.paragraph")
    clean = lambda c: F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit(""))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), clean(k).alias("value")) for k in ("article", "recital", "annex")))
    places = references.select("query_id", "idx", "chunk_id", clean("paragraph").alias("of_paragraph"), F.explode(kinds).alias("k")).select("query_id", "idx", "chunk_id", "of_paragraph", "k.kind", "k.value").where("value is not null")
    hit = named.join(places, ["query_id", "kind", "value"]).withColumn("exact", F.coalesce(F.col("paragraph") == F.col("of_paragraph"), F.lit(False)))
    best = rank.top_k(hit, ["query_id", "pos"], [F.when(F.col("paragraph").isNotNull() & F.col("exact"), 0).otherwise(1).asc(), F.asc("idx")], 1).drop("rank")
    best = best.where("length(chunk_id) > 0")
    once = best.groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
    return rank.top_k(once, ["query_id"], [F.asc("pos")], 10_000, "position").select("query_id", "chunk_id", "position")


def answer_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, chunk_id, by): references by number in brackets; for answers without such a number, by the places they name."""
    cited = answers.select("query_id", F.posexplode(T.bracket_citations(F.col("answer"))).alias("pos", "idx")).join(references.select("query_id", "idx", "chunk_id"), ["query_id", "idx"])
    by_number = cited.select("query_id", "chunk_id").distinct().withColumn("by", F.lit("number"))
    rest = answers.join(by_number.select("query_id").distinct(), "query_id", "left_anti")
    return by_number.unionByName(mentioned_references(rest, references).select("query_id", "chunk_id", F.lit("name").alias("by")))


def gate_reason(answer: Column, reason: Column, least: Column, allowed: Column) -> Column:
    """Why an answer is only MISSING_REF; null for any other answer."""
    valid = F.size(F.array_intersect(T.bracket_citations(answer), allowed))
    few = (F.coalesce(least, F.lit(0)) > 0) & (F.size(allowed) >= least) & (valid < least)
    given = F.nullif(F.trim(reason), F.lit(""))
    why = F.when(F.lower(given) == "min_citations_not_met", "MIN_CITATIONS_NOT_MET").when(given.isNotNull(), F.upper(given)).when(few, "MIN_CITATIONS_NOT_MET").otherwise("MISSING_REF")
    return F.when(F.trim(answer) == "MISSING_REF", why)


def citation_telemetry(answer: Column, allowed: Column, reason: Column, least: Column) -> Column:
    """cited and valid numbers, citations as written, the flag of insufficient evidence and the gate's reason."""
    body = F.substring_index(F.coalesce(answer, F.lit("")), "\nReferencer:\n", 1)
    cited = T.bracket_citations(body)
    return F.struct(
        cited.alias("cited"), F.array_sort(F.array_intersect(cited, allowed)).alias("valid"), F.size(F.regexp_extract_all(body, F.lit(r"\[(\d{1,3})\]"), F.lit(0))).alias("written"),
        T.whole_word(body, "utilstrækkelig_evidens").alias("insufficient"), gate_reason(answer, reason, least, allowed).alias("gate"),
    )


def padded_citations(given: Column, allowed: Column, least: Column) -> Column:
    """Valid citations filled up, in order, from the first allowed numbers until there are least of them."""
    valid = F.array_intersect(given, allowed)
    return F.concat(valid, F.slice(F.array_except(allowed, valid), F.lit(1), F.greatest(least - F.size(valid), F.lit(0))))


def source_litras(pages: DataFrame) -> DataFrame:
    """(source, article, paragraph, litras) of official pages (source, html): the letters in brackets, set in italics, of each paragraph's division."""
    parts = F.filter(F.split("html", r'(?=<div[^>]*\bid="\d{3}\.\d{3}")'), lambda x: x.rlike(r'^<div[^>]*\bid="\d{3}\.\d{3}"'))
    rows = pages.select("source", F.explode(parts).alias("part"))
    number = lambda g: F.regexp_extract("part", r'^<div[^>]*\bid="(\d{3})\.(\d{3})"', g).cast("int")
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all("part", F.lit(r'<span[^>]*class="(?:[^"]*\s)?oj-italic(?:\s[^"]*)?"[^>]*>\s*\(([a-z])\)\s*</span>'), F.lit(1))))
    return rows.select("source", number(1).alias("article"), number(2).alias("paragraph"), letters.alias("litras")).where("size(litras) > 0")


def litra_addressable(chunks: DataFrame, litras: DataFrame) -> DataFrame:
    """chunk_id, ok and reason: a letter counts only if the text, the location and the official page all show it.

    chunks: chunk_id, source, article, paragraph, litra, location_id, text.
    """
    v = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = chunks.select("chunk_id", "source", v("article").alias("a"), v("paragraph").alias("p"), F.lower(v("litra")).alias("l"), F.lower(v("location_id")).alias("loc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("article", F.nullif(F.regexp_extract("a", r"^(\d{1,3})", 1), F.lit("")).cast("int")).withColumn("paragraph", F.nullif(F.regexp_extract("p", r"^(\d{1,3})$", 1), F.lit("")).cast("int"))
    rows = rows.join(litras, ["source", "article", "paragraph"], "left")
    whole = (F.col("a") != "") & (F.col("p") != "") & (F.col("l") != "")
    named = F.exists(F.regexp_extract_all(F.lower("text"), F.lit(r"(?:^|(?<=\s))(\S+)\)(?=\s)"), F.lit(1)), lambda x: x == F.col("l"))
    located = F.array_contains(F.transform(F.split("loc", "/"), lambda p: F.trim(p)), F.concat(F.lit("article:"), F.lower("a")))
    proven = F.coalesce(F.array_contains("litras", F.col("l")), F.lit(False))
    reason = F.when(~whole, "missing_article_or_paragraph_or_litra").when(~named, "no_litra_evidence_in_chunk").when(~located, "location_id_article_mismatch").when(~proven, "litra_not_proven_in_html")
    return rows.select("chunk_id", reason.isNull().alias("ok"), reason.alias("reason"))


def fallback_references(scored: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, chunk_id, position): references for an answer that cites none: articles before recitals before annexes,
    each by overlap with the question, then, where there is overlap, by number, else as retrieved; one for each place.

    scored: query_id, idx, chunk_id, article, recital, annex, overlap.
    """
    set_ = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = scored.withColumn("kind", F.when(set_("article").isNotNull(), 0).when(set_("recital").isNotNull(), 1).when(set_("annex").isNotNull(), 2)).where("kind is not null and length(chunk_id) > 0")
    rows = rows.withColumn("place", F.coalesce(set_("article"), set_("recital"), set_("annex")))
    number = F.when((F.col("overlap") > 0) & (F.col("kind") < 2), F.expr("try_cast(place as int)"))
    order = [F.asc("kind"), F.desc("overlap"), F.asc_nulls_last("number"), F.asc("idx")]
    first = rank.top_k(rows.withColumn("number", number), ["query_id", "kind", "place"], order, 1).drop("rank")
    return rank.top_k(first, ["query_id"], order, most, "position").select("query_id", "chunk_id", "position")
