"""Citation checks and scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def used_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """References that an answer cites by [n], each chunk once at its first position."""
    cited = answers.select("query_id", F.posexplode(T.bracket_citations(F.col("answer"))).alias("pos", "idx"))
    hit = cited.join(references, ["query_id", "idx"])
    return hit.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("pos"))).where("r = 1").drop("r")


def contract_violations(answer: Column, structured: Column, lines: Column, least: int | None = None, most: int | None = None, extra_allowed: bool = False) -> Column:
    """Codes of the citation rules that an answer breaks, in a fixed order; structured and lines are its references' numbers.

    Citations without any structured reference end the check.
    """
    cited = T.bracket_citations(answer)
    structured, lines = (F.filter(F.coalesce(x, F.array().cast("array<int>")), lambda i: i > 0) for x in (structured, lines))
    n, none = F.size(cited), F.lit(None).cast("string")
    paragraphs = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 0)
    bare = F.exists(paragraphs, lambda p: T.is_normative(p) & ~p.rlike(r"\[\d{1,3}\]"))
    first = [("NORMATIVE_WITHOUT_BRACKET_CITATION", bare), ("MIN_CITATIONS_NOT_MET", F.lit(least is not None and least >= 0) & (n < (least or 0)))]
    unsupported = (n > 0) & (F.size(structured) == 0)
    rest = [
        ("CITED_IDX_MISSING_IN_STRUCTURED", F.size(F.array_except(cited, structured)) > 0),
        ("CITATIONS_NO_MATCHING_REFS", (n > 0) & ~F.arrays_overlap(cited, structured)),
        ("UNCITED_STRUCTURED_REFS", F.lit(not extra_allowed) & (F.size(F.array_except(structured, cited)) > 0)),
        ("MAX_CITATIONS_EXCEEDED", F.lit(most is not None and most >= 0) & (n > (most or 0))),
        ("REN_NUMBERING_MISMATCH", (n > 0) & (F.size(lines) > 0) & (F.size(F.array_except(cited, lines)) > 0)),
    ]
    codes = [*first, ("CITATIONS_WITHOUT_STRUCTURED_REFS", unsupported), *((c, ~unsupported & t) for c, t in rest)]
    return F.array_compact(F.array(*(F.when(test, F.lit(code)).otherwise(none) for code, test in codes)))


def anchor_score(found: Column, any_of: Column, any_of_2: Column, all_of: Column, none_of: Column) -> Column:
    """(passed, score): one of each any-list, all of the all-list, none of the last; the share of expected anchors found."""
    ok = lambda a: (F.size(a) == 0) | F.arrays_overlap(found, a)
    passed = ok(any_of) & ok(any_of_2) & (F.size(F.array_except(all_of, found)) == 0) & ~F.arrays_overlap(found, none_of)
    expected = F.array_distinct(F.concat(any_of, any_of_2, all_of))
    share = F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(expected)).otherwise(F.lit(1.0))
    return F.struct(passed.alias("passed"), share.alias("score"))


def coverage(cited: Column, required: Column, share: float = 1.0) -> Column:
    """(passed, score) of the required corpora that are cited."""
    score = F.when(F.size(required) > 0, F.size(F.array_intersect(required, cited)) / F.size(required)).otherwise(F.lit(1.0))
    return F.struct((score >= share).alias("passed"), score.alias("score"))


def balance(counts: DataFrame, by: str, item: str, n: str, most: float = 0.70) -> DataFrame:
    """(passed, score) per answer: no item may have more than most of the citations; score 1 - share over the limit."""
    g = counts.groupBy(by).agg(F.sum(n).alias("total"), F.max(n).alias("top"), F.max_by(item, F.struct(F.col(n), -F.col(item))).alias("dominant"))
    share = F.col("top") / F.col("total")
    return g.select(by, "dominant", (share <= most).alias("passed"), F.when(share <= most, F.lit(1.0)).otherwise(1.0 - share).alias("score"))


def precision_recall(expected: Column, actual: Column) -> Column:
    both = F.size(F.array_intersect(expected, actual))
    return F.struct((F.when(F.size(actual) > 0, both / F.size(actual)).otherwise(F.lit(0.0))).alias("precision"), (F.when(F.size(expected) > 0, both / F.size(expected)).otherwise(F.lit(1.0))).alias("recall"))


def consistency(runs: DataFrame, by: str, roles: str, least: float = 0.8) -> DataFrame:
    """1 - (distinct answers - 1) / (runs - 1), whatever the order within an answer."""
    g = runs.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(F.array_sort(roles)).alias("u"))
    score = F.when(F.col("n") > 1, 1 - (F.col("u") - 1) / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return g.select(by, score.alias("score"), (score >= least).alias("passed"))


def abstention(answer: Column, definitive: list[str], indicators: list[str]) -> Column:
    """(passed, score): definitive wording fails, an indicator passes fully, anything else at 0.7."""
    score = F.when(T.contains_any(answer, definitive), 0.0).when(T.contains_any(answer, indicators), 1.0).otherwise(0.7)
    return F.struct((score >= 0.7).alias("passed"), score.alias("score"))
