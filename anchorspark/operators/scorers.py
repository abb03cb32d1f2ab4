"""Pluggable scorers: functions from cases to (case_id, passed, score), known by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import validate

Scorer = Callable[[DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Make a scorer known under a name; a name can be taken once."""

    def add(f: Scorer) -> Scorer:
        if name in SCORERS:
            raise ValueError(f"there is a scorer {name} already")
        SCORERS[name] = f
        return f

    return add


@scorer("anchor_presence")
def anchor_presence(cases: DataFrame) -> DataFrame:
    """cases: found, any_of, any_of_2, all_of, none_of."""
    s = validate.anchor_score(F.col("found"), F.col("any_of"), F.col("any_of_2"), F.col("all_of"), F.col("none_of"))
    return cases.select("case_id", s.alias("s")).select("case_id", "s.passed", "s.score")


@scorer("corpus_coverage")
def corpus_coverage(cases: DataFrame) -> DataFrame:
    """cases: cited_corpora, required_corpora."""
    return cases.select("case_id", validate.coverage(F.col("cited_corpora"), F.col("required_corpora")).alias("s")).select("case_id", "s.passed", "s.score")


def run(cases: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(case_id, scorer, passed, score) of the named scorers, or of all."""
    chosen = sorted(SCORERS) if names is None else names
    return reduce(DataFrame.unionByName, (SCORERS[n](cases).select("case_id", F.lit(n).alias("scorer"), "passed", "score") for n in chosen))
