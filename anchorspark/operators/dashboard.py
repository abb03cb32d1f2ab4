"""Bundles of run metrics: overview, performance, drill-downs, counts and the quality of an ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


def newest(runs: DataFrame, by: str = "law", order: tuple[str, ...] = ("ts", "run_id")) -> DataFrame:
    """The latest run of each law or suite; runs: law, run_id, ts, run_mode, total, passed."""
    return metrics.latest(runs, [by], [F.desc(c) for c in order])


def recent(runs: DataFrame, law: str | None = None, n: int = 10) -> DataFrame:
    """The newest n runs, of one law or of all."""
    rows = runs if law is None else runs.where(F.col("law") == law)
    return rows.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)


def distinct_runs(*parts: DataFrame) -> DataFrame:
    """Runs of several scans, each once by its law, time and id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["law", "ts", "run_id"])


def overview(single: DataFrame, cross: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: unified rate, health, counts and rates of both kinds, mean rates of groups, latest time, ingestion coverage.

    single, cross: newest runs (law, total, passed, ts); coverage: corpus_id, pct.
    """
    both = single.select("total", "passed", "ts", F.lit(0).alias("kind")).unionByName(cross.select("total", "passed", "ts", F.lit(1).alias("kind")))
    rate = lambda p, n: F.round(F.coalesce(F.when(n > 0, 100.0 * p / n), F.lit(0.0)), 2)
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    group = lambda k: F.round(F.coalesce(F.avg(F.when((F.col("kind") == k) & (F.col("total") > 0), 100.0 * F.col("passed") / F.col("total"))), F.lit(0.0)), 2)
    unified = rate(F.sum("passed"), F.sum("total"))
    runs = both.agg(
        unified.alias("unified"), metrics.health(F.coalesce(F.when(F.sum("total") > 0, 100.0 * F.sum("passed") / F.sum("total")), F.lit(0.0))).alias("health"), F.coalesce(F.sum("total"), F.lit(0)).alias("cases"),
        F.count_if(F.col("kind") == 0).alias("laws"), F.count_if(F.col("kind") == 1).alias("suites"), F.max("ts").alias("last_run"),
        rate(of("passed", 0), of("total", 0)).alias("single_rate"), rate(of("passed", 1), of("total", 1)).alias("cross_rate"), group(0).alias("single_group_rate"), group(1).alias("cross_group_rate"),
    )
    mean = F.coalesce(F.avg(F.when(F.col("pct") > 0, F.col("pct"))), F.lit(0.0))
    ingested = coverage.agg(F.round(mean, 2).alias("coverage"), metrics.health(mean).alias("ingestion_health"), F.count_if(F.coalesce(F.col("pct"), F.lit(0.0)) <= 0).alias("without_coverage"))
    return runs.crossJoin(F.broadcast(ingested))  # one row each


def run_modes(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("run_mode", F.lit("unknown")).alias("run_mode")).agg(F.sum("total").alias("cases"))


def performance(cases: DataFrame, by: str) -> DataFrame:
    """Of each value of by, and of all as null: cases with a duration, and percentiles in seconds; cases: duration_ms and by."""
    timed = cases.where("duration_ms > 0")
    rows = timed.where(F.col(by).isNotNull()).select(F.struct(F.lit(False).alias("all"), F.col(by).alias("v")).alias("g"), "duration_ms").unionByName(timed.select(F.struct(F.lit(True).alias("all"), F.lit(None).cast(timed.schema[by].dataType).alias("v")).alias("g"), "duration_ms"))
    at = metrics.quantiles(rows, ["g"], "duration_ms", (0.5, 0.95, 0.99))
    n = rows.groupBy("g").agg(F.count("*").alias("cases"))
    return at.join(n, "g").select(F.col("g.v").alias(by), "cases", *(F.round(F.col(f"p{i}") / 1000.0, 3).alias(f"p{p}") for i, p in enumerate((50, 95, 99))))


def drill_down(results: DataFrame, where: Column, by: str) -> DataFrame:
    """Cases, passed and rate by a column, of the results under a filter."""
    rate = metrics.pass_rate(F.col("passed").cast("int"), F.lit(1))
    return results.where(where).where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("passed").cast("boolean")).alias("passed"), F.round(rate, 2).alias("pass_rate"))


def badge_counts(results: DataFrame) -> DataFrame:
    """Per law: cases, passed, escalated, escalated and passed, of its latest results (law, passed, escalated)."""
    return results.groupBy("law").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if("escalated").alias("escalated"), F.count_if(F.col("escalated") & F.col("passed")).alias("esc_passed"))


def preflight_summary(handled: Column, unhandled: Column) -> Column:
    """One line from two arrays of (name, n), in their order."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.transform(c, lambda x: F.concat(x["n"].cast("string"), F.lit("x "), x["name"])), ", ")))
    return F.coalesce(F.nullif(F.concat_ws(" | ", part("Handled: ", handled), part("⚠️ Unhandled: ", unhandled)), F.lit("")), F.lit("No structures detected"))


def ingestion_quality(handled: Column, unhandled: Column, coverage: Column) -> Column:
    """unhandled_count, unhandled_pct and structure_coverage_pct from two maps of counts; percentages to one place."""
    total = lambda m: F.aggregate(F.map_values(F.coalesce(m, F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n, missed = total(handled) + total(unhandled), total(unhandled)
    return F.struct(missed.alias("unhandled_count"), F.round(F.when(n > 0, 100.0 * missed / n).otherwise(0.0), 1).alias("unhandled_pct"), F.round(F.coalesce(coverage, F.lit(0.0)), 1).alias("structure_coverage_pct"))


def breakdown(stages: DataFrame) -> DataFrame:
    """A pipeline's counts by stage for each query (query_id, stage, n, score), which always pass; the best vector distance is the first score."""
    n = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("n"))), F.lit(0))
    names = {"vector": "retrieved", "expansion": "injected", "rerank": "scored", "selection": "selected"}
    return stages.groupBy("query_id").agg(*(n(s).alias(c) for s, c in names.items()), F.max(F.when(F.col("stage") == "rerank", F.col("score"))).alias("best"), F.lit(True).alias("passed"), F.lit(1.0).alias("score"))


def cached(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows with their stored result, rows that must be computed) by key."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")

