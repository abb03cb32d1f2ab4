"""Aggregates over evaluation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import new_folder, stored


def pass_rate(passed: Column, total: Column) -> Column:
    """Passed over all in per cent; zero without any."""
    return F.coalesce(F.when(F.sum(total) > 0, 100.0 * F.sum(passed) / F.sum(total)), F.lit(0.0))


def macro_rate(groups: DataFrame) -> DataFrame:
    """The mean of the groups' rates (passed, total), groups without cases left out."""
    return groups.agg(F.bround(F.avg(F.when(F.col("total") > 0, 100.0 * F.col("passed") / F.col("total"))), 2).alias("macro_rate"))


def quantiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...], interpolated: bool = True, buckets: int = 4096) -> DataFrame:
    """by and p0, p1, ... for each of at: the value at rank p * (n - 1), between two ranks interpolated or the lower one.

    Values are counted in equal steps of each group's span; only those of the
    steps that hold a wanted rank are looked at one by one, as distinct values
    with counts, so no task gets a group.  df is read three times: for the
    spans, for the counts, and for the values looked at.
    """
    names = [f"g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, names, strict=True)), F.col(value).cast("double").alias("v"))
    same = lambda x, y, cols: reduce(lambda a, b: a & b, (F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in cols), F.lit(True))
    folder = new_folder(df.sparkSession, "quantiles")
    span = stored(rows.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")), f"{folder}/span")  # a row a group
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / buckets)), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    placed = rows.alias("r").join(span.alias("s"), same("r", "s", names)).select(*(F.col(f"r.{c}") for c in names), "v", step.alias("b"))
    counts = placed.groupBy(*names, "b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over at most so many buckets
    counts = counts.withColumn("before", before)
    exact = [F.lit(p) * (F.col("n") - 1) for p in at]
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(x) if up else F.floor(x)).alias("r")) for i, x in enumerate(exact) for up in (0, 1)))
    wanted = span.select(*names, F.explode(wanted).alias("w")).select(*names, "w.*")
    spots = wanted.alias("w").join(counts.alias("c"), same("w", "c", names) & (F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("c.c")))
    spots = stored(spots.select(*(F.col(f"w.{c}") for c in names), "i", "up", "b", (F.col("r") - F.col("before")).alias("r")), f"{folder}/spots")
    near = placed.alias("p").join(spots.select(*names, "b").distinct().alias("t"), same("p", "t", [*names, "b"]), "left_semi")
    near = near.groupBy(*names, "b", "v").agg(F.count("*").alias("c"))
    near = near.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*names, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = spots.alias("w").join(near.alias("c"), same("w", "c", [*names, "b"]) & (F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("c.c")))
    got = found.select(*(F.col(f"w.{c}") for c in names), "i", "up", "v").groupBy(*names).agg(*(F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("v"))).alias(f"v{i}{up}") for i in range(len(at)) for up in (0, 1)))
    got = got.alias("a").join(span.alias("s"), same("a", "s", names)).select(*(F.col(f"a.{k}").alias(c) for k, c in zip(names, by, strict=True)), *(f"v{i}{up}" for i in range(len(at)) for up in (0, 1)), "n")
    share = [x - F.floor(x) for x in exact]
    value_at = lambda i: F.col(f"v{i}0") + (F.col(f"v{i}1") - F.col(f"v{i}0")) * share[i] if interpolated else F.col(f"v{i}0")
    return got.select(*by, *(value_at(i).alias(f"p{i}") for i in range(len(at))))


def percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Interpolated percentiles, milliseconds to seconds."""
    got = quantiles(df.withColumn("all", F.lit(0)), ["all"], value, at)
    return got.select(*(F.round(F.col(f"p{i}") / 1000.0, 3).alias(f"p{round(100 * a)}") for i, a in enumerate(at)))


def floor_rank(df: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The value at rank floor(p * (n - 1)) of each group."""
    return quantiles(df, [by], value, at, interpolated=False).select(by, *(F.col(f"p{i}").alias(f"p{round(100 * a)}") for i, a in enumerate(at)))


def median(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    return quantiles(df, [by], value, (0.5,)).select(by, F.col("p0").alias(name))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins are given too, and equal values fill one bin."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo is not null")  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins))).otherwise(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = span.select(F.explode(F.sequence(F.lit(1), F.when(F.col("hi") > F.col("lo"), F.lit(bins)).otherwise(F.lit(1)))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def health(rate: Column) -> Column:
    return F.when(rate >= 95, "excellent").when(rate >= 80, "good").when(rate >= 60, "fair").otherwise("poor")


def trend(runs: DataFrame, by: str, threshold: float = 2.0, trail: int = 5) -> DataFrame:
    """Latest rate against the mean of the up to five runs before it."""
    w = Window.partitionBy(by).orderBy("ts", "run_id")
    rows = runs.withColumn("before", F.avg("rate").over(w.rowsBetween(-trail, -1))).withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("run_id")))).where("r = 1")
    d = F.col("rate") - F.col("before")
    return rows.select(by, F.bround(d, 2).alias("change"), F.when(F.col("before").isNull(), "insufficient").when(d > threshold, "improving").when(d < -threshold, "declining").otherwise("stable").alias("direction"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("r = 1").drop("r")


def threshold_sweep(best: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """Per threshold: answered, abstained, and newly answered against the threshold before; by integer steps."""
    n = round((stop - start) / step)
    first = F.greatest(F.ceil((F.col("best") - start) / step - 1e-9), F.lit(0)).cast("int")  # the first step that answers
    hist = best.groupBy(first.alias("i")).agg(F.count("*").alias("newly"))
    total = best.agg(F.count("*").alias("total"))
    steps = best.sparkSession.range(0, n + 1).select(F.col("id").cast("int").alias("i"))
    rows = steps.join(hist, "i", "left").fillna(0, ["newly"]).crossJoin(F.broadcast(total))
    answered = F.sum("newly").over(Window.orderBy("i"))  # over the steps, not over the input
    return rows.withColumn("answered", answered).select(F.round(start + F.col("i") * step, 10).alias("threshold"), "answered", (F.col("total") - F.col("answered")).alias("abstained"), "newly")
