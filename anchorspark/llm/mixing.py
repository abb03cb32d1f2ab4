"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Sources get targets by weight: no target is over ``most`` times its source's
size, and what that leaves over is shared again by weight among the others.
A document of a source with target / size = r gets floor(r) copies and, with
probability r - floor(r), one more.  These probabilities are rounded together:
two documents meet, one gives words of its expected copy to the other until
either has a whole copy or none, the direction drawn so that no expectation
moves.  One of the two stays open and meets the next, so the words taken of a
source are its target but for the last open document, which goes to the nearer
side: at most half of that document's words are missing or too many.

Documents are numbered by (source, size descending, hash).  Runs of ``fan_in``
numbers are folded side by side, what each leaves open meets in runs of runs,
and so on: a reduction tree of as many levels as the count has digits to base
``fan_in``.  No group is ever larger than fan_in, whatever a source's size.
Neither partitions nor executors change the result.

Defined results: a null text has no words; a document of no words takes none;
a null source is one source, the last; null and repeated ids are documents of
their own (equal rows may swap their shares); sources without words have the
target 0; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_WORD = r"[^\x20\x09-\x0D]+"
_BIG = "decimal(38,0)"


def _numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """df stored in order with ``at``, each row's number from 0: numbers within sorted partitions, then a sum for each partition before."""
    rows = scratch.table(df.orderBy(*order).withColumn("in_part", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("in_part", 33), F.col("in_part").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)")
    starts = scratch.table(counts.select("part", before.alias("start")), f"{name}_starts")
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("at", F.col("start") + within).drop("part", "start", "in_part")


def targets(sizes: DataFrame, share: Fraction, weights: tuple[int, ...], most: int, scratch: Scratch) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights go round by the sources' order, null last.

    One rate a weight holds for all targets under their limits.  The rate rises
    as sources reach theirs, so the last rate is all that a round must know;
    sums and comparisons are exact.
    """
    ranked = _numbered(sizes, [F.col("source").asc_nulls_last()], scratch, "sources")
    turn = F.pmod("at", F.lit(len(weights))) + 1
    ranked = scratch.table(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long").alias("weight")), "weights")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    rate = share * (total or 0) / (weight or 1)
    exact = lambda n: F.lit(Decimal(n)).cast(_BIG)
    while True:
        stopped = F.col("weight").cast(_BIG) * exact(rate.numerator) > F.col("source_size").cast(_BIG) * exact(most * rate.denominator)
        full, rest = ranked.agg(F.coalesce(F.sum(F.when(stopped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        after = (share * (total or 0) - most * full) / rest if rest else rate
        if after == rate:
            break
        rate = after
    free = (F.col("weight").cast(_BIG) * exact(rate.numerator)).cast("double") / F.lit(float(rate.denominator))
    return ranked.select("source", "source_size", F.when(stopped, (most * F.col("source_size")).cast("double")).otherwise(free).alias("target"))


def _pair(state: Column, unit: Column, seed: int) -> Column:
    """The open document meets the next: one of them is settled, the other is open now."""
    held = state["open"]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), unit["h"], unit["at"], held["at"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    to_held, to_unit = F.least(held["size"] - held["mass"], unit["mass"]), F.least(held["mass"], unit["size"] - unit["mass"])
    gains = u * (to_held + to_unit) < to_unit  # so that neither's expected mass moves

    def moved(x: Column, up: Column, amount_up: Column, amount_down: Column) -> Column:
        more = F.when(amount_up >= x["size"] - x["mass"], x["size"].cast("double")).otherwise(x["mass"] + amount_up)
        less = F.when(amount_down >= x["mass"], F.lit(0.0)).otherwise(x["mass"] - amount_down)
        return x.withField("mass", F.when(up, more).otherwise(less))

    a, b = moved(held, gains, to_held, to_unit), moved(unit, ~gains, to_unit, to_held)
    whole = (a["mass"] <= 0) | (a["mass"] >= a["size"])
    met = F.struct(F.when(whole, b).otherwise(a).alias("open"), F.concat(state["done"], F.array(F.when(whole, a).otherwise(b))).alias("done"))
    return F.when(held.isNull(), F.struct(unit.alias("open"), state["done"].alias("done"))).otherwise(met)


def mix(docs: DataFrame, share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2, seed: int = 11, fan_in: int = 256) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per document row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    sized = scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"), F.monotonically_increasing_id().alias("rid")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = scratch.table(targets(sizes, share, weights, most, scratch).withColumnRenamed("source", "of"), "targets")
    ordered = _numbered(sized, [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("h"), F.col("rid")], scratch, "ordered")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = ordered.join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn("base", F.floor(ratio)).withColumn("mass", (ratio - F.col("base")) * F.col("size"))
    units = scratch.table(units.select("source", "source_size", "target", "doc_id", "size", "base", "mass", "h", "at"), "units")

    kind = "struct<" + ",".join(f"{c}:{units.schema[c].dataType.simpleString()}" for c in ("at", "doc_id", "size", "base", "mass", "h")) + ">"
    outer, start = ["source", "source_size", "target"], F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    units_of = F.struct("at", "doc_id", "size", "base", "mass", "h").cast(kind)
    whole = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
    settled = [units.where(whole).select(*outer, units_of.alias("unit"))]
    rest, n = units.where(~whole).select(*outer, units_of.alias("unit")), units.count()
    span = 1
    while True:
        span *= fan_in
        runs = rest.groupBy(*outer, F.floor(F.col("unit.at") / span).alias("run")).agg(F.array_sort(F.collect_list("unit")).alias("units"))
        folded = scratch.table(runs.select(*outer, F.aggregate("units", start, lambda s, x: _pair(s, x, seed)).alias("s")), f"level{span}")
        settled.append(folded.select(*outer, F.explode("s.done").alias("unit")))
        rest = folded.select(*outer, F.col("s.open").alias("unit"))
        if span >= n:
            break
    settled.append(rest)  # one document a source at most, which goes to the nearer side
    more = F.when(2 * F.col("unit.mass") >= F.col("unit.size"), 1).otherwise(0)
    out = reduce(DataFrame.union, settled)
    copies = F.when(F.col("unit.size") > 0, F.col("unit.base") + more).otherwise(0).cast("long")
    return out.select("unit.doc_id", "source", "unit.size", "source_size", "target", copies.alias("copies"), (copies * F.col("unit.size")).alias("taken"))
