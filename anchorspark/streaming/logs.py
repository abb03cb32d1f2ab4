"""Logs as streams: an idempotent sink, and the state of each law's evaluation runs.

A batch that is written again, after a restart between its write and its commit,
replaces what it wrote: every batch has a folder of its own.  The state of a law
is its latest run and how its runs went on, whatever order they come in; it is
kept by the stream's checkpoint, so a stream that is stopped and started again
tells what one batch over the whole log tells.

Defined results: a null law or a null time makes no state; a run that is sent
twice counts once, by its id; of runs of one time the larger id is the later; a
law's state grows by an entry a run, as its progression does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_RUN = "struct<ts:long,run_id:long,rate:double>"
STATE = "law string, latest_run long, latest_rate double, runs int, best_rate double, progression array<double>"


def append(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to path once and only once; read it with read()."""
    write = lambda batch, n: batch.write.mode("overwrite").json(f"{path}/batch={n}")
    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).drop("batch")


def _state_of(law: str, runs: list[tuple]) -> pd.DataFrame:
    rates = [r[2] for r in runs]
    return pd.DataFrame({"law": [law], "latest_run": [runs[-1][1]], "latest_rate": [rates[-1]], "runs": [len(runs)], "best_rate": [max(rates)], "progression": [rates]})


def _advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = {r[1]: tuple(r) for r in (state.get[0] if state.exists else [])}
    for batch in batches:
        for ts, run_id, rate in zip(batch["ts"].tolist(), batch["run_id"].tolist(), batch["rate"].tolist(), strict=True):
            known.setdefault(run_id, (ts, run_id, rate))
    runs = sorted(known.values())
    state.update((runs,))
    yield _state_of(key[0], runs)


def progression(runs: DataFrame) -> DataFrame:
    """The state of each law after each batch of a stream of runs (law, ts, run_id, rate): latest run, number, best rate, rates in order of time."""
    rows = runs.where("law is not null and ts is not null and run_id is not null").select("law", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("run_id").cast("long"), F.col("rate").cast("double"))
    return rows.groupBy("law").applyInPandasWithState(_advance, STATE, f"runs array<{_RUN}>", "update", GroupStateTimeout.NoTimeout)


def progression_of(runs: DataFrame) -> DataFrame:
    """progression() of a whole log at once."""
    rows = runs.where("law is not null and ts is not null and run_id is not null").select("law", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("run_id").cast("long").alias("run_id"), F.col("rate").cast("double").alias("rate"))
    once = rows.groupBy("law", "run_id").agg(F.min_by("rate", "ts").alias("rate"), F.min("ts").alias("ts"))
    listed = once.groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ts", "run_id", "rate"))).alias("r"))
    last, rates = F.element_at("r", -1), F.transform("r", lambda x: x["rate"])
    return listed.select("law", last["run_id"].alias("latest_run"), last["rate"].alias("latest_rate"), F.size("r").alias("runs"), F.array_max(rates).alias("best_rate"), rates.alias("progression"))
