"""Retrieval in several corpora side by side, each a tagged job of its own.

A corpus that fails or is late leaves the others' results as they are: its jobs
are cancelled by their tag, and a status row says what became of it.

Statuses: ok; empty, no hits; failed, with the error's first line; late, not
done within the time that all corpora have.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import new_folder, stored
from .rank import reciprocal_rank_fusion

HITS = "query_id long, corpus_id string, chunk_id long, distance double"


def _counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table that has any, by one job."""
    if not tables:
        return {}
    each = [rows.select(F.lit(name).alias("name")) for name, rows in tables.items()]
    return {r["name"]: r["count"] for r in reduce(DataFrame.unionByName, each).groupBy("name").count().collect()}


def retrieve_each(spark: SparkSession, corpora: dict[str, Callable[[], DataFrame]], timeout: float = 3.0, workers: int = 16, schema: str = HITS) -> tuple[DataFrame, DataFrame]:
    """(hits of all corpora that were done in time, (corpus_id, status, hits, error)).

    corpora gives each corpus_id what makes its hits; it runs in a thread, and
    the rows it gives are stored under the shared folder before they count, so
    a corpus is in the answer whole or not at all.
    """
    folder, run = new_folder(spark, "corpora"), uuid.uuid4().hex
    names = list(corpora)
    tags = {name: f"corpus-{run}-{n}" for n, name in enumerate(names)}

    def one(n: int, name: str) -> DataFrame:
        spark.sparkContext.addJobTag(tags[name])
        try:
            fields = spark.createDataFrame([], schema).schema
            rows = corpora[name]().select(*(F.col(f.name).cast(f.dataType) for f in fields))
            return stored(rows.withColumn("corpus_id", F.lit(name)) if "corpus_id" in fields.names else rows, f"{folder}/{n}")
        finally:
            spark.sparkContext.removeJobTag(tags[name])

    pool = ThreadPoolExecutor(max_workers=workers)
    began = time.monotonic()
    jobs = {name: pool.submit(inheritable_thread_target(one), n, name) for n, name in enumerate(names)}
    wait(jobs.values(), timeout=max(0.0, timeout - (time.monotonic() - began)))
    done, status = {}, []
    for name, job in jobs.items():
        if not job.done():
            job.cancel()
            spark.sparkContext.cancelJobsWithTag(tags[name])
            status.append((name, "late", 0, f"not done after {timeout:g} s"))
        elif job.exception():
            status.append((name, "failed", 0, str(job.exception()).split("\n")[0][:200]))
        else:
            done[name] = job.result()
    pool.shutdown(wait=False, cancel_futures=True)
    found = _counts(done)
    status += [(name, "ok" if found.get(name) else "empty", found.get(name, 0), None) for name in done]
    hits = reduce(DataFrame.unionByName, done.values()) if done else spark.createDataFrame([], schema)
    return hits, spark.createDataFrame(status, "corpus_id string, status string, hits long, error string")


def fused(spark: SparkSession, corpora: dict[str, Callable[[], DataFrame]], timeout: float = 3.0, workers: int = 16, k: int = 60, top: int = 100) -> tuple[DataFrame, DataFrame]:
    """(reciprocal-rank fusion of the corpora's hits, their statuses)."""
    hits, status = retrieve_each(spark, corpora, timeout, workers)
    return reciprocal_rank_fusion(hits, k, top), status
