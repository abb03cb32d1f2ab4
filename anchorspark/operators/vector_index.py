"""A stored inverted file over vectors: lists around centroids, of which a search reads the nearest.

Centroids are fitted on a sample of at most ``sample_rows`` vectors, the ones
with the smallest hash of their id.  Every vector is in the list of its nearest
centroid; the table is sorted by list, so that a search for few lists skips most
of its files and row groups, and no task holds a whole list.  A search sends its
queries, in blocks of a fixed number, to the tasks; a task keeps the k nearest of
each query among its rows.  With all lists probed the answer is exact.

Defined results: null vectors, and those of another width or with a null or
non-finite component, are in no list and in no answer; null and repeated ids are
rows of their own; equal distances rank by chunk_id; an empty table gives an
empty index; further columns of the vectors are stored and may be filtered on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored
from .rank import top_k
from .retrieve import MOST_QUERIES, compile_filter

_ROWS = 2048  # rows that meet the queries at a time


def _usable(width: int, name: str = "embedding") -> Column:
    bad = F.exists(name, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return (F.size(name) == width) & ~bad


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def fitted(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of a sample by rounds of means; an empty list starts anew at the vector that is farthest off."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = _nearest(sample, centroids)
        off = ((sample - centroids[near]) ** 2).sum(1)
        for c in range(len(centroids)):
            mine = near == c
            if mine.any():
                centroids[c] = sample[mine].mean(0)
            else:
                centroids[c] = sample[off.argmax()]
                off[off.argmax()] = 0
    return centroids


def _lists_of(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                yield part.append_column("list", pa.array(_nearest(_matrix(part["embedding"], centroids.shape[1]), centroids), pa.int32()))

    return run


def _searched(ids: pa.Array, queries: np.ndarray, probed: np.ndarray, k: int, digits: int, carried: list[str]):
    """For each query the k nearest rows of a task, among the lists that it probes (queries x lists)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (queries**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part["embedding"], queries.shape[1])
                near = norms[:, None] - 2 * queries @ x.T + (x**2).sum(1)
                near[~probed[:, part["list"].to_numpy(zero_copy_only=False)]] = np.inf
                limit = near.max(1) if part.num_rows <= k else np.partition(near, k - 1, 1)[:, k - 1]
                q, row = np.nonzero((near <= limit[:, None] + 1e-6 * (1 + np.abs(limit[:, None]))) & np.isfinite(near))  # with what rounding may have put behind
                exact = np.round(((queries[q] - x[row]) ** 2).sum(1), digits)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *(part[c].take(taken) for c in carried), pa.array(exact)], ["query_id", *carried, "distance"])

    return run


class InvertedFile:
    """vectors (chunk_id, embedding, further columns, list) and centroids under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.vectors = spark.read.parquet(f"{path}/vectors")
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        self.centroids, self.probes = np.array(about["centroids"], np.float64).reshape(-1, about["width"]), about["probes"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, width: int, lists: int | None = None, sample_rows: int = 65_536, rounds: int = 8, seed: int = 1, target: float = 0.95, tuned_on: int = 64, k: int = 10) -> InvertedFile:
        """Index vectors (chunk_id, embedding) of a width under path.

        lists: about the square root of their number, at most 4,096, unless given.
        How many lists a search probes is the least power of two (or all) with
        which at least the target share of the exact k nearest of tuned_on
        vectors is found.
        """
        spark = vectors.sparkSession
        usable = vectors.where(_usable(width))
        order = [F.xxhash64(F.lit(seed), "chunk_id"), F.col("chunk_id")]
        sample = np.array([r[0] for r in usable.orderBy(*order).limit(sample_rows).select("embedding").collect()], np.float64).reshape(-1, width)
        lists = lists or min(4096, max(1, math.isqrt(usable.count())))
        centroids = fitted(sample, lists, rounds, seed) if len(sample) else sample
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", list int"
        placed = usable.mapInArrow(_lists_of(centroids), ddl)
        stored(placed.repartitionByRange("list", "chunk_id").sortWithinPartitions("list"), f"{path}/vectors")
        about = {"width": width, "centroids": centroids.tolist(), "probes": len(centroids)}
        index = cls._noted(spark, path, about)
        asked = usable.orderBy(F.xxhash64(F.lit(seed + 1), "chunk_id"), "chunk_id").limit(tuned_on).select(F.xxhash64("chunk_id").alias("query_id"), F.col("embedding").alias("q")).dropDuplicates(["query_id"])
        probes = 1
        while probes < len(centroids) and index.recall(asked, k, probes) < target:
            probes *= 2
        return cls._noted(spark, path, about | {"probes": max(1, min(probes, len(centroids)))})

    @classmethod
    def _noted(cls, spark: SparkSession, path: str, about: dict) -> InvertedFile:
        stored(spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1), f"{path}/about")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, where: dict | None = None, digits: int = 15, exact: bool = False) -> DataFrame:
        """The k nearest of queries (query_id, q) by squared L2, with the vectors' other columns and rank."""
        carried = [c for c in self.vectors.columns if c not in ("embedding", "list")]
        n, width = queries.count(), self.centroids.shape[1]
        blocks = -(-n // MOST_QUERIES) or 1
        parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)) == i) for i in range(2 * blocks)]
        out = [self._block(part.where(_usable(width, "q")).select("query_id", "q"), k, len(self.centroids) if exact else probes or self.probes, where, digits, carried) for part in parts]
        return top_k(reduce(DataFrame.union, out), ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k)

    def _block(self, queries: DataFrame, k: int, probes: int, where: dict | None, digits: int, carried: list[str]) -> DataFrame:
        rows = queries.toArrow().combine_chunks()  # a block of queries, a bounded number
        fields = {f.name: f.dataType.simpleString() for f in self.vectors.schema}
        ddl = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` {fields[c]}" for c in carried) + ", distance double"
        if not rows.num_rows or not len(self.centroids):
            return self.spark.createDataFrame([], ddl)
        q = _matrix(rows["q"].combine_chunks() if isinstance(rows["q"], pa.ChunkedArray) else rows["q"], self.centroids.shape[1])
        ids = rows["query_id"].combine_chunks() if isinstance(rows["query_id"], pa.ChunkedArray) else rows["query_id"]
        away = (self.centroids**2).sum(1) - 2 * q @ self.centroids.T
        probed = np.zeros(away.shape, bool)
        np.put_along_axis(probed, np.argsort(away, 1, kind="stable")[:, :probes], True, 1)
        wanted = np.flatnonzero(probed.any(0)).tolist()
        vectors = self.vectors.where(compile_filter(where))
        if len(wanted) < len(self.centroids):
            vectors = vectors.where(F.col("list").isin(wanted))
        return vectors.select(*carried, "embedding", "list").mapInArrow(_searched(ids, q, probed, k, digits, carried), ddl)

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> float:
        """The share of the exact k nearest that a search finds."""
        exact = self.search(queries, k, exact=True).select("query_id", "chunk_id", F.lit(1).alias("true"))
        found = self.search(queries, k, probes).select("query_id", "chunk_id", F.lit(1).alias("got")).distinct()
        return exact.join(found, ["query_id", "chunk_id"], "left").agg(F.avg(F.coalesce("got", F.lit(0)))).first()[0] or 0.0
