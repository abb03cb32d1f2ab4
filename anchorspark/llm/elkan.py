"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector keeps an upper bound of the distance to its centroid and a lower
bound of that to every centroid.  A centroid is passed over if the upper bound
is strictly below its lower bound, or strictly below half of the distance
between it and the vector's own; whatever isn't passed over is compared by exact
integer distances, so ties still go to the smaller number.  When centroids move,
bounds move by as much.  Every bound is rounded to its safe side.

Vectors and bounds are one stored table a round; tasks read it in batches and
write the next, the sums of clusters are partial aggregates, and the driver
holds the k centroids alone.

Defined results: vectors with another number of components, or with a null or
non-finite one, have no row; null and repeated ids are vectors of their own; a
null id comes last among the seeds; of fewer kept vectors than k each is a
centroid; a component of more than 2**27 after scaling is an error, as squared
distances wouldn't fit in a long; an empty table gives an empty table; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .scratch import Scratch

_WIDEST = 1 << 27
_SLACK = 2.0**-50  # more than what conversions and roots lose


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + _SLACK)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - _SLACK)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def moved(upper: np.ndarray, lower: np.ndarray, near: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids moved."""
    drift = _root_up(_squared(before, after))
    return (upper + drift[near]) * (1 + _SLACK), np.maximum(lower - drift, 0) * (1 - _SLACK)


def assign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> int:
    """Set near, upper and lower, all in place, to the nearest centroids; returns how many distances were computed."""
    half = 0.5 * _root_down(_squared(centroids[:, None], centroids[None]))
    exact, known, computed = np.zeros(len(x), np.int64), np.zeros(len(x), bool), 0

    def open_for(c: int, rows: np.ndarray) -> np.ndarray:
        mine = near[rows]
        return rows[(mine != c) & (upper[rows] >= lower[rows, c]) & (upper[rows] >= half[mine, c])]

    everyone = np.arange(len(x))
    for c in range(len(centroids)):
        rows = open_for(c, everyone)
        loose = rows[~known[rows]]
        if len(loose):
            exact[loose] = _squared(x[loose], centroids[near[loose]])
            upper[loose], lower[loose, near[loose]], known[loose] = _root_up(exact[loose]), _root_down(exact[loose]), True
            rows = open_for(c, rows)
        d = _squared(x[rows], centroids[c])
        computed += len(loose) + len(rows)
        lower[rows, c] = _root_down(d)
        wins = (d < exact[rows]) | ((d == exact[rows]) & (c < near[rows]))
        rows, d = rows[wins], d[wins]
        near[rows], exact[rows], upper[rows] = c, d, _root_up(d)
    return computed


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), kind))


def _round(before: np.ndarray | None, centroids: np.ndarray, last: bool):
    k, width = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, n = _matrix(batch["x"], width, np.int64), batch.num_rows
            if before is None:
                near, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                near = batch["cluster"].to_numpy(zero_copy_only=False).astype(np.int64)
                upper, lower = moved(batch["upper"].to_numpy(zero_copy_only=False).astype(np.float64), _matrix(batch["lower"], k, np.float64), near, before, centroids)
            assign(x, near, upper, lower, centroids)
            cluster = pa.array(near, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([batch["vec_id"], cluster, pa.array(_squared(x, centroids[near]), pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                up, down = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.maximum(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), 0)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], cluster, pa.array(up, pa.float32()), _lists(down, pa.float32())], ["vec_id", "x", "cluster", "upper", "lower"])

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty cluster's floor of the mean; k rows of sums reach the driver."""
    width = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(width))).collect()
    after = centroids.copy()
    for row in sums:
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row per kept vector."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clusters")
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v) <= _WIDEST, F.floor(v).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    rows = vectors.where(F.size("embedding") == width).where(finite).select("vec_id", F.transform("embedding", lambda v: whole(v.cast("double") * scale)).alias("x"))
    rows = scratch.table(rows, "round0")
    kind = rows.schema["vec_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    before, centroids = None, np.array([r["x"] for r in seeds], np.int64)
    for n in range(1, rounds + 1):
        rows = scratch.table(rows.mapInArrow(_round(before, centroids, False), f"vec_id {kind}, x array<int>, cluster int, upper float, lower array<float>"), f"round{n}")
        scratch.drop(f"round{n - 1}")
        before, centroids = centroids, _means(rows, centroids)
    final = scratch.table(rows.mapInArrow(_round(before, centroids, True), f"vec_id {kind}, cluster int, distance long"), "final")
    spread = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(spread.values()), digests[c]) for c, s in spread.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
