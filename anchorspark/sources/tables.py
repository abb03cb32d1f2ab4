"""Readers and writers of the engine's own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import place as P

CHUNK_SCHEMA = "text string, metadata map<string, string>"
RUN_SCHEMA = "meta struct<law: string, timestamp: string, run_mode: string, duration_seconds: double>, results array<struct<case_id: string, passed: boolean, duration_ms: double, retry_count: int, escalated: boolean, scores map<string, struct<passed: boolean, score: double, message: string>>>>".replace("scores map", "scores: map")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of passages; broken lines are left out."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per case result of every run file under path."""
    runs = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    return runs.select("file", "meta.*", F.explode("results").alias("r")).select("file", "law", "timestamp", "run_mode", "r.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph files."""
    raw = spark.read.schema("nodes map<string, struct<type: string, title: string, chapter: string, roles: array<string>, mention_count: int>>, edges array<struct<source: string, target: string, type: string, count: int, weight: double>>").option("multiLine", "true").json(path)
    nodes = raw.select(F.explode("nodes").alias("node", "n")).select("node", "n.*")
    return nodes, raw.select(F.explode("edges").alias("e")).select("e.*")


def index_rows(chunks: DataFrame, order: list | None = None) -> DataFrame:
    """What an index holds: rows with text, no contents rows, the last of each chunk_id, with terms, context and heading before the text.

    The last is by order, columns of the rows' place in their source: by default
    the chunk_index of the metadata, then the text, whatever the files' layout.
    """
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    rows = chunks.where((F.length(F.trim("text")) > 0) & (F.coalesce(m("doc_type"), F.lit("")) != "toc"))
    rows = rows.withColumn("chunk_id", F.coalesce(m("chunk_id"), F.sha2("text", 256)))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*(order or [F.desc_nulls_last(m("chunk_index").cast("long")), F.desc("text")])))).where("r = 1")
    return rows.select("chunk_id", P.index_text(F.col("text"), F.col("metadata")).alias("embed_text"), "text", "metadata")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over rows of old by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
