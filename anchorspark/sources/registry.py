"""Small tables that an installation keeps beside its index: inventory, aliases, run files, logs and stored graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

_PROVENANCE = ["schema_version", "corpus_id", "doc_id", "doc_version", "language", "source_type", "source_path", "source", "canonical_url", "source_url"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, text, metadata) of the .txt files under path; the file's name is its id and source."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("chunk_id"), F.col("value").alias("text"))
    return rows.withColumn("metadata", F.create_map(F.lit("source"), F.col("chunk_id")))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of JSON files, each a list of cases or an object with cases; unreadable files are left out; in order of id."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{schema}>")).otherwise(F.from_json("value", f"struct<cases: array<{schema}>>")["cases"])
    return raw.select(F.explode(parsed).alias("c")).select("c.*").where("id is not null").orderBy("id")


def latest_files(runs: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """The newest run of each value of by among the newest most run files (file, timestamp, ...)."""
    scanned = runs if most is None else runs.join(F.broadcast(runs.select("file", "timestamp").distinct().orderBy(F.desc("timestamp"), F.desc("file")).limit(most)), ["file", "timestamp"], "left_semi")  # at most so many files
    last = scanned.groupBy(by).agg(F.max(F.struct("timestamp", "file")).alias("last"))
    return scanned.join(last, by).where("timestamp = last.timestamp and file = last.file").drop("last")


def append_runs(runs: DataFrame, path: str) -> None:
    """Run results as JSON lines added to a folder."""
    runs.write.mode("append").json(path)


def progression(runs: DataFrame) -> DataFrame:
    """A log row per run (law, run_id, ts): total, passed and pass_rate of its cases (passed)."""
    return runs.groupBy("law", "run_id", "ts").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("pass_rate", F.round(100.0 * F.col("passed") / F.col("total"), 2))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two JSON tables under path."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_or_build(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The graph stored under path; if there's none, built and stored first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/edges/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        write_graph(*build(), path)
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")


def inventory(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (corpus_id, ...) with new ones over old, ids trimmed and lower-case, unset new fields kept from old."""
    key = F.lower(F.trim("corpus_id"))
    a, b = old.withColumn("corpus_id", key).alias("a"), new.withColumn("corpus_id", key).alias("b")
    rest = [c for c in old.columns if c != "corpus_id"]
    return a.join(b, F.col("a.corpus_id") == F.col("b.corpus_id"), "full").select(F.coalesce("b.corpus_id", "a.corpus_id").alias("corpus_id"), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest))


def alias(text: Column) -> Column:
    """Lower-case, one space for any white space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def derive_aliases(corpus_id: Column, name: Column) -> Column:
    """A corpus's name, its id, and its id with spaces or hyphens for underscores; three characters and more, each once."""
    key = F.lower(F.trim(corpus_id))
    all_ = F.array(alias(name), alias(key), alias(F.replace(key, F.lit("_"), F.lit(" "))), alias(F.replace(key, F.lit("_"), F.lit("-"))))
    return F.array_distinct(F.filter(all_, lambda a: F.length(a) >= 3))


def merge_aliases(old: Column, new: Column) -> Column:
    """Old aliases, then new ones, cleaned, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(old, none), F.coalesce(new, none)), alias), lambda a: F.length(a) >= 3))


def stringify(values: Column, terms: bool = False) -> Column:
    """A list as an index stores it: terms joined by bars, other lists by commas."""
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), " | " if terms else ", ")


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """new over old by key; a collection whose vectors have another dimension is reset, so old rows of another length go."""
    size = new.agg(F.max(F.size(vector)).alias("dim"))
    same = old.crossJoin(F.broadcast(size)).where(F.col("dim").isNull() | (F.size(vector) == F.col("dim"))).drop("dim")  # one row
    return tables.upsert(same, new, key)


def stamp(meta: Column, **given: Column) -> Column:
    """Provenance put into a metadata map where it has none; a null value of a URL is left out."""
    fresh = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), given[k].cast("string").alias("value")) for k in _PROVENANCE if k in given)), lambda p: p["value"].isNotNull() | ~p["key"].endswith("_url"))
    return F.map_concat(F.map_from_entries(F.filter(fresh, lambda p: ~F.map_contains_key(meta, p["key"]))), meta)


def merge_keywords(rows: DataFrame, by: str, words: str) -> DataFrame:
    """(by, words): the sorted union of arrays of keywords, lower-case."""
    each = rows.select(by, F.explode(words).alias("w")).where(F.length(F.trim("w")) > 0)
    return each.groupBy(by).agg(F.array_sort(F.collect_set(F.lower(F.trim("w")))).alias(words))
