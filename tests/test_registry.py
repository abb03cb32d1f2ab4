"""Files beside the index, and planning rules that have no table of their own."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from anchorspark.functions import refs as R
from anchorspark.operators import planning
from anchorspark.sources import registry


def test_texts_and_cases(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\nline")
    (tmp_path / "b.md").write_text("no")
    got = registry.read_texts(spark, str(tmp_path)).collect()
    assert [(r["chunk_id"], r["text"], r["metadata"]) for r in got] == [("a.txt", "first\nline", {"source": "a.txt"})]
    (tmp_path / "one.json").write_text(json.dumps([{"id": "c2", "prompt": "p"}, {"prompt": "no id"}]))
    (tmp_path / "two.json").write_text(json.dumps({"cases": [{"id": "c1", "prompt": "q"}]}))
    (tmp_path / "bad.json").write_text("{not json")
    cases = registry.read_cases(spark, str(tmp_path), "struct<id: string, prompt: string>").collect()
    assert [(r["id"], r["prompt"]) for r in cases] == [("c1", "q"), ("c2", "p")]


def test_run_log_and_stored_graph(spark, tmp_path):
    runs = spark.createDataFrame([("l", 1, "t", True), ("l", 1, "t", False)], "law string, run_id int, ts string, passed boolean")
    for _ in range(2):
        registry.append_runs(registry.progression(runs), str(tmp_path / "log"))
    assert [r["pass_rate"] for r in spark.read.json(str(tmp_path / "log")).collect()] == [50.0, 50.0]
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("a", 1)], "node string, mention_count int"), spark.createDataFrame([("a", "b", 1)], "src string, dst string, count int")

    for _ in range(2):
        nodes, edges = registry.load_or_build(spark, f"file://{tmp_path}/graph", build)
    assert made == [1] and nodes.first()["node"] == "a" and edges.first()["dst"] == "b"


def test_vector_upsert_keeps_equal_dimensions(spark):
    old = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id int, embedding array<double>")
    new = spark.createDataFrame([(2, [3.0, 4.0]), (3, [5.0, 6.0])], "chunk_id int, embedding array<double>")
    assert sorted((r["chunk_id"], r["embedding"][0]) for r in registry.upsert_vectors(old, new).collect()) == [(2, 3.0), (3, 5.0)]
    assert registry.upsert_vectors(old, new.limit(0)).count() == 2


def test_settings_and_filters(spark):
    assert planning.check_settings({"a": 0.5, "b": 0.5}, 500, 100) == []
    assert len(planning.check_settings({"a": -0.5, "b": 0.5}, 500, 500)) == 3
    meta = F.create_map(F.lit("article"), F.lit("6"))
    row = spark.range(1).select(
        planning.matches(meta, F.create_map(F.lit("article"), F.lit("6"))).alias("a"), planning.matches(meta, F.create_map(F.lit("article"), F.lit("7"))).alias("b"),
        planning.matches(meta, F.lit(None).cast("map<string,string>")).alias("c"), R.needs_context(F.lit(None).cast("string"), F.lit("x")).alias("d"), R.history_prompt(F.array().cast("array<struct<role:string,text:string>>")).alias("e"),
    ).first()
    assert tuple(row) == (True, False, True, False, "")
