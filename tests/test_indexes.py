"""Stored indexes against plain search, and corpora that fail or are late."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorspark.operators import multi_corpus
from anchorspark.operators.lexical_index import LexicalIndex
from anchorspark.operators.vector_index import InvertedFile
from anchorspark.plans import index_queries  # noqa: F401  registers its queries
from anchorspark.plans import queries as core
from anchorspark.sources.stored import new_folder

SF = "/root/testdata/sf0.01"
TOKEN = re.compile("[0-9A-Za-zÆØÅæøå]+")


def plain_bm25(docs, question, k):
    counts = [(i, n, Counter(TOKEN.findall((t or "").lower()))) for n, (i, t) in enumerate(docs)]
    mean = sum(sum(c.values()) for _, _, c in counts) / len(counts)
    df = Counter(w for _, _, c in counts for w in c)
    idf = lambda w: math.log((len(counts) - df[w] + 0.5) / (df[w] + 0.5) + 1)
    terms, out = set(TOKEN.findall((question or "").lower())), []
    for i, n, c in counts:
        shared = [w for w in terms if c[w]]
        if shared:
            out.append((-round(sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in shared), 6), i is not None, i or 0, n))
    return [(i if known else None, -s) for s, known, i, _ in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join(rnd.choice(common) if rnd.random() < 0.8 else rnd.choice(rare) for _ in range(rnd.randint(1, 60)))) for i in range(700)]
    docs += [(None, "c1 r5 r6"), (None, "c1 r5 r6"), (3, "c1 r5 r6"), (900, None), (901, ""), (902, "c1 " * 9000)]
    asked = [(q, " ".join([*rnd.sample(common, 6), *rnd.sample(rare, 5)])) for q in range(20)] + [(20, "c1 c2"), (21, "unknown words"), (22, ""), (23, None), (24, "r5 R6 c1 c1")]
    return docs, asked


@pytest.mark.parametrize(("k", "block", "rare"), [(10, 64, 500), (3, 7, 20), (1, 64, 1)])
def test_lexical_index(spark, corpus, k, block, rare):
    docs, asked = corpus
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, block long").repartition(3)
    index = LexicalIndex.build(table, new_folder(spark, "t"), rows_a_block=block)
    found, reads = LexicalIndex(spark, index.path).search(spark.createDataFrame(asked, "query_id int, question string"), k, rare_postings=rare)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.bm25, abs=2e-6)))
    for q, text in asked:
        assert got.get(q, []) == plain_bm25(docs, text, k), q
    total, read = reads.agg(F.sum("postings"), F.sum("postings_read")).first()
    assert read < total and reads.where("postings_read > postings").count() == 0


def test_lexical_index_of_nothing(spark):
    index = LexicalIndex.build(spark.createDataFrame([], "doc_id long, text string"), new_folder(spark, "t"))
    assert index.search(spark.createDataFrame([(1, "word")], "query_id int, question string"))[0].count() == 0


def test_a_search_stores_and_deals_no_pairs(spark, corpus, tmp_path):
    """what a search stores doesn't grow with the documents, no pair of question and document is dealt, and blocks without asked words give nothing."""
    docs, asked = corpus
    table = spark.createDataFrame(docs + [(5000 + i, "zz") for i in range(200)], "doc_id long, text string")
    index = LexicalIndex.build(table, new_folder(spark, "t"), rows_a_block=16)
    assert index.postings.where("term = ''").agg(F.sum("n")).first()[0] == len(docs) + 200
    found, _ = index.search(spark.createDataFrame(asked, "query_id int, question string"), folder=str(tmp_path))
    assert sum(spark.read.parquet(str(x)).count() for x in tmp_path.iterdir()) <= 25 * 12 * 2
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in dealt if "rid" in line]
    assert found.count() > 200


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 4, (20, 8))
    rows = [(i, (centers[i % 20] + rng.normal(0, 1, 8)).tolist(), i % 3) for i in range(3000)]
    odd = [(4000, None, 0), (4001, [1.0] * 7, 0), (4002, [float("nan")] * 8, 0), (4003, [1.0] * 7 + [None], 0), (None, rows[0][1], 0), (5, rows[0][1], 0)]
    return rows, odd


def test_inverted_file(spark, vectors):
    rows, odd = vectors
    table = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>, kind int")
    index = InvertedFile.build(table, new_folder(spark, "t"), 8, sample_rows=500)
    assert index.vectors.count() == len(rows) + 2 and 1 <= index.probes < len(index.centroids)
    asked = spark.createDataFrame([(r[0], r[1]) for r in rows[::100]] + [(-1, None)], "query_id long, q array<double>")
    x, ids = np.array([r[1] for r in [*rows, *odd[-2:]]]), [*[r[0] for r in rows], None, 5]

    def plain(q, keep=lambda n: True):
        d = np.round(((x - np.array(q)) ** 2).sum(1), 12)
        return sorted(((d[n], ids[n] is not None, ids[n] or 0) for n in range(len(d)) if keep(n)))[:5]

    reopened = InvertedFile(spark, index.path)
    got = {}
    for r in reopened.search(asked, 5, digits=12, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.chunk_id is not None, r.chunk_id or 0))
    assert got == {r[0]: [pytest.approx(p) for p in plain(r[1])] for r in rows[::100]}
    assert reopened.recall(asked, 5) >= 0.9
    only = reopened.search(asked, 5, where={"kind": 1}, exact=True)
    assert only.where("kind <> 1").count() == 0 and only.count() == 5 * 30
    assert len(reopened.vectors.inputFiles()) >= 1 and reopened.search(asked.limit(0), 5).count() == 0


def test_inverted_file_of_nothing(spark):
    index = InvertedFile.build(spark.createDataFrame([], "chunk_id long, embedding array<float>"), new_folder(spark, "t"), 4)
    assert index.search(spark.createDataFrame([(1, [0.0] * 4)], "query_id int, q array<float>")).count() == 0


def test_corpora_are_isolated(spark):
    hits = lambda n: spark.range(n).select(F.lit(1).alias("query_id"), F.col("id").alias("chunk_id"), F.col("id").cast("double").alias("distance"), F.lit("").alias("corpus_id"))
    wait = F.udf(lambda x: time.sleep(60) or x, "long")
    corpora = {"a": lambda: hits(3), "b": lambda: hits(2), "none": lambda: hits(0)}
    alone, _ = multi_corpus.fused(spark, corpora, timeout=120)
    began = time.monotonic()
    late = {"late": lambda: hits(1).withColumn("chunk_id", wait("chunk_id")), "broken": lambda: hits(1).select("nothing"), "fails later": lambda: hits(1).withColumn("distance", F.raise_error(F.lit("bad row")).cast("double"))}
    fused, status = multi_corpus.fused(spark, corpora | late, timeout=15)
    assert time.monotonic() - began < 45
    assert sorted(fused.collect()) == sorted(alone.collect()) and fused.count() == 5
    got = {r.corpus_id: (r.status, r.hits) for r in status.collect()}
    assert got == {"a": ("ok", 3), "b": ("ok", 2), "none": ("empty", 0), "late": ("late", 0), "broken": ("failed", 0), "fails later": ("failed", 0)}
    time.sleep(1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()  # the late one was cancelled


def test_corpora_take_few_executions(spark):
    """two counts for all corpora, one execution for each of twelve and a count of what they hold; each execution leaves its threads to the driver for a minute."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000), store.executionsList().last().executionId())[1]
    assert core._vectors(spark, SF)[0].select("corpus_id").distinct().count() == 10
    before = last()
    core.QUERIES["isolated_corpora"](spark, SF)
    assert last() - before <= 15
