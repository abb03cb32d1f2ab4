"""Queries over stored indexes, and over corpora that are searched side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import multi_corpus, retrieve
from ..operators.lexical_index import LexicalIndex
from ..operators.vector_index import InvertedFile
from ..sources.stored import new_folder
from .queries import _BM25, _NEAR, _TOP, _t, _vectors, query

_BEST = "SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10"


def _questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {_BM25} {_BEST}")
def bm25_indexed_topk(spark, d):
    index = LexicalIndex.build(_t(spark, d, "documents"), new_folder(spark, "lexical"))
    return index.search(_questions(spark, d), 10)[0]


@query(f"WITH {_BM25}, p AS (SELECT query_id, sum(df)::BIGINT AS postings FROM qt JOIN df USING (term) GROUP BY 1) SELECT query_id, postings, true AS within FROM p")
def bm25_index_reads(spark, d):
    """How many postings the questions' terms have, and whether a search read no more."""
    index = LexicalIndex.build(_t(spark, d, "documents"), new_folder(spark, "lexical"))
    reads = index.search(_questions(spark, d), 10)[1]
    return reads.select("query_id", "postings", (F.col("postings_read") <= F.col("postings")).alias("within"))


def _index(spark, d):
    vectors, queries = _vectors(spark, d)
    return InvertedFile.build(vectors, new_folder(spark, "vectors"), 64), queries


@query(f"WITH {_NEAR}, {_TOP} SELECT * FROM top WHERE rank <= 10")
def vector_index_exact(spark, d):
    """All lists probed: the same rows as without an index."""
    index, queries = _index(spark, d)
    return index.search(queries, 10, digits=6, exact=True).select("query_id", "chunk_id", "corpus_id", "distance", "rank")


@query(f"WITH {_NEAR}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near WHERE corpus_id IN (1, 3)) SELECT * FROM top WHERE rank <= 5")
def vector_index_filtered(spark, d):
    index, queries = _index(spark, d)
    return index.search(queries, 5, where={"$or": [{"corpus_id": 1}, {"corpus_id": 3}]}, digits=6, exact=True).select("query_id", "chunk_id", "corpus_id", "distance", "rank")


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, d):
    """Whether at least nine tenths of the exact ten nearest are found with the lists that a search probes."""
    index, queries = _index(spark, d)
    recall = index.recall(queries, 10)
    return queries.agg(F.count("*").alias("queries")).select("queries", F.lit(recall >= 0.9).alias("reached"))


def _corpora(spark, d):
    """A corpus for each label, one without rows and one whose table isn't there."""
    vectors, queries = _vectors(spark, d)
    blocks = retrieve.blocks_by(vectors, queries, "corpus_id")  # by the corpora that are searched, a stated list

    def search(label):
        return lambda: retrieve.vector_top_k(vectors.where(F.col("corpus_id") == label), queries, 10, digits=6, blocks=blocks.get(label, (1, 1))).select("query_id", "chunk_id", "distance", F.lit(None).cast("string").alias("corpus_id"))

    broken = lambda: spark.read.parquet(f"{d}/no such table.parquet")
    return {str(x): search(x) for x in blocks} | {"none": search(-1), "broken": broken}


_EACH = f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY distance, chunk_id) AS r FROM near)"


@query(f"{_EACH}, f AS (SELECT query_id, corpus_id::VARCHAR AS corpus_id, chunk_id, 1.0::DOUBLE / (60 + r) AS rrf FROM r WHERE r <= 10) SELECT query_id, corpus_id, chunk_id, round(rrf, 9) AS rrf, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, corpus_id, chunk_id) AS position FROM f) WHERE position <= 30")
def isolated_corpora(spark, d):
    """The fused hits of all corpora but the broken one."""
    hits, _ = multi_corpus.fused(spark, _corpora(spark, d), timeout=600, top=30)
    return hits.withColumn("rrf", F.round("rrf", 9))


@query(f"{_EACH} SELECT corpus_id::VARCHAR AS corpus_id, 'ok' AS status, count(*) AS hits FROM r WHERE r <= 10 GROUP BY 1 UNION ALL SELECT 'none', 'empty', 0 UNION ALL SELECT 'broken', 'failed', 0")
def corpora_statuses(spark, d):
    return multi_corpus.retrieve_each(spark, _corpora(spark, d), timeout=600)[1].select("corpus_id", "status", "hits")
