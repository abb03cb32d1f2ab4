"""Queries of the core library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, metrics, rank, retrieve, validate
from ..sources import passages
from . import wordings as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- lexical and hybrid ranking ------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-zÆØÅæøå]+')"
_BM25 = f"""
q AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS terms FROM benchmark),
d AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(tokens) AS dl, t.term, count(*) AS f FROM d, unnest(tokens) AS t(term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT query_id, unnest(terms) AS term FROM q),
bm AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)
"""


def _asked(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _bm25(spark, d):
    return rank.bm25_corpus(_asked(spark, d), _t(spark, d, "documents"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(spark, d):
    return rank.top_k(_bm25(spark, d).withColumn("bm25", F.round("bm25", 6)), ["query_id"], [F.desc("bm25"), F.asc("doc_id")], 10)


_ROLE_SQL = "CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(must|shall|required)($|[^a-z0-9])') THEN 1.0 ELSE 0.0 END"


@query(f"""WITH {_BM25}, b2 AS (SELECT q.query_id, documents.doc_id, coalesce(bm25, 0) AS bm25, {_ROLE_SQL} AS role FROM q CROSS JOIN documents LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = documents.doc_id),
n AS (SELECT query_id, doc_id, (bm25 - min(bm25) OVER w) / nullif(max(bm25) OVER w - min(bm25) OVER w, 0) AS lex, role FROM b2 WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, round(coalesce(lex, 0), 6) AS lexical, role AS role_score, round(0.25 * coalesce(lex, 0) + 0.15 * role, 6) AS final_score FROM n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def hybrid_rerank_topk(spark, d):
    """All documents are candidates.  Of those without a common word only the ten best by role can be among the first ten."""
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.lower("text").rlike("(^|[^a-z0-9])(must|shall|required)($|[^a-z0-9])"), 1.0).otherwise(0.0).alias("role_score"))
    best = docs.orderBy(F.desc("role_score"), "doc_id").limit(10).select("doc_id")
    asked = _asked(spark, d)
    n, tasks = rank.corpus_tasks(asked, docs)
    scored = rank.bm25_corpus(asked, _t(spark, d, "documents"), also=best, tasks=tasks)
    bounds = scored.groupBy("query_id").agg(F.min("bm25").alias("low"), F.max("bm25").alias("high"), F.count_if(F.col("bm25") > 0).alias("k"))
    bounds = bounds.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("query_id", F.when(F.col("k") < F.col("n"), 0.0).otherwise(F.col("low")).alias("low"), "high")
    scored = scored.join(F.broadcast(bounds) if n <= retrieve.BROADCAST_ROWS else bounds, "query_id")  # a row of bounds a question
    scored = scored.join(docs.repartition(tasks, "doc_id").hint("shuffle_hash"), "doc_id")  # dealt as the scores are, which stay where they are
    scored = scored.withColumn("lex", F.when(F.col("high") > F.col("low"), (F.col("bm25") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0))
    final = rank.hybrid_score(F.lit(0.0), F.col("lex"), F.lit(0.0), F.col("role_score"))
    return rank.top_k(scored.select("query_id", "doc_id", F.round("lex", 6).alias("lexical"), "role_score", F.round(final, 6).alias("final_score")), ["query_id"], [F.desc("final_score"), F.asc("doc_id")], 10)


@query("SELECT event_type, event_id, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 9) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def minmax_normalise(spark, d):
    return rank.min_max(_t(spark, d, "events"), "value", ["event_type"], "scaled").select("event_type", "event_id", F.round("scaled", 9).alias("scaled"))


# --- vectors, discovery, fusion ------------------------------------------------------------------


def _vectors(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("corpus_id"), "embedding")
    return v, v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))


_DIST = "list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_NEAR = f"near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label::BIGINT AS corpus_id, round({_DIST}, 6) AS distance FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0)"


def _near(spark, d, where=None, k=50, by=()):
    v, q = _vectors(spark, d)
    return retrieve.vector_top_k(v, q, k, where, by, 6).select("query_id", "chunk_id", "corpus_id", "distance", "rank")


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near)"


@query(f"WITH {_NEAR}, {_TOP} SELECT * FROM top WHERE rank <= 10")
def vector_topk_l2(spark, d):
    return _near(spark, d, k=10)


@query(f"WITH {_NEAR}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near WHERE corpus_id IN (1, 3)) SELECT * FROM top WHERE rank <= 5")
def vector_topk_filtered(spark, d):
    return _near(spark, d, {"$or": [{"corpus_id": 1}, {"corpus_id": 3}]}, 5)


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10")
def cosine_pairs(spark, d):
    e = _t(spark, d, "embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.expr("a.label = b.label and b.vec_id = a.vec_id + 10"))
    return pairs.select(F.col("a.vec_id").alias("a_id"), F.col("b.vec_id").alias("b_id"), F.round(T.cosine(F.col("a.embedding"), F.col("b.embedding")), 5).alias("similarity"))


_DISC = f"{_NEAR}, {_TOP}, of_corpus AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY distance, chunk_id) AS r FROM near), disc AS (SELECT query_id, corpus_id, round(0.5 * avg(exp(-distance * distance / 2)) + 0.5 * max(exp(-distance * distance / 2)), 4) AS confidence FROM of_corpus WHERE r <= 10 GROUP BY ALL)"


def _discovered(spark, d):
    return retrieve.discovery_scores(_near(spark, d, k=10, by=("corpus_id",)))


@query(f"WITH {_DISC} SELECT * FROM disc")
def discovery_scores(spark, d):
    return _discovered(spark, d)


@query(f"WITH {_DISC}, g AS (SELECT query_id, count(*) FILTER (confidence >= 0.75) AS sure, count(*) FILTER (confidence >= 0.65) AS likely FROM disc GROUP BY query_id) SELECT query_id, CASE WHEN sure > 0 THEN 'AUTO' WHEN likely BETWEEN 1 AND 2 THEN 'SUGGEST' ELSE 'ABSTAIN' END AS gate, CASE WHEN sure > 0 THEN least(sure, 5) WHEN likely BETWEEN 1 AND 2 THEN likely ELSE 0 END AS n_resolved FROM g")
def discovery_gate(spark, d):
    return retrieve.gate(_discovered(spark, d))


@query(f"WITH {_DISC}, r AS (SELECT *, lead(confidence) OVER w AS nxt, row_number() OVER w AS r FROM disc WINDOW w AS (PARTITION BY query_id ORDER BY confidence DESC, corpus_id)) SELECT query_id, coalesce(confidence - nxt < 0.10, false) AS ambiguous FROM r WHERE r = 1")
def disambiguation_trigger(spark, d):
    return retrieve.needs_disambiguation(_discovered(spark, d))


@query(f"WITH {_NEAR}, {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY distance, chunk_id) AS r FROM top WHERE rank <= 50), f AS (SELECT query_id, corpus_id, chunk_id, 1.0::DOUBLE / (60 + r) AS rrf FROM r) SELECT query_id, corpus_id, chunk_id, round(rrf, 9) AS rrf, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, corpus_id, chunk_id) AS position FROM f) WHERE position <= 20")
def rrf_fusion(spark, d):
    return rank.reciprocal_rank_fusion(_near(spark, d), top=20).withColumn("rrf", F.round("rrf", 9))


@query(f"WITH {_NEAR}, {_TOP} SELECT query_id, chunk_id, corpus_id, distance, in_group FROM (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY distance, chunk_id) AS in_group FROM top WHERE rank <= 50) WHERE in_group <= 2")
def article_diversity_topk(spark, d):
    return rank.diversify(_near(spark, d), "query_id", "corpus_id", [F.asc("distance"), F.asc("chunk_id")]).drop("rank")


@query(f"WITH {_NEAR}, {_TOP} SELECT query_id, chunk_id, round(1 / (1 + distance), 6) AS score, round(CASE WHEN distance < 0.85 THEN greatest(1 / (1 + distance), 0.5 * (1 - distance)) ELSE 1 / (1 + distance) END, 6) AS floored FROM top WHERE rank <= 20")
def score_floor(spark, d):
    hits = _near(spark, d, k=20).withColumn("score", 1 / (1 + F.col("distance")))
    return rank.score_floor(hits, "score", "distance").select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("floored", 6).alias("floored"))


@query(f"WITH {_NEAR}, b AS (SELECT vec_id AS query_id, (SELECT min(distance) FROM near WHERE query_id = vec_id AND chunk_id <> query_id AND distance < 1.6) AS best FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, CASE WHEN best IS NULL THEN 'no_evidence' WHEN best > 1.3 THEN 'too_far' WHEN best > 1.25 THEN 'low_evidence' ELSE 'answer' END AS decision FROM b")
def abstention_gate(spark, d):
    """Every fiftieth vector asks; only every hundredth is searched for, so the others have no evidence."""
    v, q = _vectors(spark, d)
    near = retrieve.vector_top_k(v, q, 2, digits=6).where("chunk_id <> query_id and distance < 1.6")
    return retrieve.abstain(_t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")), near)


@query(f"WITH {_NEAR}, {_TOP}, t AS (SELECT query_id, chunk_id, rank FROM top WHERE rank <= 9) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 20 - rank END) AS place FROM t")
def sandwich_order(spark, d):
    return rank.sandwich(_near(spark, d, k=9), "query_id", "rank").select("query_id", "chunk_id", "place")


@query(f"WITH {_NEAR}, {_TOP} SELECT query_id, count(*) AS n, min(distance) AS best, max(distance) AS worst FROM top WHERE rank <= 50 GROUP BY query_id")
def distance_summary(spark, d):
    return _near(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.min("distance").alias("best"), F.max("distance").alias("worst"))


@query("WITH s AS (SELECT generate_series AS i FROM generate_series(0, 20)), n AS (SELECT count(*) AS total FROM events WHERE value IS NOT NULL), c AS (SELECT i, (SELECT count(*) FROM events WHERE value <= i * 10 + 1e-8) AS answered FROM s) SELECT round(i * 10.0::DOUBLE, 10) AS threshold, answered::BIGINT AS answered, (total - answered)::BIGINT AS abstained, (answered - coalesce(lag(answered) OVER (ORDER BY i), 0))::BIGINT AS newly FROM c, n")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(_t(spark, d, "events").where("value is not null").select(F.col("value").alias("best")), 0.0, 200.0, 10.0)


# --- siblings and injection ----------------------------------------------------------------------


def _chunks(spark, d):
    return _t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("location_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("anchor"), (F.col("l_discount") + F.col("l_tax")).alias("distance"))


_HITS = "ch AS (SELECT l_orderkey || '-' || l_linenumber AS chunk_id, l_orderkey AS location_id, l_linenumber AS chunk_index, l_partkey AS anchor, l_discount + l_tax AS distance FROM lineitem), hits AS (SELECT 0 AS query_id, * FROM ch WHERE chunk_index = 1)"


def _hits(spark, d):
    return _chunks(spark, d).where("chunk_index = 1").withColumn("query_id", F.lit(0))


@query(f"WITH {_HITS}, f AS (SELECT h.query_id, h.location_id, c.chunk_id, c.chunk_index, min(h.distance) AS dist FROM hits h JOIN ch c USING (location_id) WHERE c.chunk_id NOT IN (SELECT chunk_id FROM hits) GROUP BY ALL) SELECT query_id, location_id, chunk_id, round(dist * 1.05, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, location_id ORDER BY chunk_index, chunk_id) AS r FROM f) WHERE r <= 2")
def sibling_expansion(spark, d):
    return retrieve.siblings(_hits(spark, d), _chunks(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_HITS}, m AS (SELECT DISTINCT 0 AS query_id, p_partkey AS anchor FROM part WHERE p_partkey NOT IN (SELECT anchor FROM hits)), m2 AS (SELECT * FROM m ORDER BY anchor LIMIT 10), x AS (SELECT m2.query_id, m2.anchor, ch.chunk_id, ch.distance FROM m2 JOIN ch USING (anchor) WHERE ch.chunk_id NOT IN (SELECT chunk_id FROM hits)) SELECT query_id, anchor, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor ORDER BY distance, chunk_id) AS r FROM x) WHERE r <= 3")
def anchor_injection(spark, d):
    hints = _t(spark, d, "part").select(F.lit(0).alias("query_id"), F.col("p_partkey").alias("anchor"))
    return retrieve.inject_anchors(_hits(spark, d), hints, _chunks(spark, d)).select("query_id", "anchor", "chunk_id")


# --- graph ---------------------------------------------------------------------------------------


def _mentions(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("pos"))


_PAIRS = "m AS (SELECT DISTINCT l_orderkey AS c, l_partkey::VARCHAR AS n FROM lineitem), e AS (SELECT a.n AS src, b.n AS dst, count(*) AS count FROM m a JOIN m b ON a.c = b.c AND a.n < b.n GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE count >= 2")
def cooccurrence_edges(spark, d):
    return graph.cooccurrence(_mentions(spark, d))


@query(f"WITH {_PAIRS} SELECT src, dst, count, round(count / (SELECT max(count) FROM e WHERE count >= 2), 6) AS weight FROM e WHERE count >= 2")
def edge_weights(spark, d):
    return graph.weighted(graph.cooccurrence(_mentions(spark, d))).withColumn("weight", F.round("weight", 6))


@query("WITH l AS (SELECT l_partkey AS node, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS grp FROM lineitem GROUP BY ALL) SELECT a.node AS src, b.node AS dst, a.grp FROM l a JOIN l b ON a.grp = b.grp AND a.node < b.node")
def same_chapter_edges(spark, d):
    return graph.same_group(_mentions(spark, d).select("node", "grp", F.struct("chunk_id", "pos").alias("pos")))


@query("SELECT l_partkey AS node, count(*) AS mention_count FROM lineitem GROUP BY ALL")
def node_stats(spark, d):
    return graph.node_stats(_mentions(spark, d))


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS count FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL")
def cites_edges(spark, d):
    return graph.cites(_mentions(spark, d).withColumnRenamed("grp", "src"))


_ADJ = f"{_PAIRS}, ew AS (SELECT src, dst, count / (SELECT max(count) FROM e WHERE count >= 2) AS w FROM e WHERE count >= 2), adj AS (SELECT src, dst, w FROM ew UNION ALL SELECT dst, src, w FROM ew)"


def _adjacent(spark, d):
    return graph.both_ways(graph.weighted(graph.cooccurrence(_mentions(spark, d))))


@query(f"WITH {_ADJ}, s AS (SELECT DISTINCT src AS seed FROM adj), one AS (SELECT seed, dst AS node, w AS score FROM s JOIN adj ON seed = src), two AS (SELECT o.seed, a.dst AS node, o.score * a.w * 0.5 AS score FROM one o JOIN adj a ON o.node = a.src WHERE a.dst <> o.seed) SELECT seed, node, round(max(score), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL")
def related_two_hop(spark, d):
    adj = _adjacent(spark, d)
    seeds = adj.select(F.col("src").alias("seed")).distinct()
    return graph.related(adj, seeds).withColumn("score", F.round("score", 6))


@query(f"WITH {_ADJ}, s AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey::VARCHAR AS seed FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT query_id, count(*) AS n FROM s GROUP BY 1), u AS (SELECT DISTINCT src, dst FROM adj) SELECT query_id, dst AS node FROM s JOIN u ON src = seed JOIN n USING (query_id) GROUP BY query_id, dst, n HAVING count(*) = n")
def co_cited_all(spark, d):
    """The parts of an order's first two lines are its seeds."""
    seeds = _t(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("seed"))
    return graph.co_cited(_adjacent(spark, d), seeds)


@query("WITH n AS (SELECT l_partkey AS node, count(*) AS mention_count FROM lineitem GROUP BY ALL) SELECT node AS number, mention_count, (21 - node) + 0.5 * mention_count AS score FROM n WHERE node BETWEEN 1 AND 20 ORDER BY score DESC, node LIMIT 5")
def scope_articles(spark, d):
    return graph.scope_articles(graph.node_stats(_mentions(spark, d)).withColumnRenamed("node", "number"))


@query("WITH a AS (SELECT DISTINCT l_linenumber::BIGINT AS node, l_linenumber::BIGINT AS pos, 0 AS prio FROM lineitem), b AS (SELECT node, row_number() OVER (ORDER BY k DESC, node) AS pos, 1 AS prio FROM (SELECT l_partkey AS node, count(*) AS k FROM lineitem GROUP BY 1) ORDER BY k DESC, node LIMIT 25), u AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY prio, pos) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT node, pos, prio FROM u WHERE r = 1 ORDER BY prio, pos, node LIMIT 30")
def expansion_priority(spark, d):
    from pyspark.sql import Window

    asked = _t(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("node")).distinct().withColumn("pos", F.col("node"))
    top = graph.node_stats(_mentions(spark, d)).orderBy(F.desc("mention_count"), "node").limit(25)
    top = top.select("node", F.row_number().over(Window.orderBy(F.desc("mention_count"), "node")).cast("long").alias("pos"))
    return graph.prioritised([asked, top], [None, 25])


# --- run metrics ---------------------------------------------------------------------------------

_RUNS = "r AS (SELECT event_type AS mode, user_id, CAST(ts AS DATE) AS day, value, CASE WHEN value < 60 THEN 1 ELSE 0 END AS passed, event_id, ts FROM events)"


def _runs(spark, d):
    return _t(spark, d, "events").select(F.col("event_type").alias("mode"), "user_id", F.to_date("ts").alias("day"), "value", F.when(F.col("value") < 60, 1).otherwise(0).alias("passed"), "event_id", "ts")


@query(f"WITH {_RUNS} SELECT 100.0 * sum(passed) / count(*) AS pass_rate FROM r")
def pass_rate_unified(spark, d):
    return _runs(spark, d).agg(metrics.pass_rate(F.col("passed"), F.lit(1)).alias("pass_rate"))


@query(f"WITH {_RUNS} SELECT mode, count(*) AS total, 100.0 * sum(passed) / count(*) AS pass_rate FROM r WHERE mode IS NOT NULL GROUP BY mode")
def pass_rate_by_mode(spark, d):
    return _runs(spark, d).where("mode is not null").groupBy("mode").agg(F.count("*").alias("total"), metrics.pass_rate(F.col("passed"), F.lit(1)).alias("pass_rate"))


@query("SELECT CASE WHEN length(text) < 1000 THEN 'easy' WHEN length(text) < 3000 THEN 'medium' WHEN length(text) < 10000 THEN 'hard' ELSE 'Uklassificeret' END AS difficulty, count(*) AS total, 100.0 * sum(quality) / count(*) AS pass_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def pass_rate_by_difficulty(spark, d):
    n = F.length("text")
    level = F.coalesce(F.when(n < 1000, "easy").when(n < 3000, "medium").when(n < 10000, "hard"), F.lit("Uklassificeret"))
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").groupBy(level.alias("difficulty")).agg(F.count("*").alias("total"), metrics.pass_rate(F.col("quality"), F.lit(1)).alias("pass_rate"))


@query("WITH s AS (SELECT doc_id, 'quality' AS scorer, quality AS p FROM labels UNION ALL SELECT doc_id, 'clean', 1 - toxic FROM labels) SELECT scorer, count(*) AS n, 100.0 * sum(p) / count(*) AS pass_rate FROM s GROUP BY scorer")
def scorer_pass_rates(spark, d):
    scores = F.map_from_arrays(F.array(F.lit("quality"), F.lit("clean")), F.array(F.col("quality"), 1 - F.col("toxic")))
    return _t(spark, d, "labels").select(F.explode(scores).alias("scorer", "p")).groupBy("scorer").agg(F.count("*").alias("n"), metrics.pass_rate(F.col("p"), F.lit(1)).alias("pass_rate"))


@query(f"WITH {_RUNS}, g AS (SELECT user_id, sum(passed) AS p, count(*) AS n FROM r GROUP BY 1) SELECT round(avg(100.0::DOUBLE * p / n), 2) AS macro_rate FROM g")
def macro_pass_rate(spark, d):
    return metrics.macro_rate(_runs(spark, d).groupBy("user_id").agg(F.sum("passed").alias("passed"), F.count("*").alias("total")))


@query("SELECT round(quantile_cont(value, 0.5) / 1000.0, 3) AS p50, round(quantile_cont(value, 0.95) / 1000.0, 3) AS p95, round(quantile_cont(value, 0.99) / 1000.0, 3) AS p99 FROM events")
def latency_percentiles(spark, d):
    return metrics.percentiles(_t(spark, d, "events"), "value")


@query("WITH r AS (SELECT event_type AS mode, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT mode, max(value) FILTER (r = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (r = floor(0.95 * (n - 1))) AS p95 FROM r GROUP BY mode")
def latency_floor_percentiles(spark, d):
    return metrics.floor_rank(_runs(spark, d), "mode", "value")


@query("SELECT event_type AS mode, round(median(value), 9) AS median_value FROM events WHERE value > 0 GROUP BY 1")
def latency_median(spark, d):
    return metrics.median(_runs(spark, d).where("value > 0"), "mode", "value", "median_value").withColumn("median_value", F.round("median_value", 9))


@query("WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)) + 1, 10)::INT AS bin, count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY 1) SELECT g::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM generate_series(1, 10) AS t(g) LEFT JOIN c ON c.bin = g")
def latency_histogram(spark, d):
    return metrics.histogram(_t(spark, d, "events"), "value")


@query(f"WITH {_RUNS}, dd AS (SELECT mode, day, 100.0::DOUBLE * sum(passed) / count(*) AS rate FROM r GROUP BY ALL), w AS (SELECT *, avg(rate) OVER (PARTITION BY mode ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY mode ORDER BY day DESC) AS k FROM dd) SELECT mode, CASE WHEN b IS NULL THEN 'insufficient' WHEN rate - b > 2 THEN 'improving' WHEN rate - b < -2 THEN 'declining' ELSE 'stable' END AS direction FROM w WHERE k = 1")
def trend_direction(spark, d):
    days = _runs(spark, d).groupBy("mode", "day").agg(metrics.pass_rate(F.col("passed"), F.lit(1)).alias("rate")).withColumnRenamed("day", "ts").withColumn("run_id", F.lit(0))
    return metrics.trend(days, "mode").select("mode", "direction")


@query(f"WITH {_RUNS}, g AS (SELECT day, round(median(value), 9) AS median_value FROM r GROUP BY day) SELECT day, median_value FROM g ORDER BY day DESC LIMIT 20")
def latency_trend(spark, d):
    return metrics.median(_runs(spark, d), "day", "value", "median_value").withColumn("median_value", F.round("median_value", 9)).orderBy(F.desc("day")).limit(20)


@query(f"WITH {_RUNS} SELECT day, count(*) AS n, 100.0 * count(*) FILTER (mode = 'purchase') / count(*) AS rate FROM r GROUP BY day")
def daily_rates(spark, d):
    return _runs(spark, d).groupBy("day").agg(F.count("*").alias("n"), metrics.pass_rate((F.col("mode") == "purchase").cast("int"), F.lit(1)).alias("rate"))


@query(f"WITH {_RUNS} SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM r) WHERE k = 1")
def latest_per_key(spark, d):
    return metrics.latest(_runs(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


# --- text ----------------------------------------------------------------------------------------


def _said(key):
    """The sentence for a row's key."""
    return F.element_at(F.array(*map(F.lit, W.SAID)), (key % len(W.SAID) + 1).cast("int"))


_SPOKEN = f"t AS (SELECT doc_id, lower(text) AS text FROM documents UNION ALL SELECT -1 - doc_id, lower({W.said('doc_id')}) FROM documents)"


def _spoken(spark, d):
    """The documents, and for each a sentence that rules hit or miss."""
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", "text").union(docs.select(-1 - F.col("doc_id"), _said(F.col("doc_id"))))


@query(f"WITH {_SPOKEN} SELECT doc_id, CASE WHEN {W.holds(W.ENFORCEMENT)} OR {W.stands('forbud')} THEN 'ENFORCEMENT' WHEN {W.holds(W.STRONG)} OR ({W.holds(W.WEAK)} AND {W.holds(W.VERBS)}) THEN 'REQUIREMENTS' WHEN {W.holds(W.CLASSIFICATION)} THEN 'CLASSIFICATION' WHEN {W.holds(W.SCOPE)} OR (contains(text, 'gælder') AND doc_id % 2 = 0) THEN 'SCOPE' ELSE 'GENERAL' END AS intent FROM t")
def claim_intent(spark, d):
    return _spoken(spark, d).select("doc_id", F.coalesce(T.claim_intent(F.col("text"), F.col("doc_id") % 2 == 0), F.lit("GENERAL")).alias("intent"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {W.stands(p, 'said')} THEN '{n}'" for n, p in W.QUERY_INTENT) + f" ELSE 'CONTEXT' END AS intent FROM (SELECT *, text || ' ' || {W.said('conv_id + turn')} AS said FROM conversations)")
def query_intent(spark, d):
    said = F.concat("text", F.lit(" "), _said(F.col("conv_id") + F.col("turn")))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.query_intent(said).alias("intent"))


@query(f"""WITH {_SPOKEN}, c AS (SELECT doc_id, list_filter({W.listed(W.ENFORCEMENT)}, lambda w: contains(text, w)) || CASE WHEN {W.stands('forbud')} THEN ['forbud'] ELSE [] END AS e,
list_filter({W.listed(W.STRONG)}, lambda w: contains(text, w)) AS s, list_filter({W.listed(W.WEAK)}, lambda w: contains(text, w)) AS w, list_filter({W.listed(W.VERBS)}, lambda w: contains(text, w)) AS v FROM t)
SELECT doc_id, len(e) > 0 AS enforcement, list_sort(list_distinct(e)) AS enforcement_cues, len(s) > 0 OR (len(w) > 0 AND len(v) > 0) AS requirements, list_sort(list_distinct(s || w || v)) AS requirements_cues FROM c""")
def intent_cues(spark, d):
    return _spoken(spark, d).select("doc_id", T.intent_cues(F.col("text")).alias("c")).select("doc_id", "c.*")


@query(f"WITH {_SPOKEN} SELECT doc_id, {W.stands(W.NORMATIVE)} AS normative FROM t")
def normative_claims(spark, d):
    return _spoken(spark, d).select("doc_id", T.is_normative(F.col("text")).alias("normative"))


@query("SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d{1,3})\\]', 1), lambda x: x::INT))) AS cited FROM documents")
def bracket_citations(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.bracket_citations(F.col("text")).alias("cited"))


@query("WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS h FROM documents) SELECT h AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM h GROUP BY h HAVING count(*) > 1")
def text_hash_dupes(spark, d):
    return _t(spark, d, "documents").groupBy(T.text_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT doc_id, 'chunk:v1/' || source || '/locv1article' || (doc_id % 50) || '/' || doc_id || '/' || substr(sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), 1, 12) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    loc = T.location_id(article=(F.col("doc_id") % 50).cast("string"))
    return _t(spark, d, "documents").select("doc_id", T.chunk_id(F.col("source"), loc, F.col("doc_id"), T.text_hash(F.col("text"))).alias("chunk_id"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g') <> text AS has_mail, length(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\\+?\\d(?:[ ()-]*\\d){7,}', '[PHONE]', 'g')) AS n FROM documents")
def redaction(spark, d):
    mail = F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return _t(spark, d, "documents").select("doc_id", (mail != F.col("text")).alias("has_mail"), F.length(T.redact(F.col("text"))).cast("long").alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<h[1-6][ >]')) AS headings, len(regexp_extract_all(html, '<a[ >]')) AS links, len(regexp_extract_all(html, '<script[ >]')) AS scripts FROM pages")
def preflight_counts(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return _t(spark, d, "pages").select("page_id", n("<p[ >]").alias("paragraphs"), n("<h[1-6][ >]").alias("headings"), n("<a[ >]").alias("links"), n("<script[ >]").alias("scripts"))


@query("SELECT source, count(*) AS total, count(*) FILTER (contains(text, chr(10))) AS structured, 100.0 * count(*) FILTER (contains(text, chr(10))) / count(*) AS coverage FROM documents GROUP BY source")
def structure_coverage(spark, d):
    has = F.col("text").contains("\n")
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(has).alias("structured"), (100.0 * F.count_if(has) / F.count("*")).alias("coverage"))


# --- validation and scorers ----------------------------------------------------------------------


@query("WITH c AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS cited FROM orders GROUP BY 1) SELECT k, len(list_intersect(['1-URGENT', '2-HIGH', '3-MEDIUM'], cited)) / 3.0 AS score, len(list_intersect(['1-URGENT', '2-HIGH', '3-MEDIUM'], cited)) = 3 AS passed FROM c")
def corpus_coverage(spark, d):
    required = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    c = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("cited"))
    return c.select("k", validate.coverage(F.col("cited"), required).alias("s")).select("k", "s.score", "s.passed")


@query("WITH c AS (SELECT l_orderkey AS k, l_suppkey AS i, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT k, max(n) / sum(n) AS share, arg_max(i, (n, -i)) AS dominant FROM c GROUP BY k) SELECT k, dominant, share <= 0.7 AS passed, round(CASE WHEN share <= 0.7 THEN 1.0 ELSE 1.0 - share END, 6) AS score FROM g")
def synthesis_balance(spark, d):
    c = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("i")).agg(F.count("*").alias("n"))
    return validate.balance(c, "k", "i", "n").withColumn("score", F.round("score", 6))


@query("WITH c AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS flags, list(DISTINCT l_linestatus) AS st FROM lineitem GROUP BY 1) SELECT k, len(list_intersect(['A', 'N'], flags)) / len(flags) AS precision, len(list_intersect(['A', 'N'], flags)) / 2 AS recall FROM c")
def role_precision_recall(spark, d):
    c = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("flags"))
    return c.select("k", validate.precision_recall(F.array(F.lit("A"), F.lit("N")), F.col("flags")).alias("s")).select("k", "s.precision", "s.recall")


@query("WITH g AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderstatus) AS u FROM orders GROUP BY 1) SELECT k, CASE WHEN n > 1 THEN 1 - (u - 1) / (n - 1) ELSE 1.0 END AS score, CASE WHEN n > 1 THEN 1 - (u - 1) / (n - 1) >= 0.8 ELSE true END AS passed FROM g")
def role_consistency(spark, d):
    runs = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.array("o_orderstatus").alias("roles"))
    return validate.consistency(runs, "k", "roles")


_CITED = "list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[(\\d{1,3})\\]', 1), lambda x: x::INT)))"


@query(f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' [1][2]' WHEN doc_id % 3 = 1 THEN ' [4]' ELSE '' END AS a, list_filter([1, 2, 3], lambda x: x <= doc_id % 4) AS st, list_filter([1, 2, 3], lambda x: x <= doc_id % 3) AS li FROM documents),
c AS (SELECT *, {_CITED} AS cited, list_filter(regexp_split_to_array(a, '\\n[ \\t\\n\\r\\f\\x0B]*\\n'), lambda p: length(trim(p)) > 0) AS ps FROM t),
f AS (SELECT doc_id, cited, st, li, len(list_filter(ps, lambda p: regexp_matches(lower(p), '(^|[^\\p{{L}}\\p{{N}}_])({W.NORMATIVE})($|[^\\p{{L}}\\p{{N}}_])') AND NOT regexp_matches(p, '\\[\\d{{1,3}}\\]'))) > 0 AS bare, len(cited) > 0 AND len(st) = 0 AS stop FROM c)
SELECT doc_id, array_to_string(list_filter([CASE WHEN bare THEN 'NORMATIVE_WITHOUT_BRACKET_CITATION' END, CASE WHEN len(cited) < 1 THEN 'MIN_CITATIONS_NOT_MET' END, CASE WHEN stop THEN 'CITATIONS_WITHOUT_STRUCTURED_REFS' END,
CASE WHEN NOT stop AND len(list_filter(cited, lambda x: NOT list_contains(st, x))) > 0 THEN 'CITED_IDX_MISSING_IN_STRUCTURED' END, CASE WHEN NOT stop AND len(cited) > 0 AND len(list_intersect(cited, st)) = 0 THEN 'CITATIONS_NO_MATCHING_REFS' END,
CASE WHEN NOT stop AND len(list_filter(st, lambda x: NOT list_contains(cited, x))) > 0 THEN 'UNCITED_STRUCTURED_REFS' END, CASE WHEN NOT stop AND len(cited) > 1 THEN 'MAX_CITATIONS_EXCEEDED' END,
CASE WHEN NOT stop AND len(cited) > 0 AND len(li) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(li, x))) > 0 THEN 'REN_NUMBERING_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS codes FROM f""")
def contract_violations(spark, d):
    n = lambda k: F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda x: x <= F.col("doc_id") % k)
    answer = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " [1][2]").when(F.col("doc_id") % 3 == 1, " [4]").otherwise(""))
    return _t(spark, d, "documents").select("doc_id", F.array_join(validate.contract_violations(answer, n(4), n(3), 1, 1), ",").alias("codes"))


# --- history and inventory -----------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def history_last_n(spark, d):
    return rank.top_k(_t(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "role")


@query("WITH a AS (SELECT conv_id, max(turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, max(c.turn) AS user_turn, any_value(a.a) AS assistant_turn FROM conversations c JOIN a ON c.conv_id = a.conv_id AND c.turn < a.a WHERE c.role = 'user' GROUP BY 1")
def last_exchange(spark, d):
    c = _t(spark, d, "conversations")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("assistant_turn"))
    return c.where("role = 'user'").join(last, "conv_id").where("turn < assistant_turn").groupBy("conv_id", "assistant_turn").agg(F.max("turn").alias("user_turn")).select("conv_id", "user_turn", "assistant_turn")


@query("SELECT coalesce(c.c_custkey, o.k) AS k, CASE WHEN o.k IS NULL THEN 'not_ingested' WHEN c.c_custkey IS NULL THEN 'local_only' ELSE 'ingested' END AS status, coalesce(n, 0)::BIGINT AS n FROM customer c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.k")
def inventory_status_join(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    j = _t(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("k"), "full")
    return j.select(F.coalesce("c_custkey", "k").alias("k"), F.when(F.col("k").isNull(), "not_ingested").when(F.col("c_custkey").isNull(), "local_only").otherwise("ingested").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def html_chunks(spark, d):
    rows = passages.identified(passages.passages(_t(spark, d, "pages"), _tokenizer()))
    return rows.select("page_id", "chunk_index", "chapter", "section", "article", "paragraph", "litra", "annex", "heading", "text", "n_tokens", "location_id", "text_hash", "chunk_id")


_STRIPPED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&(amp|am|quot|copy|middot);?', ' ', 'g'), '<head>.*</head>|<nav>.*?</nav>|<!--.*?-->|<!DOCTYPE[^>]*>', ' ', 'gs'), '</?(b|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')"""


@query(f"""WITH w AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower({_STRIPPED}), '[^\\p{{L}}]+'), lambda x: len(x) > 4)) AS words FROM pages)
SELECT page_id, len(words)::BIGINT AS n_words, md5(array_to_string(list_sort(words), ' ')) AS words_md5, 0::BIGINT AS over_budget FROM w""")
def html_passage_words(spark, d):
    """The words of over four letters that a page's headings and passages hold, whatever their cuts; SQL reads them off the page itself."""
    pages = _t(spark, d, "pages").select("page_id", "html")
    passages.register(spark)
    found = spark.sql("SELECT page_id, concat_ws(' ', c.heading, c.text) AS text, c.n_tokens FROM {pages}, LATERAL html_passages(html, 'generic', :tokenizer, 500, 100) c", args={"tokenizer": _tokenizer()}, pages=pages)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) > 4)
    each = found.select("page_id", F.explode(words).alias("w"), (F.col("n_tokens") > 500).cast("long").alias("over"))
    return each.groupBy("page_id").agg(F.array_sort(F.collect_set("w")).alias("words"), F.sum("over").alias("over_budget")).select("page_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"), "over_budget")
