"""Ranking, fusion and selection over candidate rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def bm25(candidates: DataFrame, query: str = "query_id", doc: str = "doc_id", question: str = "question", body: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, bm25) with statistics of each query's candidate set; candidates without a match score zero."""
    rows = candidates.select(query, doc, F.array_distinct(T.lexical_tokens(F.col(question))).alias("terms"), T.lexical_tokens(F.col(body)).alias("tokens"))
    rows = rows.select(query, doc, F.size("tokens").alias("dl"), F.filter("tokens", lambda t: F.array_contains("terms", t)).alias("hits"))
    pool = Window.partitionBy(query)  # a candidate set, which is bounded
    rows = rows.withColumn("n", F.count("*").over(pool)).withColumn("avgdl", F.avg("dl").over(pool))
    tf = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).alias("f")))
    rows = rows.select(query, doc, "dl", "n", "avgdl", F.explode_outer(tf).alias("t")).select(query, doc, "dl", "n", "avgdl", "t.*")
    rows = rows.withColumn("df", F.count("term").over(Window.partitionBy(query, "term")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = k1 * (1.0 - b + b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    weight = F.when(F.col("term").isNotNull(), idf * F.col("f") * (k1 + 1.0) / (F.col("f") + norm)).otherwise(0.0)
    return rows.groupBy(query, doc).agg(F.sum(weight).alias("bm25"))


def corpus_tasks(questions: DataFrame, docs: DataFrame, pairs: int = 500_000) -> tuple[int, int]:
    """(questions, tasks): as many tasks as hold so many pairs of document and question each."""
    asked = questions.count()
    return asked, min(max(docs.sparkSession.sparkContext.defaultParallelism, -(-asked * docs.count() // pairs)), 20_000)


def bm25_corpus(questions: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, also: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """bm25 over all documents, by an inverted join on terms: the pairs with a common term, and those of every question with also (doc_id); any other pair's score is zero.

    A document's counts are made in its row and dealt by doc_id once; its pairs
    with questions are made and added up in that task, so no pair is shuffled.
    """
    from .retrieve import BROADCAST_ROWS  # bounds the questions' words, not the documents'

    tasks = tasks or corpus_tasks(questions, docs)[1]
    tokens = docs.select("doc_id", T.lexical_tokens(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), "tokens")
    stats = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = questions.select("query_id", F.explode(F.array_distinct(T.lexical_tokens(F.col("question")))).alias("term"))
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # of the questions alone; a join with the words' counts adds no row
    small = F.broadcast if few else (lambda x: x)
    tf = tokens.select("doc_id", "dl", F.explode(T.term_counts(F.col("tokens"))).alias("t")).select("doc_id", "dl", "t.term", "t.f").join(small(terms.select("term").distinct()), "term", "left_semi").select("doc_id", "dl", "term", "f")
    if also is not None:
        tf = tf.unionByName(also.select("doc_id", F.lit(0).alias("dl"), F.lit("").alias("term"), F.lit(0).alias("f")))  # no token is empty
    tf = tf.repartition(tasks, "doc_id").groupBy("doc_id", "dl", "term").agg(F.sum("f").alias("f"))
    df = tf.groupBy("term").agg(F.count("f").alias("df"))  # counts f, so that it reads the same exchange
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("f") * (k1 + 1.0) / (F.col("f") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    terms = terms.join(df.where("term <> ''"), "term")
    if also is not None:
        terms = terms.unionByName(questions.select("query_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("df")))
    posting = tf.join(small(terms), "term").crossJoin(F.broadcast(stats)).select("query_id", "doc_id", F.when(F.col("term") == "", 0.0).otherwise(weight).alias("w"))  # stats is one row; a row of terms for each question and word: frequent words needn't meet in one task
    return posting.groupBy("query_id", "doc_id").agg(F.sum("w").alias("bm25"))


def min_max(df: DataFrame, value: str, over: list[str], name: str) -> DataFrame:
    """df with value scaled to 0..1 in its group, 0 where all are equal; groups meet only as their bounds."""
    bounds = df.groupBy(*(F.col(c).alias(f"{name}__{c}") for c in over)).agg(F.min(value).alias(f"{name}__low"), F.max(value).alias(f"{name}__high"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{name}__{c}")) for c in over))
    low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
    scaled = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))
    return df.join(bounds, same).select(*df.columns, scaled.alias(name))


def min_max_in_pool(value: str, over: list[str]) -> Column:
    """min_max as a column, for groups that are candidate sets of bounded size."""
    w = Window.partitionBy(*over)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def hybrid_score(vec: Column, lexical: Column, citation: Column, role: Column, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.35, 0.15)) -> Column:
    if not 0.95 <= sum(weights) <= 1.05:
        raise ValueError("weights must add up to one")
    return sum((w * c for w, c in zip(weights, (vec, lexical, citation, role), strict=True)), F.lit(0.0))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the order must end in a unique key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def reciprocal_rank_fusion(hits: DataFrame, k: int = 60, top: int = 100) -> DataFrame:
    """(query_id, corpus_id, chunk_id, rrf, position) over hits (query_id, corpus_id, chunk_id, distance)."""
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "corpus_id").orderBy("distance", "chunk_id")))
    fused = ranked.groupBy("query_id", "corpus_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("r"))).alias("rrf"))
    return top_k(fused, ["query_id"], [F.desc("rrf"), F.asc("corpus_id"), F.asc("chunk_id")], top, "position")


def diversify(hits: DataFrame, query: str, group: str, order: list[Column], most: int = 2) -> DataFrame:
    """At most so many hits of each group per query; hits without a group stay."""
    n = F.row_number().over(Window.partitionBy(query, group).orderBy(*order))
    return hits.withColumn("in_group", n).where(F.col(group).isNull() | (F.col("in_group") <= most))


def score_floor(hits: DataFrame, score: str, distance: str, below: float = 0.85, share: float = 0.5) -> DataFrame:
    """A hit nearer than below keeps at least share * (1 - distance)."""
    return hits.withColumn("floored", F.when(F.col(distance) < below, F.greatest(F.col(score), share * (1 - F.col(distance)))).otherwise(F.col(score)))


def sandwich(items: DataFrame, by: str, rank: str) -> DataFrame:
    """Best first, second best last, and so on inwards; up to three keep their order."""
    n = F.count("*").over(Window.partitionBy(by))
    key = F.when(n <= 3, F.col(rank)).when(F.col(rank) % 2 == 1, F.col(rank)).otherwise(2 * n + 2 - F.col(rank))
    return items.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(key)))


def precision_score(meta: Column, hints: Column | None = None) -> Column:
    """How exactly a passage's place is known: 5 for a hinted anchor, 4 article and paragraph, 3 article, 2 recital, 1 annex."""
    has = lambda k: F.coalesce(F.length(F.trim(F.try_element_at(meta, F.lit(k)))) > 0, F.lit(False))
    level = F.when(has("article") & has("paragraph"), 4).when(has("article"), 3).when(has("recital"), 2).when(has("annex"), 1).otherwise(0)
    return level if hints is None else F.when(F.coalesce(F.arrays_overlap(T.anchors(meta, with_point=False), hints), F.lit(False)), 5).otherwise(level)


def precise_first(hits: DataFrame, query: str, precise: Column, order: list[Column], k: int) -> DataFrame:
    """Hits with an article, annex or chapter before the others, each part in order, k per query."""
    return top_k(hits.withColumn("precise", F.coalesce(precise, F.lit(False))), [query], [F.desc("precise"), *order], k)


def role_rerank(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits (distance, delta, pos) by -distance + delta; equal ones keep their order."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.col("delta") - F.col("distance")), "pos")))


def protected(hits: DataFrame, query: str = "query_id", below: float = 0.85, first: int = 3) -> DataFrame:
    """Hits among the first of a query and nearer than below, which no later step may drop."""
    return top_k(hits, [query], [F.asc("distance"), F.asc("chunk_id")], first).where(F.col("distance") < below)


def candidate_score(hits: DataFrame, query: str = "query_id", weights: tuple[float, float, float, float] = (0.25, 0.25, 0.35, 0.15)) -> DataFrame:
    """The score over candidates (distance, bm25, hinted boolean, delta or null for no profile): similarity and BM25 scaled
    within the query, 1 for a hinted anchor, and the role delta moved to 0..1 (0.5 without a profile)."""
    role = F.when(F.col("delta").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("delta") + 0.15) / 0.33)))
    near = hits.withColumn("near", 1.0 / (1.0 + F.col("distance"))).withColumn("vec", min_max_in_pool("near", [query])).withColumn("lexical", min_max_in_pool("bm25", [query]))
    return near.withColumn("score", hybrid_score(F.col("vec"), F.col("lexical"), F.col("hinted").cast("double"), role, weights)).drop("near", "vec", "lexical")


def second_pass(first: DataFrame, wider: DataFrame, query: str = "query_id", least: int = 2) -> DataFrame:
    """Hits of the first pass (citable boolean), but the citable ones of a wider pass for queries with fewer than least;
    such a query keeps its first hits if the wider pass found none."""
    enough = first.groupBy(query).agg((F.count_if("citable") >= least).alias("enough"))
    better = wider.where("citable").join(enough.where("not enough"), query, "left_semi")
    return first.join(better.select(query).distinct(), query, "left_anti").unionByName(better)
