"""The chained retrieval: search, expansion along the graph, hybrid ranking, context selection; and its rescue steps.

Hits are rows (query_id, chunk_id, distance, ...); a query's candidates are a
pool of bounded size, so arrays over one query's pool are bounded too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import text as T
from ..sources.stored import new_folder, stored
from . import planning, rank, retrieve

_KINDS = ("article", "recital", "annex")


def _covers(a: Column, b: Column) -> Column:
    """The same anchor, or one is a part of the other."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit(":"))) | F.startswith(b, F.concat(a, F.lit(":")))


def select_context(hits: DataFrame, hints: DataFrame, cap: Column | int = 20) -> DataFrame:
    """(query_id, chunk_id, rank, position): which citable hits go into the context.

    hits: query_id, chunk_id, rank (1 is the best), anchor or null, citable.
    hints: query_id, hints (an array of anchors).  First each hint, in the order
    of its best hit, takes its best hit that isn't taken yet, an anchor and its
    parts standing for each other; a hint met, and what it is part of, is done.
    Then hits follow by rank.  One array a query, of its pool.
    """
    most = F.lit(cap) if isinstance(cap, int) else cap
    pool = hits.where("citable").withColumn("most", most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "anchor"))).alias("pool"), F.max("most").alias("most"))
    rows = pool.join(hints.select("query_id", "hints"), "query_id", "left").withColumn("n", F.size("pool"))
    all_places = F.sequence(F.lit(1), F.col("n"))
    fits = lambda h: F.filter(all_places, lambda i: F.coalesce(_covers(F.col("pool")[i - 1]["anchor"], h), F.lit(False)))
    asked = F.transform(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.struct(fits(h).alias("fit"), h.alias("hint")))
    asked = F.array_sort(F.transform(asked, lambda x: F.struct(F.coalesce(F.try_element_at(x["fit"], F.lit(1)), F.lit(999_999)).alias("first"), x["hint"].alias("hint"), x["fit"].alias("fit"))))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("done"))

    def take(state, x):
        spot = F.try_element_at(F.array_except(x["fit"], state["taken"]), F.lit(1))
        parts = F.split(x["hint"], ":")
        wider = F.transform(F.sequence(F.least(F.lit(2), F.size(parts)), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))
        stays = F.array_contains(state["done"], x["hint"]) | (F.size(state["taken"]) >= F.col("most")) | spot.isNull()
        return F.when(stays, state).otherwise(F.struct(F.array_append(state["taken"], spot).alias("taken"), F.concat(state["done"], F.array(x["hint"]), wider).alias("done")))

    first = F.aggregate(asked, start, take)["taken"]
    chosen = rows.withColumn("first", first).withColumn("chosen", F.slice(F.concat("first", F.array_except(all_places, F.col("first"))), F.lit(1), F.col("most")))
    out = chosen.select("query_id", "pool", F.posexplode("chosen").alias("at", "spot"))
    return out.select("query_id", F.col("pool")[F.col("spot") - 1]["chunk_id"].alias("chunk_id"), F.col("pool")[F.col("spot") - 1]["rank"].alias("rank"), (F.col("at") + 1).alias("position"))


def _of_anchor(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked (query_id, corpus_id, anchor) with the chunks (corpus_id, kind, value, chunk_id, ...) of the anchor, whatever its case."""
    parts = F.split("anchor", ":", 2)
    wanted = asked.withColumn("kind", F.lower(F.trim(parts[0]))).withColumn("value", F.upper(F.trim(F.try_element_at(parts, F.lit(2))))).where(F.col("kind").isin(*_KINDS) & (F.col("value") != ""))
    held = chunks.select("query_id", "corpus_id", "kind", F.upper("value").alias("value"), "chunk_id", "distance")
    return wanted.join(held, ["corpus_id", "kind", "value"])


def inject_hints(hits: DataFrame, hints: DataFrame, chunks: DataFrame, top_k: int = 20, most_anchors: int = 10) -> DataFrame:
    """(query_id, anchor, chunk_id, distance): for each of the first hinted anchors, its nearest chunks of the query that aren't hits.

    hints: query_id, corpus_id, anchor; chunks: query_id, corpus_id, kind, value, chunk_id, distance to the question.
    """
    first = rank.top_k(hints.select("query_id", "corpus_id", "anchor").distinct(), ["query_id"], [F.asc("anchor")], most_anchors, "a").drop("a")
    found = _of_anchor(first.withColumnRenamed("query_id", "asker"), chunks).where("asker = query_id")
    near = rank.top_k(found.select("query_id", "anchor", "chunk_id", "distance"), ["query_id", "anchor"], [F.asc("distance"), F.asc("chunk_id")], min(max(top_k, 3), 10)).drop("rank")
    fresh = near.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return rank.top_k(fresh, ["query_id", "chunk_id"], [F.asc("anchor")], 1).select("query_id", "anchor", "chunk_id", "distance")


def missing_anchors(required: DataFrame, present: DataFrame) -> DataFrame:
    """(query_id, anchor) to rescue: of each any-list that no present anchor meets the first, of the all-list every missing one.

    required: query_id, any_of, any_of_2, all_of; present: query_id, anchor.
    """
    have = present.groupBy("query_id").agg(F.collect_set("anchor").alias("have"))
    rows = required.join(have, "query_id", "left")
    got = F.coalesce("have", F.array().cast("array<string>"))
    listed = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda a: a.contains(":"))))
    of_any = [F.when((F.size(listed(c)) > 0) & ~F.arrays_overlap(listed(c), got), F.slice(listed(c), 1, 1)).otherwise(F.array().cast("array<string>")) for c in (F.col("any_of"), F.col("any_of_2"))]
    lost = F.array_distinct(F.concat(*of_any, F.array_except(listed(F.col("all_of")), got)))
    return rows.select("query_id", F.explode(lost).alias("anchor"))


def rescue(hits: DataFrame, wider: DataFrame, required: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, corpus_id, chunk_id, anchor, distance) and source: "hit", "pool" or "anchor".

    A query that misses required anchors gets its wider pool, at distance 1;
    for each anchor still missing the nearest chunk of that anchor.
    """
    columns = ["query_id", "corpus_id", "chunk_id", "anchor", "distance"]
    short = missing_anchors(required, hits).select("query_id").distinct()
    fresh = wider.join(short, "query_id", "left_semi").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    pool = hits.select(*columns, F.lit("hit").alias("source")).unionByName(fresh.withColumn("distance", F.lit(1.0)).select(*columns, F.lit("pool").alias("source")))
    corpus = hits.groupBy("query_id").agg(F.min("corpus_id").alias("corpus_id"))
    lost = missing_anchors(required, pool).join(corpus, "query_id")
    found = _of_anchor(lost.withColumnRenamed("query_id", "asker"), chunks).where("asker = query_id").join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    nearest = rank.top_k(found, ["query_id", "anchor"], [F.asc("distance"), F.asc("chunk_id")], 1)
    return pool.unionByName(nearest.select(*columns, F.lit("anchor").alias("source")))


def node_anchor(node: Column) -> Column:
    """A graph node as an anchor: annex:iii as it is, anything else an article."""
    node = F.trim(node)
    return F.lower(F.when(F.startswith(F.upper(node), F.lit("ANNEX:")), node).otherwise(F.concat(F.lit("article:"), node)))


def expand(hits: DataFrame, articles: DataFrame, chunks: DataFrame, most_anchors: int = 10, each: int = 3) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, chunk_id, anchor, distance) with the chunks of expansion articles (query_id, node) that no hit covers, and (query_id, hints).

    A hit covers its anchor and, of a point, the anchor above it.  chunks: query_id, anchor, chunk_id, distance.
    """
    hinted = articles.select("query_id", node_anchor(F.col("node")).alias("anchor")).distinct()
    own = hits.where("anchor is not null").select("query_id", "anchor")
    above = own.where(F.size(F.split("anchor", ":")) >= 3).withColumn("anchor", F.substring_index("anchor", ":", 2))
    missing = rank.top_k(hinted.join(own.union(above).distinct(), ["query_id", "anchor"], "left_anti"), ["query_id"], [F.asc("anchor")], most_anchors, "a").drop("a")
    near = rank.top_k(chunks.join(missing, ["query_id", "anchor"]), ["query_id", "anchor"], [F.asc("distance"), F.asc("chunk_id")], each).drop("rank")
    fresh = near.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").dropDuplicates(["query_id", "chunk_id"])
    columns = ["query_id", "chunk_id", "anchor", "distance"]
    return hits.select(columns).unionByName(fresh.select(columns)), hinted.groupBy("query_id").agg(F.array_sort(F.collect_set("anchor")).alias("hints"))


def retrieve_context(questions: DataFrame, vectors: DataFrame, passages: DataFrame, articles: DataFrame, pool: int = 50, cap: int = 20, digits: int = 15) -> DataFrame:
    """The four stages: query_id, chunk_id, rank, position and the score of the context's passages.

    questions: query_id, q, question; vectors: chunk_id, embedding; passages:
    chunk_id, text, anchor, citable, delta (null without a profile); articles:
    query_id, node, from the graph.  The nearest chunks of each hinted anchor
    are found in blocks as the pool is, so no pair of chunk and query is a row.
    What later stages read several times is stored.  All distances are rounded to digits.
    """
    each, folder = 3, new_folder(vectors.sparkSession, "stages")
    places = stored(passages.select("chunk_id", "anchor"), f"{folder}/places")
    hinted = stored(articles.select("query_id", node_anchor(F.col("node")).alias("anchor")).distinct(), f"{folder}/hinted")
    near = retrieve.vector_top_k(vectors, questions, pool, digits=digits).select("query_id", "chunk_id", "distance")
    near = stored(near.join(places, "chunk_id"), f"{folder}/near")
    held = places.join(hinted.select("anchor").distinct(), "anchor", "left_semi").join(vectors.select("chunk_id", "embedding"), "chunk_id")
    of_anchor = retrieve.vector_top_k(held, questions, each, by=("anchor",), digits=digits).select("query_id", "anchor", "chunk_id", "distance")
    of_anchor = stored(of_anchor.join(hinted, ["query_id", "anchor"], "left_semi"), f"{folder}/of_anchor")
    hits, hints = expand(near, articles, of_anchor, each=each)
    full = stored(hits, f"{folder}/hits").join(passages.drop("anchor"), "chunk_id").join(questions.select("query_id", "question"), "query_id").join(hints, "query_id", "left")
    scores = rank.bm25(full.select("query_id", F.col("chunk_id").alias("doc_id"), "question", "text"))
    scored = full.drop("text", "question").join(scores.withColumnRenamed("doc_id", "chunk_id"), ["query_id", "chunk_id"]).withColumn("hinted", F.coalesce(F.array_contains("hints", F.col("anchor")), F.lit(False)))
    scored = rank.candidate_score(scored).withColumn("score", F.round("score", 9))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))  # of a pool
    ranked = stored(ranked.select("query_id", "chunk_id", "anchor", "citable", "score", "rank"), f"{folder}/ranked")
    chosen = select_context(ranked, hints, cap)
    return chosen.join(ranked.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"])


def scoped_or_precise(questions: DataFrame, near: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_id, distance, rank, scope): the k nearest chunks of the one article that a question names, else of its pool with siblings, those with a precise place first.

    near: query_id, chunk_id, location_id, chunk_index, article, precise, distance, of every chunk that may be found; chunks: the same without a query's distance.
    """
    one = R.article_refs(F.col("question"))
    asked = questions.select("query_id", F.when(F.size(one) == 1, one[0]).alias("only"))
    scoped = near.join(asked, "query_id").where(F.upper("article") == F.col("only"))
    scoped = rank.top_k(scoped, ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k).select("query_id", "chunk_id", "distance", "rank", F.lit("article").alias("scope"))
    pool = rank.top_k(near.join(scoped.select("query_id").distinct(), "query_id", "left_anti"), ["query_id"], [F.asc("distance"), F.asc("chunk_id")], max(30, k)).drop("rank")
    more = retrieve.siblings(pool, chunks).join(chunks.select("chunk_id", "precise"), "chunk_id")
    both = pool.select("query_id", "chunk_id", "distance", "precise").unionByName(more.select("query_id", "chunk_id", "distance", "precise")).groupBy("query_id", "chunk_id", "precise").agg(F.min("distance").alias("distance"))
    first = rank.precise_first(both, "query_id", F.col("precise"), [F.asc("distance"), F.asc("chunk_id")], k)
    return scoped.unionByName(first.select("query_id", "chunk_id", "distance", "rank", F.lit("pool").alias("scope")))


def fused_context(fused: DataFrame, profile: Column) -> DataFrame:
    """Fused hits (query_id, chunk_id, position, meta) under the profile's cap, with citability from their place."""
    has = lambda k: R.meta_value(F.col("meta"), k) != ""
    cap = F.when(profile == "LEGAL", planning.CONTEXT["LEGAL"]).otherwise(planning.CONTEXT["ENGINEERING"])
    return fused.where(F.col("position") <= cap).withColumn("citable", has("article") | has("recital") | has("annex"))


def rank_debug(hits: DataFrame, question: Column, heading: Column, body: Column) -> DataFrame:
    """chunk_id, distance, role, role_confidence, query_intent and rank of hits (query_id, chunk_id, distance, position) as they were ranked."""
    role = T.classify_role(heading, body)
    return hits.select("query_id", "chunk_id", "distance", role["role"].alias("role"), role["confidence"].alias("role_confidence"), T.query_intent(question).alias("query_intent"), F.col("position").alias("rank"))


def references_by_corpus(references: DataFrame) -> DataFrame:
    """(query_id, corpus, n, chunk_ids in order) of references (query_id, idx, chunk_id, corpus_id, source); a query's are a context, so few."""
    rows = references.withColumn("corpus", R.reference_corpus(F.col("corpus_id"), F.col("source")))
    return rows.groupBy("query_id", "corpus").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))


def probe(near: DataFrame, expanded: DataFrame, required: DataFrame) -> DataFrame:
    """(query_id, plain, augmented): do a search alone and the search with its expansion hold an anchor of any_of (query_id, any_of)?"""
    found = lambda hits, name: hits.join(required, "query_id").groupBy("query_id").agg(F.coalesce(F.bool_or(F.array_contains("any_of", F.col("anchor"))), F.lit(False)).alias(name))
    parts = [found(near, "plain"), found(near.select("query_id", "anchor").unionByName(expanded.select("query_id", "anchor")), "augmented")]
    out = reduce(lambda a, b: a.join(b, "query_id", "left"), parts, required.select("query_id").distinct())
    return out.fillna(False, ["plain", "augmented"])
