"""The citation graph: nodes and edges as tables, and bounded traversal.

mentions: (chunk_id, node), one row for each node that a chunk mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import top_k


def node_stats(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("node").agg(F.count("*").alias("mention_count"))


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row per node of (node, pos, title, chapter, roles, mention_count): counts added, the first title and chapter that aren't empty, all roles in order of first sight."""
    first = lambda c: F.min_by(F.when(F.length(c) > 0, F.col(c)), F.when(F.length(c) > 0, F.col("pos")))
    merged = rows.groupBy("node").agg(F.sum("mention_count").alias("mention_count"), first("title").alias("title"), first("chapter").alias("chapter"))
    roles = rows.select("node", F.explode("roles").alias("role"), "pos").groupBy("node", "role").agg(F.min("pos").alias("pos"))  # a node has few roles
    roles = roles.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]).alias("roles"))
    return merged.join(roles, "node", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def chunk_places(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, article, annex, annex_section, annex_point) with node, node_type, section_node and point_node: an article before an annex; points under their section if there is one."""
    v = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    annex = F.concat(F.lit("ANNEX:"), F.upper(v("annex")))
    rows = chunks.withColumn("node", F.coalesce(F.upper(v("article")), annex)).withColumn("node_type", F.when(v("article").isNotNull(), "article").when(v("annex").isNotNull(), "annex"))
    of_annex = F.col("node_type") == "annex"
    section = F.when(of_annex, F.concat(annex, F.lit(":"), v("annex_section")))
    return rows.withColumn("section_node", section).withColumn("point_node", F.when(of_annex, F.concat(F.coalesce(section, annex), F.lit(":"), v("annex_point"))))


def contains(chunks: DataFrame) -> DataFrame:
    """(src, dst, count): an annex contains its sections and points, a section its points; counted by chunks."""
    places = chunk_places(chunks)
    pairs = F.array(F.struct(F.col("node").alias("src"), F.col("section_node").alias("dst")), F.struct(F.coalesce("section_node", "node").alias("src"), F.col("point_node").alias("dst")))
    return places.select(F.explode(pairs).alias("p")).select("p.src", "p.dst").where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("count"))


def cites(mentions: DataFrame) -> DataFrame:
    """Edges from a chunk's own node (column src) to each node it mentions; loops dropped, repeats counted."""
    return mentions.where(F.col("src") != F.col("node")).groupBy("src", F.col("node").alias("dst")).agg(F.count("*").alias("count"))


def cooccurrence(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of nodes that share at least so many chunks, a < b as strings."""
    m = mentions.select("chunk_id", F.col("node").cast("string").alias("node")).distinct()
    pairs = m.alias("a").join(m.alias("b"), F.expr("a.chunk_id = b.chunk_id and a.node < b.node"))
    return pairs.groupBy(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).agg(F.count("*").alias("count")).where(F.col("count") >= least)


def same_group(members: DataFrame) -> DataFrame:
    """Every pair of nodes of a group (node, grp, pos), src < dst; a node's last group counts.

    The pairs of one group are its square by definition; both sides of the join
    can be split, so no task holds a group.
    """
    last = members.groupBy("node").agg(F.max_by("grp", F.struct("pos", "grp")).alias("grp")).where("grp is not null")
    pairs = last.alias("a").join(last.alias("b"), F.expr("a.grp = b.grp and a.node < b.node"))
    return pairs.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.col("a.grp").alias("grp"))


def weighted(edges: DataFrame) -> DataFrame:
    """Weight: an edge's count over the greatest of all."""
    top = edges.agg(F.max("count").alias("top"))
    return edges.crossJoin(F.broadcast(top)).select("src", "dst", "count", (F.col("count") / F.col("top")).alias("weight"))  # top is one row


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair of (src, dst, edge_type, weight): same_chapter over co_occurrence over the rest."""
    order = F.when(F.col("edge_type") == "same_chapter", 0).when(F.col("edge_type") == "co_occurrence", 1).otherwise(2)
    return top_k(edges, ["src", "dst"], [order.asc(), F.desc("weight")], 1).drop("rank")


def related(adjacent: DataFrame, seeds: DataFrame, decay: float = 0.5, depth: int = 2) -> DataFrame:
    """(seed, node, score): the best path of up to depth hops, weights multiplied, each further hop decayed."""
    front = seeds.select("seed").join(adjacent, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"), F.col("weight").alias("score"))
    found = front
    for _ in range(depth - 1):
        step = front.join(adjacent, F.col("node") == F.col("src")).where(F.col("dst") != F.col("seed"))
        front = step.groupBy("seed", F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight") * decay).alias("score"))
        found = found.union(front)
    return found.groupBy("seed", "node").agg(F.max("score").alias("score"))


def co_cited(adjacent: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, node): nodes that neighbour every seed of a query's set (query_id, seed)."""
    seeds, edges = seeds.select("query_id", "seed").distinct(), adjacent.select("src", "dst").distinct()
    n = seeds.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = edges.join(seeds, F.col("src") == F.col("seed")).groupBy("query_id", F.col("dst").alias("node")).agg(F.count("*").alias("k"))
    return hits.join(n, "query_id").where("k = n").select("query_id", "node")


def prioritised(parts: list[DataFrame], caps: list[int | None], cap: int = 30) -> DataFrame:
    """Ordered union of (node, pos) lists: earlier lists first, each node once, at most cap."""
    out = None
    for i, (part, most) in enumerate(zip(parts, caps, strict=True)):
        p = (part if most is None else part.orderBy("pos", "node").limit(most)).select("node", "pos", F.lit(i).alias("prio"))
        out = p if out is None else out.union(p)
    best = top_k(out, ["node"], [F.asc("prio"), F.asc("pos")], 1).drop("rank")
    return best.orderBy("prio", "pos", "node").limit(cap)


def scope_articles(nodes: DataFrame, most_number: int = 20, k: int = 5) -> DataFrame:
    """Early, often mentioned articles: (21 - n) + mentions / 2."""
    return nodes.where(F.col("number").between(1, most_number)).withColumn("score", (most_number + 1 - F.col("number")) + 0.5 * F.col("mention_count")).orderBy(F.desc("score"), "number").limit(k)


def by_role(nodes: DataFrame) -> DataFrame:
    """(role, node, place) of nodes (node, roles, mention_count): by number, then mentions; a node without a number counts as 999."""
    digits = F.regexp_replace("node", "[^0-9]", "")
    each = nodes.select("node", "mention_count", F.when(digits == "", 999).otherwise(digits.cast("long")).alias("number"), F.explode("roles").alias("role"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("number", F.desc("mention_count"), "node"))).select("role", "node", "place")


def foundational(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The first k nodes of each role."""
    return by_role(nodes).where(F.col("place") <= k)


def expand_context(adjacent: DataFrame, nodes: DataFrame, retrieved: DataFrame, roles: tuple[str, ...] = ("scope", "definitions"), each: int = 2, seeds: int = 20, least: float = 0.3, cap: int = 10) -> DataFrame:
    """(query_id, node, position) to add to retrieved (query_id, node, pos): where a classification article was found the
    first articles of each role, then what the first seeds cite strongly, in the order of seeds."""
    asks = retrieved.join(nodes.where(F.array_contains("roles", "classification")).select("node"), "node", "left_semi").select("query_id").distinct()
    firsts = by_role(nodes).where(F.col("role").isin(*roles) & (F.col("place") <= each))
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    base = asks.crossJoin(F.broadcast(firsts)).select("query_id", "node", F.struct(F.lit(0).alias("part"), rank.cast("long").alias("a"), (-F.col("place")).cast("double").alias("w")).alias("key"))  # at most each x roles rows
    near = retrieved.where(F.col("pos") <= seeds).join(adjacent.where(F.col("weight") >= least), F.col("node") == F.col("src"))
    linked = near.select("query_id", F.col("dst").alias("node"), F.struct(F.lit(1).alias("part"), F.col("pos").cast("long").alias("a"), F.col("weight").cast("double").alias("w")).alias("key"))
    fresh = base.unionByName(linked).join(retrieved.select("query_id", "node"), ["query_id", "node"], "left_anti")
    best = top_k(fresh, ["query_id", "node"], [F.asc("key.part"), F.asc("key.a"), F.desc("key.w")], 1).drop("rank")
    return top_k(best, ["query_id"], [F.asc("key.part"), F.asc("key.a"), F.desc("key.w"), F.asc("node")], cap, "position").drop("key")


def expand_seeds(adjacent: DataFrame, seeds: DataFrame, limit: int = 20, k: int = 5, least: float = 0.01, boost: float = 0.2) -> DataFrame:
    """(query_id, node, score, rank): nodes near the first seeds (query_id, seed, pos) of each query, by their best path of
    two hops.  A point of an annex gains boost where its annex was found or is a seed."""
    first = top_k(seeds, ["query_id"], [F.asc("pos"), F.asc("seed")], limit).select("query_id", "seed")
    paths = related(adjacent.where(F.col("weight") >= least), first.select("seed").distinct())
    found = first.join(paths, "seed").groupBy("query_id", "node").agg(F.max("score").alias("score"))
    found = found.join(first.withColumnRenamed("seed", "node"), ["query_id", "node"], "left_anti")
    parents = found.select("query_id", F.col("node").alias("parent")).union(first).distinct().withColumn("known", F.lit(True))
    parent = F.when(F.col("node").cast("string").rlike("^ANNEX:[^:]*:"), F.substring_index(F.col("node").cast("string"), ":", 2))
    scored = found.withColumn("parent", parent).join(parents.withColumn("parent", F.col("parent").cast("string")), ["query_id", "parent"], "left")
    return top_k(scored.select("query_id", "node", (F.col("score") + F.when(F.col("known"), boost).otherwise(0.0)).alias("score")), ["query_id"], [F.desc("score"), F.asc("node")], k)


def question_nodes(question: Column) -> Column:
    """Graph nodes that a question names: article numbers, and annexes as ANNEX:III; articles first."""
    low = F.lower(F.coalesce(question, F.lit("")))
    of = lambda p: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), F.upper)
    annexes = F.transform(of(r"(?:bilag|annex)\s+([ivxlcdm]+|\d{1,3})(?![\p{L}\p{N}])"), lambda x: F.concat(F.lit("ANNEX:"), x))
    return F.array_distinct(F.concat(of(r"(?:artikel|article)\s*(\d{1,3}[a-z]?)(?![\p{L}\p{N}])"), annexes))
