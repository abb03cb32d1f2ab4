"""Vector retrieval, filters, neighbours and gates."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .nearest import nearest
from .rank import top_k

#: An inverted file sends no more query vectors than this to every task at once.
MOST_QUERIES = 10_000
#: So many vectors and queries, of so many components, meet in one task.  Few blocks keep what is sent on, k for each of them and each query, and the copies of both tables few.
VECTORS_IN_BLOCK, QUERIES_IN_BLOCK, VALUES_IN_BLOCK = 65_536, 8192, 1 << 22
#: Small sides of more rows than this are shuffled.
BROADCAST_ROWS = 200_000


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def compile_filter(where: dict | None) -> Column:
    """A predicate from {"field": value, "$and": [...], "$or": [...]}; several keys mean all of them."""
    tests = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            tests.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), map(compile_filter, value)))
        else:
            tests.append(F.col(key) == F.lit(value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _blocks_by(df: DataFrame, values: str, most: int, by: tuple[str, ...] = ()) -> dict[tuple, int]:
    """How many blocks of at most so many rows, and of about VALUES_IN_BLOCK components, df makes for each of by's values, a stated list."""
    counted = df.groupBy(*by).agg(F.count("*"), F.sum(F.greatest(F.size(values), F.lit(0)))).collect()
    return {tuple(of): max(1, -(-n // most), -(-(size or 0) // VALUES_IN_BLOCK)) for *of, n, size in counted}


def _blocks(df: DataFrame, values: str, most: int) -> int:
    return _blocks_by(df, values, most)[()]


def blocks_by(vectors: DataFrame, queries: DataFrame, by: str) -> dict[object, tuple[int, int]]:
    """vector_top_k's blocks for the vectors of each of by's values, counted for all of them at once."""
    columns = _blocks(queries, "q", QUERIES_IN_BLOCK)
    return {of: (rows, columns) for (of,), rows in _blocks_by(vectors, "embedding", VECTORS_IN_BLOCK, (by,)).items()}


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, where: dict | None = None, by: tuple[str, ...] = (), digits: int = 15, blocks: tuple[int, int] | None = None) -> DataFrame:
    """Exact nearest rows of vectors (chunk_id, embedding) for a stated set of queries (query_id, q), by squared L2.

    With by, the k nearest of each of its values.  Every block of vectors meets
    every block of queries in a task of its own, which sends on what may be
    among the k nearest; no block grows with the tables.  blocks, where they
    are known from blocks_by, saves counting.
    """
    vectors, queries = vectors.where(compile_filter(where)), queries.select("query_id", "q")
    rows, columns = blocks or (_blocks(vectors, "embedding", VECTORS_IN_BLOCK), _blocks(queries, "q", QUERIES_IN_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = vectors.select("*", block("chunk_id", rows).alias("_row"), every(columns).alias("_column"))
    right = queries.select("*", every(rows).alias("_row"), block("query_id", columns).alias("_column"))
    keys, kept = ["_row", "_column"], [c for c in vectors.columns if c != "embedding"]
    shape = vectors.drop("embedding").crossJoin(queries.select("query_id")).withColumn("distance", F.lit(0.0)).schema

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left["chunk_id"], null_placement="at_start"))
        i, j, d = nearest(left, right, k, list(by), digits)
        return left.select(kept).take(pa.array(i)).append_column("query_id", right["query_id"].take(pa.array(j))).append_column("distance", pa.array(d))

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(candidates, shape).withColumn("distance", F.round("distance", digits))
    return top_k(near, ["query_id", *by], [F.asc("distance"), F.asc("chunk_id")], k)


def siblings(hits: DataFrame, chunks: DataFrame, most: int = 2, factor: float = 1.05) -> DataFrame:
    """Other chunks of a hit's location, the first by index, at a little more distance; hits themselves left out."""
    pairs = hits.select("query_id", "location_id", "distance").join(chunks.select("location_id", "chunk_id", "chunk_index"), "location_id")
    fresh = pairs.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").groupBy("query_id", "location_id", "chunk_id", "chunk_index").agg(F.min("distance").alias("d"))
    return top_k(fresh, ["query_id", "location_id"], [F.asc("chunk_index"), F.asc("chunk_id")], most).select("query_id", "location_id", "chunk_id", (F.col("d") * factor).alias("distance"))


def inject_anchors(hits: DataFrame, hints: DataFrame, chunks: DataFrame, most_anchors: int = 10, each: int = 3) -> DataFrame:
    """For hinted anchors that no hit covers, the nearest chunks (distance to the question) of that anchor that aren't hits yet."""
    covered = hits.select("query_id", "chunk_id").join(chunks.select("chunk_id", "anchor"), "chunk_id").select("query_id", "anchor").distinct()
    missing = top_k(hints.select("query_id", "anchor").distinct().join(covered, ["query_id", "anchor"], "left_anti"), ["query_id"], [F.asc("anchor")], most_anchors, "a").drop("a")
    extra = missing.join(chunks.select("anchor", "chunk_id", "distance"), "anchor").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top_k(extra, ["query_id", "anchor"], [F.asc("distance"), F.asc("chunk_id")], each).drop("rank")


def discovery_scores(hits: DataFrame) -> DataFrame:
    """Confidence of each corpus: half the mean and half the best Gaussian similarity of its hits, to four places."""
    s = hits.withColumn("s", T.gaussian(F.col("distance")))
    return s.groupBy("query_id", "corpus_id").agg(F.round(0.5 * F.avg("s") + 0.5 * F.max("s"), 4).alias("confidence"))


def merge_matches(alias: DataFrame, judged: DataFrame, probed: DataFrame) -> DataFrame:
    """One match per query and corpus: alias before judged before probed."""
    rows = reduce(DataFrame.unionByName, (d.select("query_id", "corpus_id", "confidence").withColumn("stage", F.lit(i)) for i, d in enumerate((alias, judged, probed))))
    return top_k(rows, ["query_id", "corpus_id"], [F.asc("stage"), F.desc("confidence")], 1).drop("rank")


def gate(matches: DataFrame, auto: float = 0.75, suggest: float = 0.65, most: int = 5, most_suggested: int = 2) -> DataFrame:
    """AUTO, SUGGEST or ABSTAIN per query, and how many corpora it resolves to; many weak matches mean a vague question."""
    counted = matches.groupBy("query_id").agg(F.count_if(F.col("confidence") >= auto).alias("sure"), F.count_if(F.col("confidence") >= suggest).alias("likely"))
    kind = F.when(F.col("sure") > 0, "AUTO").when(F.col("likely").between(1, most_suggested), "SUGGEST").otherwise("ABSTAIN")
    n = F.when(F.col("sure") > 0, F.least("sure", F.lit(most))).when(kind == "SUGGEST", F.least("likely", F.lit(most))).otherwise(F.lit(0))
    return counted.select("query_id", kind.alias("gate"), n.cast("long").alias("n_resolved"))


def needs_disambiguation(matches: DataFrame, gap: float = 0.10) -> DataFrame:
    """Queries whose two best confidences are closer than gap."""
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "corpus_id")
    first = matches.withColumn("next", F.lead("confidence").over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select("query_id", F.coalesce(F.col("confidence") - F.col("next") < gap, F.lit(False)).alias("ambiguous"))


def boosted(matches: DataFrame, verdicts: DataFrame, by: float = 0.15, gap: float = 0.10) -> DataFrame:
    """Matches (query_id, corpus_id, confidence) after a judge's verdicts (query_id, verdict): where the best two are close, a corpus that the verdict names gains by, up to 1."""
    asked = needs_disambiguation(matches, gap).where("ambiguous").join(verdicts, "query_id").select("query_id", F.lower("verdict").alias("verdict"))
    named = F.coalesce(F.contains("verdict", F.lower(F.col("corpus_id").cast("string"))), F.lit(False))
    rows = matches.join(asked, "query_id", "left")
    return rows.select("query_id", "corpus_id", F.when(named, F.round(F.least(F.lit(1.0), F.col("confidence") + by), 4)).otherwise(F.col("confidence")).alias("confidence"), named.alias("judged"))


def abstain(queries: DataFrame, hits: DataFrame, hard: float = 1.3, soft: float = 1.25, allow_low: bool = False) -> DataFrame:
    """For each of queries (query_id): no_evidence, too_far, low_evidence or answer, by its best hit's distance."""
    best = queries.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.min("distance").alias("best")), "query_id", "left")
    low = F.lit(not allow_low) & (F.col("best") > soft)
    return best.select("query_id", F.when(F.col("best").isNull(), "no_evidence").when(F.col("best") > hard, "too_far").when(low, "low_evidence").otherwise("answer").alias("decision"))


def alias_matches(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, corpora) whose alias stands in a question as whole words: the question's runs of words joined with aliases (corpus_id, alias)."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    known = aliases.select("corpus_id", plain("alias").alias("run")).where("run <> ''")
    longest, n = known.agg(F.max(F.size(F.split("run", " "))), F.count("*")).first()  # words of an alias, aliases
    longest = longest or 1
    known = F.broadcast(known) if n <= BROADCAST_ROWS else known.hint("merge")  # the questions' runs are never sent whole, whatever their estimate
    asked = questions.select("query_id", F.split(plain("question"), " ").alias("w"))
    starts = lambda n: F.sequence(F.lit(1), F.size("w") - n + 1)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w"))), lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice("w", i, n), " "))))
    met = asked.select("query_id", F.explode(F.array_distinct(runs)).alias("run")).join(known, "run")
    return met.groupBy("query_id").agg(F.array_sort(F.collect_set("corpus_id")).alias("corpora"))
