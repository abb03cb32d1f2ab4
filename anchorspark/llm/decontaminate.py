"""Benchmark decontamination by a prefix-filtered containment join.

Items become windows of words, and windows and documents become sets of
shingles of three words.  A document can hold a window only if it holds all of
the window's shingles, so with shingles in order of rarity (how many documents'
spots have each) the necessary prefix is the first one: only that shingle is
joined.  The spot of the shingle places the window; bounds of position and
length, and the comparison of the whole window, decide the match.  A shingle is
its hash, so equal hashes of different words make a candidate, never a match.
Everything runs in DataFrame functions.

A benchmark whose windows take few bytes, which are counted, goes to every task.
A larger one is joined by shuffles of (row, position, shingle) alone; texts meet
only the windows that their rows are candidates for.

Defined results: a null or empty text has no words, so it hits nothing and an
item of no words is no window; a window of fewer than three words is its own
shingle; a text of any length is read whole; shingles that are equally rare rank
by their hash, then by place; repeated rows get equal results; an
empty table on either side means no hits; extra columns aren't read by report()
and are passed through by remove_contaminated().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import ascii_lower
from .scratch import Scratch, unused

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of the benchmark that take more bytes than this are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def _shingles(words: Column, width: int) -> Column:
    """The hash of each run of so many words, by its start."""
    runs = F.transform(words, lambda w, i: F.xxhash64(F.lit(width), w, *(F.get(words, i + k) for k in range(1, width))))
    return F.slice(runs, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def _spots(tokens: DataFrame, widths: list[int], *columns: Column | str) -> DataFrame:
    """The columns, p and shingle of every shingle of the given widths."""
    return reduce(DataFrame.union, (tokens.select(*columns, F.posexplode(_shingles(F.col("words"), w)).alias("p", "shingle")) for w in widths))


def _is_small(df: DataFrame, *strings: Column) -> bool:
    """Do the rows take few bytes, by the lengths of their strings and what each row and string adds?"""
    size = sum((F.octet_length(c) for c in strings), F.lit(200))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df.hint("merge")


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(wid, win, items): the distinct windows with the ids of their items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.lit(width), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    rows = items.select("item", length.alias("len"), "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.col("len")).alias("win"))
    return rows.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.monotonically_increasing_id().alias("wid"), "win", "items")


def _placed(tokens: DataFrame, keys: DataFrame, widths: list[int], few: bool) -> DataFrame:
    """(doc_id, text_hash, at, len, wid): the windows (wid, win, len, rare, k) that documents (rid, doc_id, text_hash, words) hold."""
    fits = (F.col("shingle") == F.col("rare")) & (F.col("p") >= F.col("k")) & (F.col("p") - F.col("k") + F.col("len") <= F.col("n"))
    at, same = (F.col("p") - F.col("k")).alias("at"), F.slice("words", F.col("at") + 1, F.col("len")) == F.col("win")
    if few:
        spots = _spots(tokens, widths, "doc_id", "text_hash", "words", F.size("words").alias("n"))
        near = F.slice("words", F.col("p") - F.col("k") + 1, F.col("len")) == F.col("win")
        return spots.join(F.broadcast(keys), fits & near).select("doc_id", "text_hash", at, "len", "wid")
    spots = _spots(tokens, widths, "rid", F.size("words").alias("n"))
    candidates = spots.join(keys.drop("win", "seen").hint("merge"), fits).select("rid", at, "len", "wid")
    met = candidates.join(tokens, "rid").join(keys.select("wid", "win").hint("merge"), "wid")
    return met.where(same).select("doc_id", "text_hash", "at", "len", "wid")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated; one row per document row."""
    scratch = scratch or Scratch(docs.sparkSession, "benchmark")
    tokens = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words_of(F.col("text")).alias("words"))
    tokens = scratch.table(tokens, "tokens")
    windows = scratch.table(_windows(benchmark, width), "windows")
    few = _is_small(windows, F.array_join("win", " " * 40), F.array_join("items", " " * 40))

    widths = [r[0] for r in windows.select(F.least(F.size("win"), F.lit(shingle)).alias("w")).distinct().orderBy("w").collect()] or [shingle]  # at most three
    shingles = F.coalesce(*(F.when(F.least(F.size("win"), F.lit(shingle)) == w, _shingles(F.col("win"), w)) for w in widths))
    spread = windows.select("wid", F.size("win").alias("len"), F.posexplode(shingles).alias("k", "shingle"))
    known = scratch.table(spread.select("shingle").distinct(), "shingles")
    seen = _spots(tokens, widths).select("shingle").join(_sized(known, _is_small(known)), "shingle").groupBy("shingle").agg(F.count("*").alias("seen"))
    seen = scratch.table(seen, "seen")
    # a window of which a shingle is in no document is in none; the inner join and the count drop it
    rarest = spread.join(seen, "shingle").groupBy("wid", "len").agg(F.min(F.struct("seen", "shingle", "k")).alias("r"), F.count("*").alias("found")).where(F.col("found") == F.greatest(F.col("len") - (shingle - 1), F.lit(1)))
    keys = scratch.table(rarest.join(windows, "wid").select("wid", "win", "len", F.col("r.shingle").alias("rare"), F.col("r.k").alias("k"), F.col("r.seen").alias("seen")), "prefixes")
    placed = _placed(tokens, keys, widths, few)
    hits = scratch.table(placed.select("doc_id", "text_hash", "at", "len", "wid").distinct(), "hits")
    covered = F.expr("greatest(0, at + len - greatest(at, coalesce(max(at + len) over (partition by doc_id, text_hash order by at, len, wid rows between unbounded preceding and 1 preceding), 0)))")
    n_hit = hits.select("doc_id", "text_hash", covered.alias("new")).groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))
    of_doc = hits.select("doc_id", "text_hash", "wid").distinct().join(_sized(windows.select("wid", "items"), few), "wid")
    of_doc = of_doc.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    per_doc = n_hit.alias("a").join(of_doc.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_hash = b.text_hash")).select(F.col("a.doc_id").alias("h_id"), F.col("a.text_hash").alias("h_hash"), "n_hit", "ids")
    per_doc = scratch.table(per_doc, "per_doc")
    sizes = tokens.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    out = sizes.join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """docs without the contaminated ones."""
    scratch = Scratch(docs.sparkSession, "benchmark")
    bad_id, bad_hash = (unused(x, docs.columns) for x in ("bad_id", "bad_hash"))
    bad = report(docs, benchmark, width, scratch=scratch).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    bad = scratch.table(bad, "bad")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(bad_hash)), "left_anti")
