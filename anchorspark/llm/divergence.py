"""Audit of how sources' words differ within a language.

Tasks count terms and documents for each (lang, source) before anything is
shuffled.  Of each language the terms in at least ``least_docs`` documents are
kept.  Smoothed probabilities are integers, exact at every size.

Terms of a group: its counts fall into buckets, each with the group's largest
probability and the language's least one among its terms, so no term of the
bucket differs by more than their difference.  The buckets with the highest
bounds that together hold ``top`` terms are looked at first; what they give is a
lower limit of the last rank, and of the others only those whose bound isn't
strictly below it are looked at.

Pairs of sources: postings meet in groups of (language, two blocks of sources,
chunk of terms), each a small matrix of probabilities in which a source without
the term has its smoothed zero.  Terms that neither block has are added by their
number.  Groups are bounded by the widths of blocks and chunks, not by the
corpus; languages and sources may be of any size.

Defined results: null text, lang and source read as empty; a document without
terms still makes its group; a language without kept terms has pairs of value 0
and no terms; equal values rank by the item's UTF-8 bytes; doc_id isn't read, so
null and repeated ids are documents of their own; a text of any length is read
whole; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, utf8
from .scratch import Scratch

#: A-Z become a-z, other ASCII but letters becomes a blank; bytes of longer characters stay.
_FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HELD = 1 << 18  # entries that a task counts before it passes them on
_PIECE = 1 << 20  # bytes of a text that are split at a time
_BIG = "decimal(38,0)"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + _PIECE) if len(folded) - at > _PIECE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), partial counts."""
    times: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), seen in times.items():
            words, among = list(seen), docs[lang, source]
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                term = pa.array(part, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part)), pa.repeat(pa.scalar(source, pa.string()), len(part)), term, pa.array([seen[w] for w in part], pa.int64()), pa.array([among[w] for w in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        times.clear()
        docs.clear()

    for batch in pieces(batches):
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), utf8(batch["text"]), strict=True):
            own: set[bytes] = set()
            for words in _terms(text or b""):
                times[lang, source].update(words)
                own.update(words)
            docs[lang, source].update(own)
        if sum(map(len, times.values())) > _HELD:
            yield from passed_on()
    yield from passed_on()


def _probability(count: Column, total: Column, kinds: Column) -> Column:
    share = F.lit(1_000_000_000).cast(_BIG) * (count.cast(_BIG) + 5)
    return (1 + F.call_function("div", share, total.cast(_BIG) + 5 * kinds.cast(_BIG))).cast("long")


def _bucket(count: Column) -> Column:
    """Eight buckets for each doubling."""
    return F.floor(8 * F.log2(count.cast("double"))).cast("int")


def _top_terms(postings: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value, rank) of each group's terms that are likelier than in their language."""
    group = ["lang", "source"]
    over = postings.where("p > q").select(*group, "term", "p", "q", "bucket")
    bounds = over.groupBy(*group, "bucket").agg(F.count("*").alias("n"), (F.max("p") - F.min("q")).alias("bound"))
    before = F.expr("coalesce(sum(n) over (partition by lang, source order by bound desc, bucket rows between unbounded preceding and 1 preceding), 0)")
    bounds = scratch.table(bounds.withColumn("before", before), "bounds")  # at most eight rows a group for each doubling
    ranked = lambda df: df.withColumn("rank", F.expr("row_number() over (partition by lang, source order by value desc, item)")).where(F.col("rank") <= top)
    looked_at = lambda which: over.join(which.select(*group, "bucket"), [*group, "bucket"]).select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = scratch.table(ranked(looked_at(bounds.where(F.col("before") < top))), "first")
    last = first.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
    unseen = bounds.where(F.col("before") >= top).join(last, group).where("bound >= kth")
    return ranked(first.drop("rank").union(looked_at(unseen)))


def _block_pairs(df: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences between a group's two blocks of sources over its chunk of terms."""
    own = df[df["tid"].isna()]
    base = own["p"].to_numpy(np.int64)
    place = pd.Series(np.arange(len(own)), own["gid"].to_numpy())
    seen = df[df["tid"].notna()]
    codes, terms = pd.factorize(seen["tid"])
    table = np.repeat(base[:, None], len(terms), 1)
    table[place.loc[seen["gid"]].to_numpy(), codes] = seen["p"].to_numpy(np.int64)
    low, high, chunk = (df[c].iloc[0] for c in ("low", "high", "chunk"))
    block, names = own["block"].to_numpy(), own["source"].to_numpy()
    absent = (int(own["kinds"].iloc[0]) if chunk == 0 else 0) - len(terms)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = [pd.DataFrame({"lang": names[:0], "source": names[:0], "item": names[:0], "value": base[:0]})]
    for a in left:
        others = right[right > a] if low == high else right
        value = np.abs(table[others] - table[a]).sum(1) + absent * np.abs(base[others] - base[a])
        out.append(pd.DataFrame({"lang": df["lang"].iloc[0], "source": names[a], "item": names[others], "value": value}))
    return pd.concat(out)


def _pairs(groups: DataFrame, postings: DataFrame, sources_a_block: int, terms_a_chunk: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value, rank) of each group and the others of its language."""
    widths = groups.groupBy("lang").agg(F.ceil(F.count("*") / sources_a_block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.max("kinds") / terms_a_chunk)).cast("int").alias("chunks"))
    widths = scratch.table(widths, "widths")
    block, other = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    of_group = groups.join(widths, "lang").select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("*", other.alias("other"))
    of_group = of_group.select("lang", low, high, "chunk", "block", "gid", F.lit(None).cast("long").alias("tid"), F.col("zero").alias("p"), "source", "kinds")
    of_term = postings.join(widths, "lang").select("*", block.alias("block"), F.pmod(F.xxhash64("tid"), F.col("chunks")).cast("int").alias("chunk")).select("*", other.alias("other"))
    of_term = of_term.select("lang", low, high, "chunk", "block", "gid", "tid", "p", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("kinds"))
    parts = of_group.union(of_term).groupBy("lang", "low", "high", "chunk").applyInPandas(_block_pairs, "lang string, source string, item string, value long")
    sums = scratch.table(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return both.withColumn("rank", F.expr("row_number() over (partition by lang, source order by value desc, item)"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, sources_a_block: int = 256, terms_a_chunk: int = 512) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.table(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = scratch.table(kept.select("lang", "term", "of_lang", F.monotonically_increasing_id().alias("tid")), "kept")
    langs = scratch.table(kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("of_lang").alias("lang_total")), "langs")
    counted = scratch.table(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "tid", "n", "of_lang"), "counted")
    totals = scratch.table(counted.groupBy("lang", "source").agg(F.sum("n").alias("total")), "totals")
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kinds", "lang_total"])
    zero = F.when(F.col("kinds") > 0, _probability(F.lit(0), F.col("total"), F.greatest(F.col("kinds"), F.lit(1)))).otherwise(0)
    groups = scratch.table(groups.select("lang", "source", "total", "kinds", "lang_total", zero.cast("long").alias("zero"), F.monotonically_increasing_id().alias("gid")), "groups")
    p, q = _probability(F.col("n"), F.col("total"), F.col("kinds")), _probability(F.col("of_lang"), F.col("lang_total"), F.col("kinds"))
    postings = scratch.table(counted.join(groups, ["lang", "source"]).select("lang", "source", "gid", "term", "tid", p.alias("p"), q.alias("q"), _bucket(F.col("n")).alias("bucket")), "postings")
    scratch.drop("counts", "counted")
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(_pairs(groups, postings, sources_a_block, terms_a_chunk, scratch), "pair").union(out(_top_terms(postings, top, scratch), "term"))
