"""A stored lexical index: postings in blocks of documents, each with the most that its term can add.

Documents are numbered as stored, and ``rows_a_block`` neighbours are a block.
A row of the index is a term in a block: its documents with their BM25 parts
(all of the score but the idf), and the largest of these parts.

A row without a term holds a block's documents.  Neighbours are stored by one
task, so the index is made without a shuffle.

A search takes two passes.  The k-th score that a question's rarest terms alone
give is a limit that the answer's last score can't be under.  The question's
weakest terms, as many as together can't reach the limit, are put aside: a
document that holds only these isn't in the answer.  Then the postings of asked
terms are dealt by block, and each block is scored where it lies: not at all
for a question whose bounds there stay under the limit, by the weak terms only
if a document with the others may still reach it.  A block sends on what may
be among the k best.

Defined results: a null or empty text has no terms and is in no answer; a
question without known terms has no rows; every row of the documents is one of
its own, repeated and null ids included; equal scores rank by doc_id; texts and
questions are read whole; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..sources.stored import new_folder, stored
from .rank import top_k


def _spans(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists of rows, one after the other, and how many each has."""
    n = offsets[rows + 1] - offsets[rows]
    return np.arange(n.sum()) + np.repeat(offsets[rows] - (np.cumsum(n) - n), n), n


def _postings(t: pa.Table, rows_a_block: int, part) -> pa.Table:
    """The postings of whole blocks of documents (rid, doc_id, dl, terms, fs) in the order of rid."""
    rid, dl = (t[c].to_numpy().astype(np.int64) for c in ("rid", "dl"))
    terms, fs = t["terms"].combine_chunks(), t["fs"].combine_chunks()
    doc, word = pc.list_parent_indices(terms).to_numpy().astype(np.int64), pc.list_flatten(terms).dictionary_encode()
    order = np.lexsort((rid[doc], code := word.indices.to_numpy().astype(np.int64), block := rid[doc] // rows_a_block))
    doc, code, block, f = doc[order], code[order], block[order], pc.list_flatten(fs).to_numpy().astype(np.int64)[order]
    lists = lambda values, starts, n: pa.ListArray.from_arrays(pa.array(np.append(starts, n).astype(np.int32)), values)
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))) if len(doc) else np.empty(0, np.int64)
    of = np.flatnonzero(np.append(True, np.diff(rid // rows_a_block) != 0))
    ints = lambda x: pa.array(x.astype(np.int32))
    none = lambda n: pa.nulls(n, pa.list_(t["doc_id"].type))
    bounds = np.maximum.reduceat(part(f, dl[doc]), new) if len(new) else np.empty(0)
    n, docs = np.diff(np.append(new, len(doc))), np.diff(np.append(of, len(rid)))
    words = [word.dictionary.take(pa.array(code[new])).cast(pa.string()), pa.array(block[new]), pa.array(n), pa.array(bounds), lists(pa.array(rid[doc]), new, len(doc)), lists(ints(f), new, len(doc)), lists(ints(dl[doc]), new, len(doc)), none(len(new))]
    whole = [pa.array([""] * len(of), pa.string()), pa.array(rid[of] // rows_a_block), pa.array(docs), pa.array(np.zeros(len(of))), lists(pa.array(rid), of, len(rid)), lists(ints(dl * 0), of, len(rid)), lists(ints(dl), of, len(rid)), lists(t["doc_id"].combine_chunks(), of, len(rid))]
    names = ["term", "block", "n", "bound", "rids", "fs", "dls", "doc_ids"]
    return pa.concat_tables([pa.table(words, names), pa.table(whole, names)])


def _scored(t: pa.Table, k: int, slack: float, part) -> pa.Table:
    """(query_id, rid, doc_id, w, read) of one block: what may be among the k best of each question, and a row without rid with how many postings were read."""
    t = t.combine_chunks()
    whole = t.filter(pc.equal(t["term"], "")).combine_chunks()
    t = t.filter(pc.not_equal(t["term"], "")).combine_chunks()
    if not len(t):  # no word is asked for
        kinds = {"query_id": t.schema.field("asked").type.value_type.field("query_id").type, "rid": pa.int64(), "doc_id": t.schema.field("doc_ids").type.value_type, "w": pa.float64(), "read": pa.int64()}
        return pa.schema(list(kinds.items())).empty_table()
    ids, flat = pc.list_flatten(whole["doc_ids"]).combine_chunks(), lambda c: pc.list_flatten(t[c]).to_numpy()
    rids, dls = (pc.list_flatten(whole[c]).to_numpy() for c in ("rids", "dls"))
    asked = t["asked"].combine_chunks()
    row, each = pc.list_parent_indices(asked).to_numpy().astype(np.int64), pc.list_flatten(asked)
    query = each.field("query_id").dictionary_encode()
    q, idf, weak = query.indices.to_numpy().astype(np.int64), each.field("idf").to_numpy(zero_copy_only=False), each.field("weak").to_numpy(zero_copy_only=False)
    questions, docs = len(query.dictionary), len(rids)
    least = np.full(questions, -np.inf)
    least[q] = pc.fill_null(each.field("least"), -np.inf).to_numpy(zero_copy_only=False)
    most = idf * t["bound"].to_numpy()[row]
    offsets = np.append(0, np.cumsum(pc.list_value_length(t["rids"]).to_numpy())).astype(np.int64)
    parts = part(flat("fs"), dls[at := np.searchsorted(rids, flat("rids"))])
    read = np.zeros(questions)

    def add(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, n = _spans(offsets, row[of])
        np.add.at(read, q[of], n)
        cell = np.repeat(q[of], n) * docs + at[place]
        return np.bincount(cell, np.repeat(idf[of], n) * parts[place], questions * docs), np.bincount(cell, minlength=questions * docs) > 0

    may = np.bincount(q, most, questions) >= least
    w, found = add(np.flatnonzero(may[q] & ~weak))
    to_come = np.bincount(q, np.where(weak, most, 0.0), questions)
    found &= w + np.repeat(to_come, docs) >= np.repeat(least, docs)
    w += add(np.flatnonzero(weak & found.reshape(questions, docs).any(1)[q]))[0]
    kth = np.sort(np.where(found, w, -np.inf).reshape(questions, docs), 1)[:, -k] if docs >= k else np.full(questions, -np.inf)
    cells = np.flatnonzero(found & (w >= np.repeat(kth, docs) - slack))
    names = ["query_id", "rid", "doc_id", "w", "read"]
    hits = pa.table([query.dictionary.take(pa.array(cells // docs)), pa.array(rids[cells % docs]), ids.take(pa.array(cells % docs)), pa.array(w[cells]), pa.nulls(len(cells), pa.int64())], names)
    reads = pa.table([query.dictionary, pa.nulls(questions, pa.int64()), pa.nulls(questions, ids.type), pa.nulls(questions, pa.float64()), pa.array(read.astype(np.int64))], names)
    return pa.concat_tables([hits, reads])


def _part(totals: DataFrame):
    """All of the score but the idf, of counts and lengths."""
    n, avgdl, k1, b = totals.select("n", "avgdl", "k1", "b").first()  # one row
    return lambda f, dl: f * (k1 + 1.0) / (f + k1 * (1.0 - b + b * dl / (avgdl or 1.0)))


class LexicalIndex:
    """postings (term, block, n, bound, rids, fs, dls, doc_ids), terms (term, df, bound) and totals (n, avgdl, k1, b) under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.terms, self.totals = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "totals"))

    @classmethod
    def build(cls, docs: DataFrame, path: str, rows_a_block: int = 64, k1: float = 1.2, b: float = 0.75) -> LexicalIndex:
        """Index docs (doc_id, text) under path."""
        tokens = docs.select("doc_id", T.lexical_tokens(F.col("text")).alias("tokens"))
        totals = stored(tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")).withColumns({"k1": F.lit(float(k1)), "b": F.lit(float(b))}), f"{path}/totals")
        part = _part(totals)
        rows = tokens.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("tokens").alias("dl"), T.term_counts(F.col("tokens")).alias("c")).select("rid", "doc_id", "dl", F.col("c.term").alias("terms"), F.col("c.f").alias("fs"))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # documents of a block that may go on
            for batch in batches:
                t = pa.Table.from_batches([batch])
                t = t if held is None else pa.concat_tables([held, t])
                block = t["rid"].to_numpy() // rows_a_block
                whole = int(np.searchsorted(block, block[-1])) if len(block) else 0
                held = t.slice(whole)
                if whole:
                    yield from _postings(t.slice(0, whole), rows_a_block, part).to_batches()
            if held is not None and len(held):
                yield from _postings(held, rows_a_block, part).to_batches()

        of = lambda kind: S.ArrayType(kind)
        shape = S.StructType().add("term", "string").add("block", "long").add("n", "long").add("bound", "double").add("rids", of(S.LongType())).add("fs", of(S.IntegerType())).add("dls", of(S.IntegerType())).add("doc_ids", of(docs.schema["doc_id"].dataType))
        postings = stored(rows.mapInArrow(blocks, shape), f"{path}/postings")
        stored(postings.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("bound")), f"{path}/terms")
        return cls(docs.sparkSession, path)

    def _weights(self, questions: DataFrame) -> DataFrame:
        """(query_id, term, df, idf, most) of the questions' known terms, each once; most is what a term can add."""
        asked = questions.select("query_id", F.explode(F.array_distinct(T.lexical_tokens(F.col("question")))).alias("term"))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        rows = asked.join(self.terms, "term").crossJoin(F.broadcast(self.totals)).withColumn("idf", idf)
        return rows.select("query_id", "term", "df", "idf", (F.col("idf") * F.col("bound")).alias("most"))

    def search(self, questions: DataFrame, k: int = 10, rare_postings: int = 500, digits: int = 6, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
        """((query_id, doc_id, bm25, rank) of the k best for questions (query_id, question), (query_id, postings, postings_read))."""
        folder, part = folder or new_folder(self.spark, "lexical-search"), _part(self.totals)
        best = lambda rows: top_k(rows.withColumn("bm25", F.round("w", digits)), ["query_id"], [F.desc("bm25"), F.asc("doc_id"), F.asc("rid")], k)
        weights = stored(self._weights(questions), f"{folder}/weights")
        before = F.expr("coalesce(sum(df) over (partition by query_id order by most desc, term rows between unbounded preceding and 1 preceding), 0)")
        rare = weights.withColumn("before", before).where(F.col("before") < rare_postings).select("query_id", "term", "idf")
        entries = self.postings.where("term <> ''").join(rare, "term").select("query_id", "idf", F.explode(F.arrays_zip("rids", "fs", "dls")).alias("e")).select("query_id", "idf", "e.*")
        spoken_for = entries.groupBy("query_id", "rids").agg(F.sum(F.col("idf") * part(F.col("fs"), F.col("dls"))).alias("w"))
        limit = top_k(spoken_for, ["query_id"], [F.desc("w"), F.asc("rids")], k).where(F.col("rank") == k).select("query_id", (F.round("w", digits) - 2 * 10.0**-digits).alias("least"))  # less what rounding can add
        limit = stored(limit, f"{folder}/limit")

        weakest = F.expr("sum(most) over (partition by query_id order by most, term)")
        aside = weights.join(limit, "query_id", "left").withColumn("weak", F.coalesce(weakest < F.col("least"), F.lit(False)))
        asked = stored(aside.groupBy("term").agg(F.collect_list(F.struct("query_id", "idf", "weak", "least")).alias("asked")), f"{folder}/asked")  # a row for each question that has the term
        met = self.postings.join(asked.select("term").union(self.spark.createDataFrame([("",)], "term string")), "term", "left_semi")
        tasks = min(max(self.spark.sparkContext.defaultParallelism, -(-self.totals.first()["n"] // 10_000)), 20_000)
        dealt = met.withColumn("dls", F.when(F.col("term") == "", F.col("dls"))).repartition(tasks, "block").join(asked, "term", "left")
        shape = S.StructType().add("query_id", questions.schema["query_id"].dataType).add("rid", "long").add("doc_id", self.postings.schema["doc_ids"].dataType.elementType).add("w", "double").add("read", "long")
        slack = 2 * 10.0**-digits
        scored = dealt.groupBy("block").applyInArrow(lambda t: _scored(t, k, slack, part), shape)
        found = best(scored.where("rid is not null")).select("query_id", "doc_id", "bm25", "rank")
        read = scored.where("rid is null").groupBy("query_id").agg(F.sum("read").alias("postings_read"))
        report = weights.groupBy("query_id").agg(F.sum("df").alias("postings")).join(read, "query_id", "left").fillna(0, ["postings_read"])
        return found, report
