"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are dealt by pigeonhole: of budget + 1 blocks of bits at least one
is equal in any linked pair, and a block value with many fingerprints is split
the same way over its remaining bits.  Within a block value the sorted
fingerprints are a binary trie, joined with itself from the root: pairs of
nodes carry the bits that differ so far and end when these exceed the budget.
Pairs inside one component already found are dropped and only a spanning chain
of each component leaves a task.

Defined results: a null or empty text has fingerprint zero; a text of any length
is read whole; a null doc_id links like any other but is never the smallest;
repeated rows share a component; an empty table gives an empty table; extra
columns aren't read by near_duplicates and are passed through by one_per_group.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, utf8
from .components import components
from .scratch import Scratch, unused

_LOW_BITS = 33  # of monotonically_increasing_id, for the rows of one task
_DIRECT = 64  # node pairs of at most so many leaf pairs are compared at once


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """A bit is set if more than half the shingles' XXH64 have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    shingles = [whole[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), ">u8", len(shingles))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in pieces(batches):
            fp = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _with_fingerprints(docs: DataFrame, name: str, width: int) -> DataFrame:
    """docs and each row's fingerprint."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in pieces(batches):
            fp = np.array([fingerprint(t, width) for t in utf8(batch.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of each pair: labels become the least index of a component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(deeper := label[label], label):
            label[:] = deeper


def trie_components(fp: np.ndarray, group: np.ndarray, budget: int, at_once: int = 100_000) -> np.ndarray:
    """The component label of each fingerprint, linked within its group only.

    fp must be sorted within each group and the groups must lie together.
    """
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    ones: dict[int, np.ndarray] = {}

    def set_bits(bit: int) -> np.ndarray:
        got = ones.get(bit)
        if got is None:
            got = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
            if n <= 200_000:
                ones[bit] = got
        return got

    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, alo, ahi, blo, bhi, apart = stack.pop()
        if len(alo) > at_once:
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, apart))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, apart)))]
            continue
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        open_ = (change[ahi - 1] != change[alo]) | (change[bhi - 1] != change[blo]) | (label[alo] != label[blo])
        alo, ahi, blo, bhi, apart = (x[open_] for x in (alo, ahi, blo, bhi, apart))
        if not len(alo):
            continue
        na, nb = ahi - alo, bhi - blo
        few = na * nb <= _DIRECT
        if few.any():
            fa, size, width = alo[few], (na * nb)[few], nb[few]
            row = np.repeat(np.arange(len(fa)), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x, y = fa[row] + k // width[row], blo[few][row] + k % width[row]
            ok = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]) <= budget)
            _settle(label, x[ok], y[ok])
        more = ~few
        if not more.any() or bit < 0:
            continue
        alo, ahi, blo, bhi, apart = (x[more] for x in (alo, ahi, blo, bhi, apart))
        c = set_bits(bit)
        am, bm, same = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), alo == blo
        kids = []
        for x0, x1, y0, y1, step, keep in ((alo, am, blo, bm, 0, None), (am, ahi, bm, bhi, 0, None), (alo, am, bm, bhi, 1, None), (am, ahi, blo, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (apart + step <= budget)
            ok &= ~((x0 == y0) & (x1 - x0 == 1))
            if keep is not None:
                ok &= keep
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], apart[ok] + step))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))
    return label


def _chains(budget: int, at_once: int = 50_000):
    """Groups of fingerprints (key, fp), in order of key, to the links of spanning chains."""

    def links(key, fp):
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        label = trie_components(fp, key, budget)
        order = np.argsort(label, kind="stable")
        same = label[order][1:] == label[order][:-1]
        u, v = fp[order][1:][same], fp[order][:-1][same]
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches):
        keys, fps, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held >= at_once:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield links(key[:whole], fp[:whole])
                keys, fps, held = [key[whole:]], [fp[whole:]], len(key) - whole
        if held:
            yield links(np.concatenate(keys), np.concatenate(fps))

    return run


def _blocks(first: int, n_bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [first + n_bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _value(lo: int, width: int):
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))


def deal(fps: DataFrame, budget: int, most: int = 4096) -> DataFrame:
    """(key, fp): each fingerprint under the value of each block; crowded values are split over their other bits.

    There are at most (budget + 1) * 2**ceil(64 / (budget + 1)) block values, so
    the crowded ones are a bounded list.
    """
    blocks = _blocks(0, 64, budget + 1)
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _value(*b).alias("v")) for i, b in enumerate(blocks)))).alias("b")).select("fp", "b.i", "b.v")
    crowded = rows.groupBy("i", "v").count().where(F.col("count") > most).select("i", "v", F.lit(True).alias("crowded"))
    rows = rows.join(F.broadcast(crowded), ["i", "v"], "left")
    plain = F.array(F.lit(-1).cast("bigint"))
    fine = F.lit(None).cast("array<bigint>")
    for i, (lo, width) in enumerate(blocks):
        # the other bits in one run: those above the block, then those below
        rest = F.shiftleft(F.shiftrightunsigned("fp", lo + width) if lo + width < 64 else F.lit(0).cast("bigint"), lo).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << lo) - 1)))
        subs = [F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(s << 40)) for s, (a, w) in enumerate(_blocks(0, 64 - width, budget + 1))]
        fine = F.when(F.col("i") == i, F.array(*subs)).otherwise(fine)
    return rows.select("fp", "i", "v", F.explode(F.when(F.col("crowded"), fine).otherwise(plain)).alias("sub")).select(F.xxhash64("i", "v", "sub").alias("key"), "fp")


def _groups(marked: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """(fp, root, component_id) of rows (doc_id, fp): fingerprints that chain together share a root; the least doc_id of them all."""
    distinct = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    dealt = deal(distinct, budget)
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_chains(budget), "u long, v long")
    nodes = scratch.table(components(links, scratch), "nodes")
    roots = scratch.table(nodes.join(distinct, nodes.node == distinct.fp).groupBy("root").agg(F.min("least").alias("component")), "roots")
    linked = scratch.table(nodes.join(roots, "root").select(F.col("node").alias("fp"), "root", "component"), "linked")
    return scratch.table(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")), "named")


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints chain together share a component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, width), "marked")
    return marked.join(_groups(marked, budget, scratch), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _without_rows(stored: DataFrame, row: str, gone: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """The columns of stored's rows whose number (row) is not in gone (row).

    A number's high bits are the task that stored the row, and its low bits the
    place among that task's rows.  The places that go are written as one small
    file for each such task, which whoever reads those rows looks up: only
    numbers are shuffled, no text.  A task that runs again writes the same file,
    and each appears whole, by a rename.
    """
    folder, at = scratch.folder("gone"), stored.columns.index(row)
    places = gone.select(F.shiftright("row", _LOW_BITS).alias("part"), F.col("row").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)).alias("place"))
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        attempt, held, name, n = TaskContext.get().taskAttemptId(), [], None, 0

        def finish():
            hidden = f"{root}/_{name}.{attempt}"
            with fs.open_output_stream(hidden, compression=None) as out:
                out.write(np.concatenate(held).tobytes())
            fs.move(hidden, f"{root}/{name}")
            held.clear()

        for batch in batches:
            part, place = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero(np.diff(part)) + 1
            for p, some in zip(part[np.concatenate(([0], cut))].tolist() if len(part) else (), np.split(place, cut), strict=False):
                if held and p != name:
                    finish()
                name, n = p, n + len(some)
                held.append(some)
        if held:
            finish()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    places.repartition(parts, "part").sortWithinPartitions("part", "place").mapInArrow(write, "n long").agg(F.sum("n")).collect()

    def keep(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        for batch in batches:
            numbers = batch.column(at).to_numpy()
            part, place, stays = numbers >> _LOW_BITS, numbers & ((1 << _LOW_BITS) - 1), np.ones(len(numbers), bool)
            for p in np.unique(part).tolist():
                if known[0] != p:
                    there = fs.get_file_info(f"{root}/{p}").type == pafs.FileType.File
                    known = (p, np.frombuffer(fs.open_input_file(f"{root}/{p}").read(), np.int64) if there else np.zeros(0, np.int64))
                here = part == p
                stays[here] = ~np.isin(place[here], known[1])
            yield batch.filter(pa.array(stays)).select([c for c in batch.schema.names if c in columns])

    return stored.mapInArrow(keep, T.StructType([f for f in stored.schema.fields if f.name in columns]))


def one_per_group(docs: DataFrame, budget: int = 4, width: int = 4) -> DataFrame:
    """One row of docs for each group of linked fingerprints: that with the smallest doc_id, null being the largest.

    Rows are told apart by a number that is stored with them, not by their
    doc_id: of rows that repeat a doc_id within a group one stays, and rows of
    one doc_id in different groups are judged apart.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fp, row = (unused(x, docs.columns) for x in ("fp", "row"))
    stored = scratch.table(_with_fingerprints(docs, fp, width).withColumn(row, F.monotonically_increasing_id()), "stored")
    marked = stored.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"), F.col("row").alias("row")))["row"]
    kept = scratch.table(marked.join(_groups(marked, budget, scratch).select("fp", "root"), "fp").groupBy("root").agg(first.alias("kept")).select("kept"), "kept")
    gone = marked.select("row").join(kept, F.col("row") == F.col("kept"), "left_anti")
    return _without_rows(stored, row, gone, docs.columns, scratch)
