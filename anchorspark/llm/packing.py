"""Best-fit-decreasing packing of token sequences.

Overlong documents are first cut into full windows; every other piece goes, the
longest first, into the open window with the least room that still takes it.  A
segment tree indexed by remaining capacity finds that window.  Only sizes
matter to the method and there are at most ``window`` of them, so the driver
packs the histogram of sizes (bounded by the window, whatever the input) and
the executors map each piece, by its rank within its size, to its place.

Defined results: a null or empty text is its end id alone; doc_id may be of any
type and null, and comes back as it is; repeated rows are packed each and equal
sizes go in order of doc_id within a block; a text of any length is cut whole
(a batch holds 8 MB of texts or one text); an empty table gives an empty table;
other columns aren't read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import coded_words, pieces
from .scratch import Scratch


class CapacityTree:
    """A segment tree over capacities 0..top: which of them have open windows."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def push(self, capacity: int, first: int, n: int) -> None:
        self.stacks[capacity].append((first, n))
        at = capacity + self.leaves
        while at and not self.open[at]:
            self.open[at] = 1
            at >>= 1

    def pop(self, capacity: int) -> tuple[int, int]:
        got = self.stacks[capacity].pop()
        at = capacity + self.leaves
        if not self.stacks[capacity]:
            self.open[at] = 0
            while at > 1 and not (self.open[at & ~1] or self.open[at | 1]):
                at >>= 1
                self.open[at] = 0
        return got

    def tightest(self, size: int) -> int | None:
        """The least open capacity of at least size."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


@dataclass(frozen=True)
class Plan:
    """Row i: pieces of size[i] with ranks from rank[i] on go each[i] to a window, from window[i] on, at offset[i]."""

    size: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.size * (1 << 48) + self.rank, size * (1 << 48) + rank, side="right") - 1
        over = rank - self.rank[at]
        return self.window[at] + over // self.each[at], self.offset[at] + over % self.each[at] * size


def best_fit_decreasing(counts: dict[int, int], window: int) -> Plan:
    """Pack counts[size] pieces of each size, equal sizes at once: the windows that one-by-one best fit would choose."""
    tree, rows, made = CapacityTree(window), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                each = window // size
                n = -(-left // each)
                tree_first, room = made, window
                made += n
            else:
                tree_first, n = tree.pop(room)
                each = room // size
            full = min(n, left // each)
            if full:
                rows.append((size, rank, each, tree_first, window - room))
                rank, left = rank + full * each, left - full * each
                if room - each * size:
                    tree.push(room - each * size, tree_first, full)
            if full < n and left and left < each:
                rows.append((size, rank, left, tree_first + full, window - room))
                if room - left * size:
                    tree.push(room - left * size, tree_first + full, 1)
                full, left = full + 1, 0
            if full < n:
                tree.push(room, tree_first + full, n - full)
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, made)


#: What the tokenizer takes as one piece (fixed value), over ASCII and the Latin-1 letters; words are told apart by line ends.
_PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\n0-9a-zß-öø-ÿ]+")
_PLAIN = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


class WordIds:
    """Ids of texts, by the pieces of their distinct words; the tokenizer never joins over white space.

    Arrow splits a batch of texts at ASCII white space only and numbers its
    distinct words; any other white space stays inside a word.  Words of ASCII
    and Latin-1 letters are cut into the tokenizer's pieces here, and new pieces
    are encoded side by side by the library's model; any other word, and any
    that may hold a special token, goes whole through the library.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has its own task
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.most, self.known = tokenizer.encode_batch_fast, most, {"\n": b""}
        suffix = tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for w, i in tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        cut = Tokenizer.from_file(path)
        cut.normalizer, cut.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_cut = cut.encode_batch_fast

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode(words, add_special_tokens=False)]

    def _together(self, some: list[str]) -> list[bytes]:
        """Ids of pieces, encoded side by side: the last id of each, and no other, ends a word."""
        ids = np.array([i for e in self.encode_cut([" ".join(some)], add_special_tokens=False) for i in e.ids], np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(some):
            return self._each(some)
        data, cut = ids.tobytes(), [0, *(4 * last).tolist()]
        return [data[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    def of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words on end, each word's begin and its end."""
        lines = "\n".join(words)
        odd = frozenset(lines) - _PLAIN - {"\n"}
        if odd or "<|" in lines:
            whole = np.fromiter((not odd.isdisjoint(w) or "<|" in w for w in words), bool, len(words))
            lines = "\n".join(words[~whole])
        else:
            whole = np.zeros(len(words), bool)
        parts = _PIECE.findall(lines.lower()) if not whole.all() else []
        names = words[whole].tolist()
        fresh = set(parts).difference(self.known)
        if len(self.known) + len(fresh) > self.most:
            self.known = {"\n": b""}
            fresh = set(parts).difference(self.known)
        fresh = list(fresh)
        for at in range(0, len(fresh), 256):
            self.known.update(zip(fresh[at : at + 256], self._together(fresh[at : at + 256]), strict=True))
        data = list(map(self.known.__getitem__, parts))
        others = self._each(names) if names else []
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        stop = np.concatenate((np.cumsum(size)[size == 0], [size.sum()]))  # a line end has no ids, every piece has one at least
        begin, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not whole.all():
            end[~whole] = stop
            begin[~whole] = np.concatenate(([0], stop[:-1]))
        more = np.cumsum(np.fromiter(map(len, others), np.int64, len(others)) // 4)
        end[whole] = stop[-1] + more
        begin[whole] = stop[-1] + np.concatenate(([0], more))[:-1]
        return np.frombuffer(b"".join(data + others), np.uint32), begin, end

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's begin (with the end of the last)."""
        coded, edge = coded_words(texts)
        table, begin, end = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False))
        which = coded.indices.to_numpy()
        n = (end - begin)[which]
        total = np.concatenate(([0], np.cumsum(n)))
        spot = np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])
        return table[spot], total[edge]


_WORKER: dict[str, WordIds] = {}


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt): full windows of each document's ids, then the rest; the salt tells repeated rows apart."""
    end = array("I", [end_id]).tobytes()

    def run(batches):
        if tokenizer not in _WORKER:
            _WORKER[tokenizer] = WordIds(tokenizer)
        made = 0
        for batch in pieces(batches, 8 << 20):
            ids, edge = _WORKER[tokenizer].ids(batch.column(1))
            size = np.diff(edge) + 1  # with the end id
            each = -(-size // window)
            row = np.repeat(np.arange(len(size)), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * window
            length = np.minimum(window, size[row] - start)
            begin, last = edge[row] + start, start + length == size[row]
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(end, zlib.crc32(data[4 * a : 4 * (a + n - 1)])) if z else zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n, z in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row]), pa.array(np.arange(made, made + len(row)))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
            made += len(row)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cuts = scratch.table(cut(docs, tokenizer, window, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(counts, window)
    # A size that many pieces have is ranked in blocks: at most window + 1000 of them, none over a thousandth of the rows.
    most = max(500, sum(counts.values()) // 1000)
    split = {n: -(-c // most) for n, c in counts.items() if c > most}
    blocks = F.lit(1)
    if split:
        blocks = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in split.items() for x in kv)), F.col("length").cast("int")), F.lit(1))
    cuts = cuts.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), blocks).cast("int"))
    before, sizes = {}, cuts.groupBy("length", "block").agg(F.count("*").alias("n"))
    for r in sorted(sizes.collect()):
        base, total = before.get((r["length"], None), 0), r["n"]
        before[r["length"], r["block"]] = base
        before[r["length"], None] = base + total
    ranked = cuts.withColumn("rank", F.expr("row_number() over (partition by length, block order by doc_id, start, ids_crc32, salt) - 1")).drop("salt")
    names, kind = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            size, block, rank = (batch.column(k).to_numpy() for k in ("length", "block", "rank"))
            rank = rank + np.fromiter((before[k] for k in zip(size.tolist(), block.tolist(), strict=True)), np.int64, len(size))
            sequence, offset = plan.place(size, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + ", sequence_id long, offset long")
