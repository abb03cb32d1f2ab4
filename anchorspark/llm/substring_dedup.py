"""Removal of long word runs that an earlier document has too.

Difference-cover anchors: positions whose residue modulo a period lies in a
difference cover are hashed over a short anchor.  For any two places with equal
windows some offset within the period is a cover position in both, so they
share an aligned anchor.  Anchors that several documents have are extended to
the windows around them, and these are compared by 96-bit hashes.

Defined results: a null or empty text has no words and loses none; doc_id may be
of any type that Spark orders, and smaller is smaller in that order; a null
doc_id is neither smaller nor larger than another, so its text is kept; rows
that repeat a doc_id don't count against each other; a text of any length is
read whole (a batch holds 1 MB of texts or one text); an empty table gives an
empty table; extra columns are passed through by remove_repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, utf8
from .scratch import Scratch, unused

#: Perfect difference sets by their modulus (fixed values).
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def period_for(window: int, least_anchor: int = 16) -> int:
    """The longest period that leaves anchors of least_anchor words, else the shortest."""
    return max((p for p in COVERS if window - p + 1 >= min(least_anchor, window)), default=min(COVERS))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _WordHash()
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_HASH) > 600_000:
        _HASH.clear()
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 15, 1 << n.bit_length())
        _POWERS.clear()
        for base in _BASES:
            inverse = pow(base, -1, 1 << 64)
            _POWERS.append(tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64))), dtype=np.uint64) for x in (base, inverse)))
    return _POWERS[which]


def window_hashes(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of width words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1, which)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    key = (total[width:] - total[: n - width + 1]) * down[: n - width + 1]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(29))


def _emit(ids: pa.Array, parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The parts' columns on end; the first has the row of each, whose doc_id is put for it."""
    rows, *columns = (pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([ids.take(rows), *columns], ["doc_id", *names])


def _anchors(window: int, period: int):
    width, cover = window - period + 1, np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def run(batches):
        for batch in pieces(batches, 1 << 20):
            parts = []
            for row, text in enumerate(utf8(batch.column(1))):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                at = np.flatnonzero(cover[np.arange(len(words) - width + 1) % period])
                parts.append((np.full(len(at), row), window_hashes(word_hashes(words), width)[at].view(np.int64), at.astype(np.int32)))
            if parts:
                yield _emit(batch.column(0), parts, ["anchor", "pos"])

    return run


def _windows(window: int, period: int):
    def run(batches):
        for batch in pieces(batches, 1 << 20):
            parts = []
            for row, (text, spots) in enumerate(zip(utf8(batch.column(1)), batch.column(2), strict=True)):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                spots, edge = spots.values.to_numpy(zero_copy_only=False), np.zeros(len(words) + 1, np.int64)
                spots = spots[spots < len(words)]
                np.add.at(edge, np.maximum(spots - (period - 1), 0), 1)
                np.add.at(edge, spots + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(words) - window + 1] > 0)
                hashes = word_hashes(words)
                h, g = (window_hashes(hashes, window, k)[at] for k in (0, 1))
                parts.append((np.full(len(at), row), h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32), at.astype(np.int32)))
            if parts:
                yield _emit(batch.column(0), parts, ["h", "g", "pos"])

    return run


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, found array<struct<pos, h>>): starts of windows that also start in a document with a smaller doc_id."""
    period = period_for(window)
    texts, kind = docs.select("doc_id", "text").where("doc_id is not null"), docs.schema["doc_id"].dataType.simpleString()
    anchors = scratch.table(texts.mapInArrow(_anchors(window, period), f"doc_id {kind}, anchor long, pos int"), "anchors")
    shared = scratch.table(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "shared")
    spots = scratch.table(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("pos").alias("spots")), "spots")
    scratch.drop("anchors", "shared")
    # Texts meet their spots by a shuffle at every size, not by a broadcast while the corpus is small.
    near = texts.join(spots.hint("merge"), "doc_id").select("doc_id", "text", "spots")
    windows = scratch.table(near.mapInArrow(_windows(window, period), f"doc_id {kind}, h long, g int, pos int"), "windows")
    first = scratch.table(windows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("b")).where("first < b").drop("b"), "first")
    found = windows.join(first, ["h", "g"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "h")).alias("found"))
    found = scratch.table(found, "found")
    scratch.drop("spots", "windows", "first")
    return found


def _kept(words: list[bytes], found, window: int) -> tuple[list[bytes], int]:
    """The words that no found window covers, and how many went."""
    if found is None or len(words) < window:
        return words, 0
    pos, h = (found.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "h"))
    real = window_hashes(word_hashes(words), window).view(np.int64)
    at = pos[pos < len(real)]
    at = at[real[at] == h[pos < len(real)]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def _with_found(docs: DataFrame, window: int) -> DataFrame:
    found = repeated_windows(docs, window, Scratch(docs.sparkSession, "substrings"))
    found_id, name = (unused(x, docs.columns) for x in ("found_id", "found"))
    found = found.select(F.col("doc_id").alias(found_id), F.col("found").alias(name))
    return docs.join(found.hint("merge"), F.col("doc_id") == F.col(found_id), "left").select(*docs.columns, name)


def _of(column: pa.Array) -> list:
    """Each row's struct array, or None."""
    return [v.values if v.is_valid else None for v in column]


def removal_report(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for text, found in zip(utf8(batch.column(1)), _of(batch.column(2)), strict=True):
                words = (text or b"").split()
                kept, gone = _kept(words, found, window)
                rows.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_found(docs.select("doc_id", "text"), window).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with repeated runs cut from the text; a text that loses words comes back with one space between words."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in pieces(batches):
            out = []
            for text, found in zip(utf8(batch.column(at)), _of(batch.column(len(names))), strict=True):
                kept, gone = _kept((text or b"").split(), found, window) if found is not None else ([], 0)
                out.append(b" ".join(kept) if gone else text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_found(docs, window).mapInArrow(run, docs.schema)
