"""Quality rules as a short-circuit cascade.

On a sample each statistic is timed, once what it is made from is there, and
the rules that reject a text are noted together.  The cascade is then planned
step by step: of the rules left, the next is that with the most rejections,
among the texts that no earlier rule rejects, per second of the statistics that
no earlier rule has made.  A document stops at the first rule that rejects it.
The verdict is "no rule rejects", so it doesn't depend on the order; only the
time does.

Defined results: a null or empty text has no words (and so is too short); a
text of any length is read whole, in memory of a few numbers a word; repeated
rows get equal verdicts; rules of equal worth keep their listed order; an empty
table gives an empty table; the output has the key column and the fixed columns
below, so clashing extra columns of the input play no part, and keep_rows
passes them through.
"""

from __future__ import annotations

import time
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ASCII_SPACE, pieces, utf8

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = ASCII_SPACE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)
WINDOW = 8


class TextStats:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper(self) -> int:
        return len(self.text) - len(self.text.translate(None, _UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.text) - len(self.text.translate(None, _LOWER))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_window_words(self.words, WINDOW)


def repeated_window_words(words: Sequence[bytes], width: int) -> int:
    """Words that lie in a window of width words found at least twice."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    starts = len(words) - width + 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(starts, np.uint64)
    for i in range(width):
        key = key * _MIX[1] + mixed[i : i + starts]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of each window, the first with an equal key
    if any((ids[order + i] != ids[first + i]).any() for i in range(width)):  # keys that clash: compare the windows themselves
        _, group, size = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0, return_inverse=True, return_counts=True)
        at = np.flatnonzero(size[group.ravel()] > 1)
    else:
        at = order[~(new & np.concatenate((new[1:], [True])))]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


#: What each statistic is made from, in an order in which they can be made.
STATS = {"words": (), "n_words": ("words",), "word_chars": (), "n_symbols": (), "lines": (), "n_dup_lines": ("lines",), "n_upper": (), "n_lower": (), "n_repeat_words": ("words",)}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextStats], bool]
    needs: tuple[str, ...]

    @property
    def makes(self) -> set[str]:
        return {x for n in self.needs for x in (n, *STATS[n])}


def _too_short(s: TextStats) -> bool:
    return s.n_words < 20


def _repetitive(s: TextStats) -> bool:
    return 100 * s.n_repeat_words > 30 * s.n_words


def _symbols(s: TextStats) -> bool:
    return 10 * s.n_symbols > s.word_chars


def _same_lines(s: TextStats) -> bool:
    return 2 * s.n_dup_lines > len(s.lines)


def _word_length(s: TextStats) -> bool:
    return s.word_chars < 2 * s.n_words or s.word_chars > 20 * s.n_words


def _shouting(s: TextStats) -> bool:
    return s.n_upper > s.n_lower


BASE_RULES = (Rule("too_short", _too_short, ("n_words",)), Rule("repetitive", _repetitive, ("n_repeat_words", "n_words")))
RULES = (
    *BASE_RULES, Rule("symbols", _symbols, ("n_symbols", "word_chars")), Rule("same_lines", _same_lines, ("n_dup_lines", "lines")),
    Rule("word_length", _word_length, ("word_chars", "n_words")), Rule("shouting", _shouting, ("n_upper", "n_lower")),
)


@dataclass(frozen=True)
class Measured:
    """Of a sample: seconds of each statistic, and how many texts each set of rules (as bits) rejects."""

    seconds: dict[str, float]
    rejected: dict[int, int]


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, text_col: str = "text", seed: int = 7) -> Measured:
    """Statistics' times and rules' joint rejections on about sample_rows documents, summed on the executors."""
    texts = docs.select(F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(1, docs.select(F.lit(1)).count()))

    def probe(batches):
        ns, masks = dict.fromkeys(STATS, 0), Counter()
        for batch in pieces(batches):
            for text in utf8(batch.column(0)):
                stats = TextStats(text)
                for k in STATS:
                    began = time.perf_counter_ns()
                    getattr(stats, k)
                    ns[k] += time.perf_counter_ns() - began
                masks[sum(rule.rejects(stats) << i for i, rule in enumerate(rules))] += 1
        yield pa.RecordBatch.from_pydict({"stat": [*ns, *([None] * len(masks))], "mask": pa.array([*([None] * len(ns)), *masks], pa.int64()), "n": [*ns.values(), *masks.values()]})

    rows = texts.sample(False, share, seed).mapInArrow(probe, "stat string, mask long, n long").groupBy("stat", "mask").agg(F.sum("n").alias("n")).collect()
    return Measured({r["stat"]: r["n"] / 1e9 for r in rows if r["stat"]}, {r["mask"]: r["n"] for r in rows if r["stat"] is None})


def order_rules(rules: Sequence[Rule], measured: Measured) -> list[Rule]:
    """The cascade: each next rule has the most rejections of texts still in it per second that it adds."""
    left, alive, made, out = list(enumerate(rules)), dict(measured.rejected), set(), []
    while left:

        def worth(x):
            cost = sum(measured.seconds.get(k, 0.0) for k in x[1].makes - made)
            return (sum(n for mask, n in alive.items() if mask >> x[0] & 1) + 1e-9) / (cost + 1e-9)

        best = max(left, key=worth)
        left.remove(best)
        out.append(best[1])
        made |= best[1].makes
        alive = {mask: n for mask, n in alive.items() if not mask >> best[0] & 1}
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, keep_rows: bool = False) -> DataFrame:
    """One row per document: its base statistics, base_failed and kept; rules should hold the base ones.

    With keep_rows the input's rows that pass come back instead, unchanged.
    """
    ordered = order_rules(rules, measure(docs, rules, sample_rows, text_col))

    def first_against(s: TextStats) -> str | None:
        return next((r.name for r in ordered if r.rejects(s)), None)

    if keep_rows:
        at = docs.columns.index(text_col)

        def keep(batches):
            for batch in pieces(batches):
                yield batch.filter(pa.array([first_against(TextStats(t)) is None for t in utf8(batch.column(at))], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def stats(batches):
        for batch in pieces(batches):
            out: dict[str, list] = {k: [] for k in (*counts, "base_failed", "kept")}
            for text in utf8(batch.column(1)):
                s = TextStats(text)
                out["kept"].append(first_against(s) is None)  # what the cascade has made stays; the columns need the rest
                out["base_failed"].append(any(r.rejects(s) for r in base))
                for k in counts:
                    out[k].append(getattr(s, k))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k in counts else pa.bool_()) for k, v in out.items())], [id_col, *out])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias(id_col), F.col(text_col)).mapInArrow(stats, f"{id_col} {kind}, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean")
