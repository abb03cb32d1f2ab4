"""Exact token counts of every prefix of a text, by dynamic programming.

A byte-pair encoding is right exactly where each two neighbouring tokens encode
back to themselves, so the encoding of each prefix of a piece is that of a
shorter prefix and one more token.  Pieces are taken in sorted order, and rows
of the table that a piece shares with the one before it stay.  A document's
table is its words' tables on end, each raised by the tokens before it; it
answers truncation and budget questions without encoding again.

Defined results: a null or empty text has no bytes and no tokens; a special
token counts as one where its string is whole and as plain text where a prefix
ends inside it; a text of any length is counted whole, and a word over 255
characters by a table of its own (quadratic only in the longest token); repeated
rows get equal counts; an empty table gives an empty table; other columns aren't
read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

#: Unicode White_Space, as the tokenizer's \s has it (fixed values).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the white space before it, or white space that ends a text: no token reaches over these bounds.
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_LEAD = re.compile(f"[{_WS}]*")
_SHORT = 255  # characters of a word whose table is kept, a byte a character
_CONTRACTION = r"'s|'t|'re|'ve|'m|'ll|'d"


def _byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one tokenizer file; holds caches of bounded size."""

    def __init__(self, path: str, most: int = 700_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_symbol()
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if s not in self.special}
        self.reach: dict[bytes, int] = {}  # the longest token that ends in these two bytes
        for t in self.tokens:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 0), len(t))
        self.piece = regex.compile(rf"{_CONTRACTION}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.most = most
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.of_piece: dict[str, bytes] = {}
        self.of_unit: dict[str, bytes] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _neighbours(self, a: bytes, b: bytes) -> bool:
        known = self.valid.get((a, b))
        if known is None:
            if len(self.valid) >= 4 * self.most:
                self.valid.clear()
            known = self.valid[a, b] = self._merge(a + b) == [a, b]
        return known

    def tables(self, pieces_: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of each prefix of each piece, the empty one first; sorted pieces share rows."""
        tokens, reach, before, count, last = self.tokens, self.reach, b"", [0], [b""]
        for piece in pieces_:
            n = len(piece)
            same = next((i for i, (a, b) in enumerate(zip(piece, before, strict=False)) if a != b), min(n, len(before)))
            del count[same + 1 :], last[same + 1 :]
            for end in range(same + 1, n + 1):
                start = max(0, end - reach.get(piece[max(0, end - 2) : end], 1))
                while not ((token := piece[start:end]) in tokens and (not start or self._neighbours(last[start], token))):
                    start += 1
                count.append(count[start] + 1)
                last.append(token)
            before = piece
            yield count

    def _by_character(self, some: list[str]) -> Iterator[list[int]]:
        """Tokens of each prefix but the empty one of sorted pieces, by characters."""
        for piece, count in zip(some, self.tables(x.encode() for x in some), strict=True):
            yield count[1:] if piece.isascii() else [count[k] for k in accumulate(len(ch.encode()) for ch in piece)]

    def _pieces(self, text: str) -> list[str]:
        """The tokenizer's pieces; a contraction is followed by its shorter prefixes' pieces, which split in other ways."""
        found = self.piece.findall(text)
        return found + [y for x in found if x[0] == "'" and len(x) > 1 for k in range(1, len(x)) for y in self.piece.findall(x[:k])]

    def _word(self, word: str, get: Callable[[str], Sequence[int]]) -> list[int]:
        """Tokens of each prefix but the empty one of a word, of which a blank may lead."""
        out: list[int] = []
        for piece in self.piece.findall(word):
            base = out[-1] if out else 0
            if piece[0] == "'" and len(piece) > 1:
                out += [base + sum(get(x)[-1] for x in self.piece.findall(piece[:k])) for k in range(1, len(piece))]
                out.append(base + get(piece)[-1])
            else:
                out += [base + x for x in get(piece)] if base else get(piece)
        return out

    def _unit(self, unit: str, get: Callable[[str], Sequence[int]]) -> list[int]:
        """Tokens of each prefix but the empty one of a word and the white space before it."""
        cut = _LEAD.match(unit).end()
        if cut == len(unit):
            return list(get(unit))
        if unit[:cut] in ("", " "):
            return self._word(unit, get)
        # Up to the word's start the white space is one piece; with the word its last character is apart from the rest.
        base = get(unit[: cut - 1])[-1] if cut > 1 else 0
        if unit[cut - 1] == " ":
            word = self._word(unit[cut - 1 :], get)[1:]
        else:
            base += get(unit[cut - 1])[-1]
            word = self._word(unit[cut:], get)
        return [*get(unit[:cut]), *(base + x for x in word)]

    def _unit_pieces(self, unit: str) -> list[str]:
        cut = _LEAD.match(unit).end()
        if cut == 0 or unit[:cut] == " " and cut < len(unit):
            return self._pieces(unit)
        return [unit[:cut], *([unit[: cut - 1]] if cut > 1 else []), unit[cut - 1], *self._pieces(unit[cut:]), *(self._pieces(unit[cut - 1 :]) if unit[cut - 1] == " " else [])]

    def _learn(self, units: set[str]) -> None:
        """Tables of new short units."""
        new = sorted({p for u in units for p in self._unit_pieces(u)}.difference(self.of_piece))
        self.of_piece.update(zip(new, map(bytes, self._by_character(new)), strict=True))
        for u in units:
            self.of_unit[u] = kept if (kept := self.of_piece.get(u)) is not None and u[0] != "'" else bytes(self._unit(u, self.of_piece.__getitem__))

    def _long(self, unit: str) -> list[int]:
        some = sorted(set(self._unit_pieces(unit)))
        return self._unit(unit, dict(zip(some, self._by_character(some), strict=True)).__getitem__)

    def _plain(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for each i over 0, no string in it being special."""
        tables = [np.array(self._long(u)) if len(u) > _SHORT else np.frombuffer(self._known([u])[0], np.uint8) for u in _UNIT.findall(text)]
        base = np.cumsum([0, *(int(t[-1]) for t in tables)])
        return np.concatenate([t.astype(np.int64) + b for t, b in zip(tables, base[:-1], strict=True)]) if tables else np.zeros(0, np.int64)

    def _known(self, units: list[str]) -> list[bytes]:
        fresh = set(units).difference(self.of_unit)
        if fresh:
            if len(self.of_unit) + len(fresh) > self.most or len(self.of_piece) > self.most:
                self.of_unit, self.of_piece, fresh = {}, {}, set(units)
            self._learn(fresh)
        return list(map(self.of_unit.__getitem__, units))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for each i."""
        out, at, base = [np.zeros(1, np.int64)], 0, 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            plain = self._plain(text[at : m.end() - 1])  # a cut inside the special string leaves plain text
            before = int(plain[m.start() - at - 1]) if m.start() > at else 0
            out += [plain + base, np.array([base + before + 1])]
            at, base = m.end(), base + before + 1
        out.append(self._plain(text[at:]) + base)
        return np.concatenate(out)

    def batch_tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all texts on end, without the empty prefixes, and where each begins (with the end of the last)."""
        units = [_UNIT.findall(t) for t in texts]
        apart = [i for i, (t, u) in enumerate(zip(texts, units, strict=True)) if len(t) > _SHORT and max(map(len, u), default=0) > _SHORT or "<|" in t and self.split_special and self.split_special.search(t)]
        for i in apart:
            units[i] = []
        data = self._known([u for some in units for u in some])
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat, stop = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size)
        tokens = np.concatenate(([0], np.cumsum(flat[stop - 1].astype(np.int64))))  # before each unit
        first = np.concatenate(([0], np.cumsum([len(u) for u in units])))  # each text's first unit
        table = flat + np.repeat(tokens[:-1] - np.repeat(tokens[first[:-1]], np.diff(first)), size)
        edge = np.concatenate(([0], stop))[first]
        if not apart:
            return table, edge
        parts = [self.prefix_counts(t)[1:] if i in set(apart) else table[edge[i] : edge[i + 1]] for i, t in enumerate(texts)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return int(self.prefix_counts(text)[-1])

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most budget tokens."""
        return text[: int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])]


_WORKER: dict[str, PrefixCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, whether the text is over limit tokens, and fits_chars, the characters of its longest prefix that isn't; all from the text's table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        if tokenizer not in _WORKER:
            _WORKER[tokenizer] = PrefixCounter(tokenizer)
        for batch in pieces(batches, 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            table, edge = _WORKER[tokenizer].batch_tables(texts)
            full = np.flatnonzero(np.diff(edge) > 0)
            n, fits = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            n[full] = table[edge[full + 1] - 1]
            if len(full):
                fits[full] = np.maximum(0, np.maximum.reduceat(np.where(table <= limit, np.arange(1, len(table) + 1), 0), edge[full]) - edge[full])
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit), pa.array(fits)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return docs.select("doc_id", F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
