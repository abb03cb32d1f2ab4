"""Pieces of a text that hold at most so many tokens of a given tokenizer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

_WORD = re.compile(r"\S+")
_STOPS = (".", "!", "?")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    found.no_truncation()
    found.no_padding()
    return found


class Budget:
    """Cuts texts at sentences, else at words, else within a word; a piece starts with whole sentences of the one before, as many as the overlap holds.

    A text is encoded once; the tokens up to each word's end place the cuts, and
    each piece is then counted on its own, so none is over the budget.
    """

    def __init__(self, tokenizer: str, most: int = 500, overlap: int = 100):
        if not 0 <= overlap < most:
            raise ValueError("the overlap must be under the budget")
        self.tokenizer, self.most, self.overlap = _tokenizer(tokenizer), most, overlap

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """(piece, tokens) in order; white space at the ends of a text goes."""
        text = text.strip()
        if not text:
            return
        starts = [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        if len(starts) <= self.most:
            yield text, len(starts)
            return
        spans = [m.span() for m in _WORD.finditer(text)]
        upto = [0, *(bisect_left(starts, b) for _, b in spans)]  # tokens before each word's end
        stops = [j for j, (_, b) in enumerate(spans, 1) if text[b - 1] in _STOPS]
        first = done = 0  # the piece's first word, the words that pieces hold already
        while done < len(spans):
            last = self._last(upto, stops, first, done)
            while last > done and (tokens := self.count(piece := text[spans[first][0] : spans[last - 1][1]])) > self.most:
                last -= 1
            if last > done:
                yield piece, tokens
                done, first = last, self._overlap(upto, stops, first, last)
            elif first < done:
                first = done  # no word fits behind the overlap
            else:
                yield from self._within(text[slice(*spans[done])])
                first = done = done + 1

    def _last(self, upto: list[int], stops: list[int], first: int, done: int) -> int:
        """How many words reach the budget's end, or the last sentence's end before it."""
        last = bisect_left(upto, upto[first] + self.most + 1, done) - 1
        if last >= len(upto) - 1:
            return len(upto) - 1
        at = bisect_left(stops, last + 1) - 1
        return stops[at] if at >= 0 and stops[at] > done else last

    def _overlap(self, upto: list[int], stops: list[int], first: int, last: int) -> int:
        """The first sentence behind the piece's own first word from which on the overlap holds the piece's end."""
        at = bisect_left(stops, first + 1)
        while at < len(stops) and stops[at] < last:
            if upto[last] - upto[stops[at]] <= self.overlap:
                return stops[at]
            at += 1
        return last

    def _within(self, word: str) -> Iterator[tuple[str, int]]:
        """Pieces of a word that is over the budget alone."""
        while word:
            starts = [a for a, _ in self.tokenizer.encode(word, add_special_tokens=False).offsets]
            end = starts[self.most] if len(starts) > self.most else len(word)
            while end > 1 and self.count(word[:end]) > self.most:
                end -= 1
            end = max(end, 1)
            yield word[:end], self.count(word[:end])
            word = word[end:]
