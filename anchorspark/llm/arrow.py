"""Arrow-batch helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; bytes.split() splits on exactly them.
ASCII_SPACE = b" \t\n\v\f\r"


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, nulls kept."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds few rows or about most_bytes, whatever a row's length."""
    for batch in batches:
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def coded_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All texts' words on end, dictionary-coded, and where each text's begin (with the end of the last).

    White space at either end of a text leaves an empty word.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    return split.flatten().dictionary_encode(), np.asarray(split.offsets) - split.offsets[0].as_py()


def ascii_lower(text):
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
