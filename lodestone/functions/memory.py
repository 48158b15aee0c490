"""What keeps Python workers small: batches bounded by bytes and tokens, words remembered while in use, freed memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch on its way to a worker, where the session doesn't say.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Tokens from which a slice of a batch is worked on by itself.
TOKENS = 1 << 18
#: Distinct words that a worker remembers, twice.
REMEMBERED = 100_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session was told to send batches of few bytes to Python: 10,000 rows, Spark's own bound, may be any number of bytes."""
    key, value = BATCH
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, value)
    return df


def runs(sizes: np.ndarray, most: int = TOKENS, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows that hold at most so many tokens, or one row, and at most so many rows. Every row is in one run."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield start, end
        start = end


class Remembered(dict):
    """word -> what a function makes of it. Words in use stay: when there are ``most``, they become the older half, which is looked into before the function is asked, and the half older still goes."""

    def __init__(self, of: Callable[[str], Hashable], most: int | None = None):
        super().__init__()
        self.of, self.most, self.older = of, most or REMEMBERED, {}

    def __missing__(self, word: str) -> Hashable:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self[word] = self.older[word] if word in self.older else self.of(word)
        return value


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and shares its executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable) -> Callable:
    """The same function over batches, tidy() after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied
