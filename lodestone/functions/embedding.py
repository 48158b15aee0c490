"""Hashed bag-of-words vectors, in Arrow batches, and dot products, in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.memory import lean, runs, small_batches
from lodestone.functions.text import letters_and_digits, py_letters_and_digits

DIMENSIONS = 256


def py_fnv1a(text: str) -> int:
    """32-bit FNV-1a of the UTF-8 bytes."""
    h = 2166136261
    for byte in text.encode():
        h = (h ^ byte) * 16777619 % (1 << 32)
    return h


def py_embed(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    out = [0.0] * dimensions
    for word in py_letters_and_digits(text):
        h = py_fnv1a(word)
        out[h % dimensions] += -1.0 if h >> 31 else 1.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def hashes(words: pa.Array) -> np.ndarray:
    """py_fnv1a() of each word, a byte of all words at a time; the few that are longer than LONG one by one."""
    coded = words.cast(pa.large_binary())
    sizes = pc.binary_length(coded).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded)]
    data = np.frombuffer(coded.buffers()[2] or b"\0", np.uint8)
    out = np.full(len(coded), 2166136261, np.uint64)
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    first = int((sizes > LONG).sum())
    for i in order[:first]:
        out[i] = py_fnv1a(words[int(i)].as_py())
    order = order[first:]
    at, sizes, h = offsets[order], sizes[order], out[order]
    left = len(order)
    for k in range(int(sizes.max(initial=0))):
        left = int(np.searchsorted(-sizes, -k, "left"))  # words with more than k bytes
        h[:left] = (h[:left] ^ data[at[:left] + k]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    out[order] = h
    return out.astype(np.int64)


#: Bytes of a word up to which all words are hashed together; rows whose cells a worker counts at once.
LONG, ROWS = 64, 500


def embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vector) with unit vectors: each word adds 1, or -1 if its hash has the top bit, to the dimension its hash names. A text without words has the zero vector; texts of one id count as one.

    Cells are counted where a text lies, and only those that aren't 0 are shuffled, to meet those of the same id.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in runs(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(), rows=ROWS):
                part = batch.slice(start, end - start)
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy()
                coded = pc.dictionary_encode(part.column(1).flatten())
                h = hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dimensions + h % dimensions, np.where(h >= 1 << 31, -1, 1), len(sizes) * dimensions).astype(np.int64)
                found = np.flatnonzero(sums)
                starts = pa.array(np.searchsorted(found, np.arange(len(sizes) + 1) * dimensions).astype(np.int32))
                cells = (pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (found % dimensions, sums[found]))
                yield pa.RecordBatch.from_arrays([part.column(0), *cells], ["id", "at", "n"])

    def scaled(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((sums * sums).sum(1).astype(np.float64))[:, None]
        values = np.divide(sums, norm, out=np.zeros(sums.shape), where=norm > 0).astype(np.float32)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dimensions), pa.array(values.ravel()))], [id_col, "vector"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[pa.Array, np.ndarray] | None = None  # an id of which the next batch may have more
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids = batch.column(0)
            code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh = np.append(True, code[1:] != code[:-1])
            row = np.repeat(np.cumsum(fresh) - 1, pc.list_value_length(batch.column(1)).to_numpy())
            at, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            sums = np.bincount(row * dimensions + at, n, int(fresh.sum()) * dimensions).astype(np.int64).reshape(-1, dimensions)
            ids = ids.take(pa.array(np.flatnonzero(fresh)))
            if last is not None and last[0][0].as_py() == ids[0].as_py():
                sums[0] += last[1][0]
            elif last is not None:
                yield scaled(*last)
            last = ids[-1:], sums[-1:].copy()
            if len(ids) > 1:
                yield scaled(ids[:-1], sums[:-1])
        if last is not None:
            yield scaled(*last)

    kind = docs.schema[id_col].dataType.simpleString()
    cut = small_batches(docs).select(docs[id_col].alias("id"), letters_and_digits(docs[text_col]).alias("words"))
    counted = cut.mapInArrow(lean(count), f"id {kind}, at array<int>, n array<int>")
    return counted.repartition("id").sortWithinPartitions("id").mapInArrow(lean(merge), f"`{id_col}` {kind}, vector array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
