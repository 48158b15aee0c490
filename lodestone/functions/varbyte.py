"""Variable-byte code of position gaps: 7 bits a byte, the low ones first, the high bit set on the last byte of a number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(value: int) -> bytes:
    out = bytearray()
    while value >= 128:
        out.append(value & 127)
        value >>= 7
    out.append(value | 128)
    return bytes(out)


def encode_gaps(positions: list[int]) -> bytes:
    """The count, then the first position and each gap to the next."""
    return _number(len(positions)) + b"".join(_number(p - q) for p, q in zip(positions, [0, *positions]))


def decode_gaps(data: bytes) -> list[int]:
    numbers, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte & 128:
            numbers.append(value)
            value = shift = 0
    out, at = [], 0
    for gap in numbers[1 : 1 + numbers[0]] if numbers else []:
        at += gap
        out.append(at)
    return out


def number_bytes(value: Column) -> Column:
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


def encoded_bytes(positions: Column) -> Column:
    """Length of encode_gaps(positions), without encoding."""
    gaps = F.transform(positions, lambda x, i: x - F.when(i > 0, F.element_at(positions, F.greatest(i, F.lit(1)))).otherwise(0))
    return number_bytes(F.size(positions)) + F.aggregate(gaps, F.lit(0), lambda total, gap: total + number_bytes(gap))


def encode_lists(lists: pa.Array) -> pa.Array:
    """encode_gaps() of each list of a batch, all numbers at once; a null gives null."""
    null = lists.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy()).astype(np.int64)
    flat, n = lists.flatten().to_numpy().astype(np.int64), len(lists)
    heads = np.cumsum(sizes + 1) - sizes - 1
    numbers = np.zeros(len(flat) + n, np.int64)
    rest = np.ones(len(numbers), bool)
    rest[heads] = False
    numbers[heads], numbers[rest] = sizes, flat
    follows = rest[1:] & rest[:-1]  # neither a count nor a first position
    numbers[1:][follows] = (numbers[1:] - numbers[:-1])[follows]
    widths = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(widths)
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    for k in range(5):
        here = widths > k
        out[(ends - widths)[here] + k] = numbers[here] >> 7 * k & 127
    out[ends - 1] |= 128
    offsets = np.append(0, ends[heads + sizes] if n else []).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return pc.if_else(pa.array(null), pa.scalar(None, pa.binary()), coded)


def encode_gaps_column(positions: Column | str) -> Column:
    """encode_lists() over Arrow batches."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return encode_lists(lists)

    return run(positions)
