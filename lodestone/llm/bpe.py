"""Operator 10: byte-pair encoding and decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm.common import filesystem, lean, slices

#: Where the public vocabulary lies and how texts are cut before merging. Both are parameters of encode().
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces that a worker remembers at most; longer pieces than CACHED_CHARS are never kept. Neither changes a result.
CACHE, CACHED_CHARS = 200_000, 48


class Known(dict):
    """Ids as int32 of the pieces last used, encoded where they are missing. When half of CACHE is full it becomes the older half, from which pieces that are used again come back, so frequent ones are never encoded anew."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge = merge
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.merge(piece.encode("utf-8"))).tobytes()
            if len(piece) > CACHED_CHARS:
                return ids
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Bpe:
    """A rank vocabulary: bytes -> id, where a lower id is an earlier merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.strings: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.strings[rank] = text
        self.find = regex.compile(pattern).findall
        self.known = Known(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The heap holds rank and left position of every pair that may merge; an entry whose pair has changed since is stale and skipped."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        symbols: list[bytes] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        mask = (1 << shift) - 1
        get = ranks.get
        heap = [r << shift | i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & mask
            left = symbols[i]
            j = after[i]
            if not left or j >= n:
                continue
            merged = left + symbols[j]
            if get(merged) != entry >> shift:
                continue
            symbols[i], symbols[j] = merged, b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(merged + symbols[k])) is not None:
                    heappush(heap, r << shift | i)
            h = before[i]
            if h >= 0 and (r := get(symbols[h] + merged)) is not None:
                heappush(heap, r << shift | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[symbols[i]])
            i = after[i]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text as int32."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def parse(data: bytes, pattern: str = PATTERN) -> Bpe:
    """The vocabulary that a rank file's bytes hold (base64 bytes and rank a line)."""
    return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    files, inner = filesystem(path)
    with files.open_input_stream(inner) as lines:
        return lines.read()


def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    """The vocabulary of a rank file, which may lie in any file system."""
    return parse(read_vocabulary(path), pattern)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, decoded again: (doc_id, n_tokens, token_ids, round_trip).

    One narrow pass, no shuffle. The vocabulary is read by the driver and broadcast, one or two megabytes, so executors need no file. A text is cut by ``pattern``; each piece is merged by rank. round_trip tells whether
    the ids' strings, concatenated, are the text's bytes. A null text gives null in the three columns; an empty text
    no ids, 0 and true. A text of any length is encoded whole. Repeated rows give repeated rows, a null id stays null;
    an empty table gives none. Further columns are ignored, whatever their names.
    """

    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = parse(shared.value, pattern)
        for batch in slices(batches):
            values, ends, good = bytearray(), [0], []
            texts = batch.column(1).to_pylist()
            for text in texts:
                if text is None:
                    good.append(None)
                else:
                    ids = bpe.packed(text)
                    good.append(bpe.decode(np.frombuffer(ids, np.int32).tolist()) == text.encode("utf-8"))
                    values += ids
                ends.append(len(values) // 4)
            nulls = np.array([t is None for t in texts])
            offsets = pa.array(ends, pa.int32(), mask=np.append(nulls, False))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(values, np.int32)))
            counts = pa.array(np.diff(ends).astype(np.int32), mask=nulls)
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, ids, pa.array(good, pa.bool_())], ["id", "n_tokens", "token_ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"id {kind}, n_tokens int, token_ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
