"""Operator 2: exact top-k search on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import filesystem, materialise, new_path

#: Neighbours of a query, bits of an attribute's quantised value, rows of a segment of the index, of a block of queries, and segments that one task goes through.
TOP, BITS, SEGMENT_ROWS, QUERY_ROWS, GROUP_SEGMENTS = 10, 7, 8192, 256, 4
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


class Segment:
    """Rows of one segment: their vectors, and of each attribute the slices of its quantised values, slice b holding bit b of every row.

    An attribute's values are counted in steps from its least value; the step is the same for all attributes, so that slices can be added.
    """

    def __init__(self, rows: np.ndarray, bits: int = BITS):
        self.rows, self.bits = rows, bits
        wide = rows.astype(np.float64)
        self.low, self.high = wide.min(0), wide.max(0)
        self.step = max(float((self.high - self.low).max()) / ((1 << bits) - 1e-3), np.finfo(np.float64).tiny)
        levels = np.clip(np.floor((wide - self.low) / self.step), 0, (1 << bits) - 1).astype(np.uint16)
        n, width = rows.shape
        padded = np.zeros((width, -(-n // 64) * 64), np.uint16)
        padded[:, :n] = levels.T
        self.slices = np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)])
        self.present = np.packbits(np.arange(padded.shape[1]) < n, bitorder="little").view(np.uint64)

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.slices.tobytes(), np.concatenate((self.low, self.high, [self.step])).tobytes()

    @classmethod
    def from_bytes(cls, rows: np.ndarray, slices: bytes, frame: bytes, bits: int = BITS) -> Segment:
        own, (n, width) = cls.__new__(cls), rows.shape
        own.rows, own.bits = rows, bits
        numbers = np.frombuffer(frame, np.float64)
        own.low, own.high, own.step = numbers[:width], numbers[width : 2 * width], float(numbers[-1])
        own.slices = np.frombuffer(slices, np.uint64).reshape(bits, width, -1)
        own.present = np.packbits(np.arange(own.slices.shape[2] * 64) < n, bitorder="little").view(np.uint64)
        return own

    def differences(self, query: np.ndarray) -> tuple[np.ndarray, float]:
        """Slices of each attribute's |row - query| in steps, less 1 where the row is below, and by how much their sum may be too large.

        The true difference of an attribute lies between the number less f and the number plus 1 + f, where f is what rounding did to the query.
        """
        exact = (np.clip(query, self.low, self.high) - self.low) / self.step
        level = np.clip(np.rint(exact), 0, (1 << self.bits) - 1).astype(np.int64)
        out = np.empty_like(self.slices)
        borrow = np.zeros(self.slices.shape[1:], np.uint64)
        unequal, change = np.empty_like(borrow), np.empty_like(borrow)
        for b in range(self.bits):
            constant = np.where(level >> b & 1, _ONES, np.uint64(0))[:, None]
            np.bitwise_xor(self.slices[b], constant, out=unequal)
            np.bitwise_xor(unequal, borrow, out=out[b])
            np.bitwise_xor(borrow, constant, out=change)
            np.bitwise_and(change, unequal, out=change)
            np.bitwise_xor(borrow, change, out=borrow)
        np.bitwise_xor(out, borrow, out=out)
        return out, float(np.abs(exact - level).sum())

    @staticmethod
    def total(slices: np.ndarray) -> np.ndarray:
        """Slices of the sum over attributes: pairs of attributes are added bit by bit with carries, then pairs of sums, and so on."""
        while slices.shape[1] > 1:
            bits, width, words = slices.shape
            if width % 2:
                slices = np.concatenate((slices, np.zeros((bits, 1, words), np.uint64)), axis=1)
                width += 1
            half = width // 2
            out = np.empty((bits + 1, half, words), np.uint64)
            carry, unequal, change = np.zeros((half, words), np.uint64), np.empty((half, words), np.uint64), np.empty((half, words), np.uint64)
            for b in range(bits):
                left, right = slices[b, :half], slices[b, half:]
                np.bitwise_xor(left, right, out=unequal)
                np.bitwise_xor(unequal, carry, out=out[b])
                np.bitwise_xor(left, carry, out=change)
                np.bitwise_and(change, unequal, out=change)
                np.bitwise_xor(left, change, out=carry)
            out[bits] = carry
            slices = out
        return slices[:, 0]

    def top(self, query: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances (sum of absolute differences) of at least the k nearest rows, ties included; rows beyond ``bound`` may be left out.

        From the most significant slice down, the rows that still may hold the k-th least sum are narrowed until its bits are known. Rows whose sum
        is near enough to it that rounding could hide a nearer one are the boundary: their distances are computed from the vectors themselves.
        """
        wide = query.astype(np.float64)
        beyond = bound - float(np.abs(wide - np.clip(wide, self.low, self.high)).sum()) * (1 - 1e-9)  # what is left of the bound inside the segment's frame
        if beyond < 0:
            return np.zeros(0, np.int64), np.zeros(0)
        parts, off = self.differences(query)
        slices = self.total(parts)
        open_rows, below, least = self.present.copy(), 0, 0
        k = min(k, len(self.rows))
        for b in range(len(slices) - 1, -1, -1):
            zeros = open_rows & ~slices[b]
            n = int(np.bitwise_count(zeros).sum())
            if below + n >= k:
                open_rows = zeros
            else:
                below += n
                open_rows &= slices[b]
                least |= 1 << b
        most = int(least + self.rows.shape[1] + 2 * off + 1e-6 * (least + 1)) + 1
        if beyond / self.step + off < most:
            most = int((beyond / self.step + off) * (1 + 1e-9)) + 1
        most = min(most, (1 << len(slices)) - 1)
        less, equal = np.zeros_like(self.present), self.present.copy()
        for b in range(len(slices) - 1, -1, -1):
            if most >> b & 1:
                less |= equal & ~slices[b]
                equal &= slices[b]
            else:
                equal &= ~slices[b]
        near = np.flatnonzero(np.unpackbits((less | equal).view(np.uint8), bitorder="little"))
        return near, np.abs(self.rows[near].astype(np.float64) - wide).sum(1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & good).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("width", F.size("vector"))


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of each query by the sum of absolute differences, exactly: (<id>, rank, neighbour_id, distance). Without ``queries`` every row is one.

    Rows are hashed to segments of about SEGMENT_ROWS, each with its bit-sliced index, written once in groups of GROUP_SEGMENTS; queries are packed in blocks. A task takes one
    block through one group, reading a segment at a time, and carries each query's k-th distance from segment to segment, so a segment that lies beyond it costs
    next to nothing; the best k over all groups remain. Nothing is broadcast, and a task holds one segment. Ties go to the lesser id.
    distance is rounded to 6 digits after ranking. Rows with a null id or vector, or an empty one, or one with a null, NaN or infinite element have no neighbours
    and are none; an id that repeats counts once, with its least vector; a query is compared with rows of its own number of attributes but its own id. With fewer
    than k others there are fewer rows; an empty table on either side gives none. Further columns are ignored.
    """
    rows = materialise(_usable(vectors, id_col, vector_col), "vectors")
    asked = rows if queries is None else materialise(_usable(queries, id_col, vector_col), "asked")
    spark = vectors.sparkSession
    segments, blocks = max(1, -(-rows.count() // SEGMENT_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    groups = -(-segments // GROUP_SEGMENTS)

    def pack(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("id")
        return table, table["vector"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def index(table: pa.Table) -> pa.Table:
        table, x = pack(table)
        slices, frame = Segment(x).to_bytes()
        return pa.table({"group": pa.array([table["part"][0].as_py() % groups], pa.int64()), "width": table["width"][:1], "ids": pa.array([table["id"].to_numpy().tobytes()]), "rows": pa.array([x.tobytes()]), "slices": pa.array([slices]), "frame": pa.array([frame])})

    def block(table: pa.Table) -> pa.Table:
        table, x = pack(table)
        return pa.table({"part": table["part"][:1], "q_width": table["width"][:1], "q_ids": pa.array([table["id"].to_numpy().tobytes()]), "q_rows": pa.array([x.tobytes()])})

    place = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    indexed = rows.select("*", place(segments)).groupBy("width", "part").applyInArrow(index, "group long, width int, ids binary, rows binary, slices binary, frame binary")
    uri = new_path(spark, "bit-slices")
    indexed.write.partitionBy("group").parquet(uri)
    packed = materialise(asked.select("*", place(blocks)).groupBy("width", "part").applyInArrow(block, "part long, q_width int, q_ids binary, q_rows binary"), "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                width, q_ids = row["q_width"], np.frombuffer(row["q_ids"], np.int64)
                asked = np.frombuffer(row["q_rows"], np.float32).reshape(-1, width)
                best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q_ids)
                files, folder = filesystem(f"{uri}/group={row['group']}")
                if files.get_file_info(folder).type == pafs.FileType.NotFound:
                    continue
                for part in pads.dataset(folder, format="parquet", filesystem=files).to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1):
                    for j in range(part.num_rows):
                        if part.column("width")[j].as_py() != width:
                            continue
                        ids = np.frombuffer(part.column("ids")[j].as_py(), np.int64)
                        segment = Segment.from_bytes(np.frombuffer(part.column("rows")[j].as_py(), np.float32).reshape(-1, width), part.column("slices")[j].as_py(), part.column("frame")[j].as_py())
                        for q, (found, far) in enumerate(best):
                            near, distance = segment.top(asked[q], k + 1, far[-1] if len(far) == k else np.inf)
                            own = ids[near] != q_ids[q]
                            found, far = np.concatenate((found, ids[near[own]])), np.concatenate((far, distance[own]))
                            order = np.lexsort((found, far))[:k]
                            best[q] = found[order], far[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(f) for f, _ in best])), *(pa.array(np.concatenate(x)) for x in zip(*best))], ["id", "neighbour_id", "distance"])

    pairs = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(max(blocks * groups, 1), "q_width", "part", "group")
    met = pairs.mapInArrow(meet, "id long, neighbour_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id")).alias("rank")
    return met.select("id", rank, "neighbour_id", "distance").where(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


SEARCH_SQL = f"""
WITH base AS (SELECT vec_id, min(embedding) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
pairs AS (
    SELECT a.vec_id, b.vec_id AS neighbour_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(CAST(a.v[i] AS DOUBLE) - CAST(b.v[i] AS DOUBLE)))) AS d
    FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS r FROM pairs)
SELECT vec_id, CAST(r AS INTEGER) AS rank, neighbour_id, round(d, 6) AS distance FROM ranked WHERE r <= {TOP}"""
