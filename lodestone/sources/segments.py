"""A durable index of immutable segments with a manifest: appends, replacements and deletions without rewriting."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import Analyzer, default_analyzer
from lodestone.operators.index import Index

TABLES = ("docs", "postings", "doc_stats")
#: Segments after which flush() compacts.
COMPACT_AFTER = 100


class SegmentedStore:
    """Segments below one folder (a path or URI that Hadoop can open).

    Each table is one Parquet table whose partitions ``segment=<number>_<name>`` are the segments, so the live index is one scan a table however many there are; deletions are a table of the same shape, and cover
    documents in segments of lesser numbers. The manifest names the live segments and deletions; it is written beside and renamed, so a reader sees one version or the next, and what a
    failed writer leaves is never read. Replacing a document commits its deletion together with the segment that has it anew. One writer at a time. After ``compact_after`` segments a flush compacts.
    """

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer | None = None, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.analyzer, self.compact_after = spark, path.rstrip("/"), analyzer or default_analyzer(), compact_after
        self.buffer: DataFrame | None = None
        self.gone: DataFrame | None = None
        self.manifest = self._read_manifest()

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_manifest(self) -> dict:
        if not (versions := self._versions()):
            return {"version": 0, "segments": [], "tombstones": []}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/manifests/{versions[-1]}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, segments: list[str], tombstones: list[str]) -> None:
        new = {"version": self.manifest["version"] + 1, "segments": segments, "tombstones": tombstones}
        fs, path = self._fs()
        beside = path(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(beside)
        out.write(json.dumps(new).encode())
        out.close()
        if not fs.rename(beside, path(f"{self.path}/manifests/{new['version']}.json")):
            raise OSError("another writer committed first")
        self.manifest = new

    def _table(self, table: str, segments: list[str]) -> DataFrame:
        paths = [f"{self.path}/{table}/segment={name}" for name in segments]
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").option("mergeSchema", table == "docs").parquet(*paths)
        return rows.withColumn("__number", F.substring_index("segment", "_", 1).cast("int")).drop("segment")

    def _live(self, table: str) -> DataFrame | None:
        """Rows of the segments but for those that a later deletion covers."""
        if not self.manifest["segments"]:
            return None
        rows = self._table(table, self.manifest["segments"])
        if self.manifest["tombstones"]:
            dead = self._table("tombstones", self.manifest["tombstones"]).groupBy("doc_id").agg(F.max("__number").alias("__until"))
            rows = rows.join(dead, (rows["doc_id"] == dead["doc_id"]) & (rows["__number"] < dead["__until"]), "left_anti")
        return rows.drop("__number")

    def index(self) -> Index | None:
        """The live index, or None if nothing was ever flushed. What is only buffered isn't in it."""
        tables = [self._live(t) for t in TABLES]
        return None if tables[0] is None else Index(*tables, self.analyzer)

    def add(self, docs: DataFrame) -> None:
        """Buffer documents; they are durable after flush(). A later call's document replaces an earlier one's."""
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
        kept = None if self.buffer is None else self.buffer.join(docs.select("doc_id"), "doc_id", "left_anti")
        self.buffer = docs if kept is None else kept.unionByName(docs, allowMissingColumns=True)

    def remove(self, doc_id: str) -> None:
        """Forget a buffered document, and mark one in a segment as gone at the next flush(). An unknown id is a KeyError."""
        here = F.col("doc_id") == str(doc_id)
        buffered = self.buffer is not None and not self.buffer.where(here).isEmpty()
        live = self._live("docs")
        stored = live is not None and not live.where(here).isEmpty()
        if not buffered and not stored:
            raise KeyError(f"no such document: {doc_id}")
        if buffered:
            self.buffer = self.buffer.where(~here)
        if stored:
            row = self.spark.createDataFrame([(str(doc_id),)], "doc_id string")
            self.gone = row if self.gone is None else self.gone.unionByName(row)

    def flush(self) -> None:
        """Write the buffer as a segment and the ids it replaces or removes as tombstones, then commit both in one manifest. Nothing buffered, nothing done."""
        buffered = self.buffer is not None and not self.buffer.isEmpty()
        if not buffered and self.gone is None:
            return
        old, name = self.manifest["segments"], self._name()
        dead = self.gone
        if buffered:
            Index.build(self.buffer, self.analyzer).save(self.path, f"segment={name}")
            written = self.spark.read.parquet(f"{self.path}/docs/segment={name}").select("doc_id")
            dead = written if dead is None else dead.unionByName(written)
        tombstones = list(self.manifest["tombstones"])
        if old and dead is not None:
            dead.distinct().write.parquet(f"{self.path}/tombstones/segment={name}")
            tombstones.append(name)
        self._commit(old + [name] * buffered, tombstones)
        self.buffer = self.gone = None
        if len(self.manifest["segments"]) > self.compact_after or len(self.manifest["tombstones"]) > 2 * self.compact_after:
            self.compact()

    def _name(self) -> str:
        return f"{self.manifest['version'] + 1}_{uuid.uuid4().hex}"

    def compact(self) -> None:
        """Rewrite what is live as one segment and drop the deletions; nothing is analysed again."""
        index, name = self.index(), self._name()
        if index is not None:
            index.save(self.path, f"segment={name}")
            self._commit([name], [])

    def segment_count(self) -> int:
        return len(self.manifest["segments"])

    def vacuum(self) -> list[str]:
        """Delete segments, deletions and manifests that the manifest doesn't name; returns their names. Not while another reads or writes."""
        fs, path = self._fs()
        segments = {f"segment={n}" for n in self.manifest["segments"]}
        named = {t: segments for t in (*TABLES, "entries")} | {"tombstones": {f"segment={n}" for n in self.manifest["tombstones"]}, "manifests": {f"{self.manifest['version']}.json"}}
        removed = []
        for folder, keep in named.items():
            where = path(f"{self.path}/{folder}")
            for status in fs.listStatus(where) if fs.exists(where) else []:
                if (name := status.getPath().getName()) not in keep:
                    fs.delete(status.getPath(), True)
                    removed.append(f"{folder}/{name}")
        return removed
