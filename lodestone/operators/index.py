"""The inverted index as tables: documents, postings, document, term and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.memory import Remembered, lean, runs, small_batches
from lodestone.functions.text import Analyzer, default_analyzer
from lodestone.functions.varbyte import encoded_bytes
from lodestone.sources.storage import remove


def latest(docs: DataFrame, order: str | None = None) -> DataFrame:
    """One row a doc_id: that with the greatest ``order``, which stands for time. Of equals, and without an order, the greatest row by its columns stays, so the choice is the same in every run."""
    rest = [c for c in docs.columns if c not in ("doc_id", order)]
    maps = [c for c in rest if docs.schema[c].dataType.simpleString().startswith("map")]
    names = {c: f"__{i}" for i, c in enumerate(c for c in rest if c not in maps)} | ({order: "__order"} if order else {})
    rank = F.struct(*(F.col(c).alias(names[c]) for c in sorted(names, key=lambda c: c != order)), F.lit(0).alias("__end"))
    if maps:  # which can't be compared, and come along
        best = docs.groupBy("doc_id").agg(F.max_by(F.struct(rank.alias("rank"), *maps), rank).alias("__row")).select("doc_id", "__row.rank", *(F.col("__row")[c].alias(c) for c in maps))
    else:
        best = docs.groupBy("doc_id").agg(F.max(rank).alias("rank"))
    return best.select(*(F.col("rank")[names[c]].alias(c) if c in names else F.col(c) for c in docs.columns))


def tokens(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, tokens) before stemming."""
    return docs.select("doc_id", analyzer.column(F.col("text")).alias("tokens"))


def rank(values: pa.Array) -> np.ndarray:
    """Each value's place in the order of all; each has its own, equals in the order in which they stand."""
    out = np.empty(len(values), np.int64)
    out[pc.array_sort_indices(values).to_numpy()] = np.arange(len(values))
    return out


def entries(cut: DataFrame, analyzer: Analyzer, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, term, length, tf, positions) from rows (keys, tokens): the terms of each row, and one row with a null term and the row's length.

    A row is cut into postings where it lies, in Arrow batches without a loop over tokens and without a shuffle, some TOKENS at a time, so that what a worker holds doesn't depend on how long texts are; stems
    are worked out once for each distinct word in use. What comes of a slice lies in the order of terms and, within one, of the last key, as save() sorts it, which spares most of a later sort. Positions count the tokens that the analyzer leaves, from 0, and length is how many those are.
    """
    stems, at = analyzer.stems, len(keys)

    def cut_up(batch: pa.RecordBatch, known: Remembered) -> pa.RecordBatch:
        lists = batch.column(at)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = pc.dictionary_encode(lists.flatten())
        terms, code, row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        if stems:
            stemmed = pc.dictionary_encode(pa.array(list(map(known.__getitem__, terms.to_pylist())), pa.string()))
            terms, number = stemmed.dictionary, stemmed.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            code = number[code]
            code, row = code[code >= 0], row[code >= 0]
        lengths = np.bincount(row, minlength=len(sizes))
        position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        by_term, by_key = rank(terms.cast(pa.string())), rank(batch.column(at - 1))
        order = np.argsort(by_term[code] * len(sizes) + by_key[row], kind="stable")
        code, row, position = code[order], row[order], position[order]
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, int)
        every, n = np.arange(len(sizes)), len(sizes)
        who = np.concatenate((row[starts], every))
        tf = np.diff(np.append(starts, len(code))) if len(starts) else np.zeros(0, int)
        spans = np.concatenate((np.append(starts, len(code)), np.full(n, len(code)))) if len(starts) else np.zeros(n + 1, int)
        null = np.concatenate((np.zeros(len(starts), bool), np.ones(n, bool)))
        term = terms.cast(pa.string()).take(pa.array(np.concatenate((code[starts], np.zeros(n, int))), mask=null))
        lists = pa.ListArray.from_arrays(pa.array(spans.astype(np.int32), mask=np.append(null, False)), pa.array(position.astype(np.int32)))
        columns = [*(batch.column(k).take(pa.array(who)) for k in range(at)), term, pa.array(lengths[who].astype(np.int32)), pa.array(np.concatenate((tf, np.zeros(n, int))).astype(np.int32), mask=null), lists]
        return pa.RecordBatch.from_arrays(columns, [*keys, "term", "length", "tf", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(analyzer.stem)
        for batch in batches:
            for start, end in runs(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy()):
                yield cut_up(batch.slice(start, end - start), known)

    kinds = ", ".join(f"`{k}` {cut.schema[k].dataType.simpleString()}" for k in keys)
    return small_batches(cut).select(*keys, "tokens").mapInArrow(lean(run), f"{kinds}, term string, length int, tf int, positions array<int>")


def postings(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, term, length, tf, positions), so that scoring needs no join."""
    return entries(tokens(docs, analyzer), analyzer).where("term is not null")


@dataclass(frozen=True)
class Index:
    """Tables of one index; every method returns a DataFrame or a new Index, and nothing is changed in place."""

    docs: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    analyzer: Analyzer
    entries: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, analyzer: Analyzer | None = None, order: str | None = None, check: bool = True, unique: bool = False) -> Index:
        """Index rows (doc_id, text, further columns as metadata). Of an id's rows one counts, the last by ``order``, see latest(); ids that are known to be ``unique`` spare the shuffle.

        Ids become strings. With ``check`` an empty or missing id is an error when the index is read.
        """
        analyzer = analyzer or default_analyzer()
        if not {"doc_id", "text"} <= set(docs.columns):
            raise ValueError("documents need the columns doc_id and text")
        key = F.col("doc_id").cast("string")
        if check:
            key = F.when(key.isNull() | (key == ""), F.raise_error(F.lit("a document needs an id"))).otherwise(key)
        docs = docs.withColumn("doc_id", key)
        docs = docs if unique else latest(docs, order)
        rows = entries(tokens(docs, analyzer), analyzer)
        return cls(docs, rows.where("term is not null"), rows.where("term is null").select("doc_id", "length"), analyzer, rows)

    def save(self, path: str, leaf: str = "") -> None:
        """Postings lie sorted by term and document in range partitions, so a query's terms read few row groups and a term of every document is spread over many.

        Texts are analysed once, from the documents as written, so that of an id's rows the last is only looked for once: what comes of them is written as it is, and read again for the ranges and the
        lengths. Each table goes to its own folder below path, and there to ``leaf``, if given.
        """
        spark, at = self.docs.sparkSession, lambda table: f"{path}/{table}{leaf and '/' + leaf}"
        self.docs.write.mode("overwrite").parquet(at("docs"))
        rows, lengths = self.postings, self.doc_stats
        if self.entries is not None:
            docs = spark.read.parquet(at("docs")).select("doc_id", "text")
            entries(tokens(docs, self.analyzer), self.analyzer).write.mode("overwrite").parquet(at("entries"))
            raw = spark.read.parquet(at("entries"))
            rows, lengths = raw.where("term is not null"), raw.where("term is null").select("doc_id", "length")
        rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(at("postings"))
        lengths.write.mode("overwrite").parquet(at("doc_stats"))
        if self.entries is not None:
            remove(spark, at("entries"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "doc_stats")), analyzer or default_analyzer())

    def delete(self, ids: list[str]) -> Index:
        """The index without these documents; an id it doesn't hold is an error."""
        ids = sorted({str(i) for i in ids})
        known = {r.doc_id for r in self.docs.where(F.col("doc_id").isin(ids)).select("doc_id").collect()}
        if missing := [i for i in ids if i not in known]:
            raise KeyError(f"no such document: {', '.join(missing)}")
        gone = F.col("doc_id").isin(ids)
        return replace(self, entries=None, **{t: getattr(self, t).where(~gone) for t in ("docs", "postings", "doc_stats")})

    def without(self, ids: DataFrame) -> Index:
        """The index without the documents of a table (doc_id) of any size; ids that it doesn't hold are passed over."""
        ids = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        return replace(self, entries=None, **{t: getattr(self, t).join(ids, "doc_id", "left_anti") for t in ("docs", "postings", "doc_stats")})

    def upsert(self, docs: DataFrame, order: str | None = None) -> Index:
        """The index with these documents in place of those of the same id; of several rows of one id the last counts, by ``order``, see latest()."""
        new = Index.build(docs, self.analyzer, order)
        ids = new.docs.select("doc_id")
        merge = lambda old, fresh: old.join(ids, "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
        return Index(merge(self.docs, new.docs), merge(self.postings, new.postings), merge(self.doc_stats, new.doc_stats), self.analyzer)

    def corpus_stats(self) -> DataFrame:
        """One row (n_docs, total_tokens, avg_length); documents without tokens count, an empty index has zeros."""
        n, total = F.count("*"), F.coalesce(F.sum("length"), F.lit(0))
        return self.doc_stats.agg(n.alias("n_docs"), total.alias("total_tokens"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))

    def term_stats(self) -> DataFrame:
        """(term, df, occurrences)"""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))

    def terms(self) -> DataFrame:
        return self.postings.select("term").distinct()

    def posting(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def document(self, doc_id: str) -> DataFrame:
        return self.docs.where(F.col("doc_id") == str(doc_id))

    def document_ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    def positions(self, term: str, doc_id: str) -> DataFrame:
        return self.posting(term).where(F.col("doc_id") == str(doc_id)).select("positions")

    def stats(self) -> DataFrame:
        """One row (n_docs, n_terms, avg_length)."""
        return self.corpus_stats().crossJoin(self.postings.agg(F.countDistinct("term").alias("n_terms"))).select("n_docs", "n_terms", "avg_length")

    def compression_stats(self) -> DataFrame:
        """One row (raw_bytes, encoded_bytes, ratio): 8 bytes a position against gap-coded bytes."""
        raw, packed = F.coalesce(F.sum(F.lit(8).cast("long") * F.size("positions")), F.lit(0)), F.coalesce(F.sum(encoded_bytes(F.col("positions")).cast("long")), F.lit(0))
        out = self.postings.agg(raw.alias("raw_bytes"), packed.alias("encoded_bytes"))
        return out.withColumn("ratio", F.when(F.col("encoded_bytes") > 0, F.col("raw_bytes") / F.col("encoded_bytes")).otherwise(0.0))
