"""Searching several fields of a document, each with its own index and boost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import Analyzer, default_analyzer
from lodestone.operators.index import entries
from lodestone.operators.ranking import BM25, TfIdf
from lodestone.operators.search import top


@dataclass(frozen=True)
class FieldedEngine:
    """Documents (doc_id, and a column or an entry of the map ``fields`` for each field). A boost of 0 counts as 1; the field ``text`` is the column text where the map lacks it."""

    docs: DataFrame
    boosts: dict[str, float]
    analyzer: Analyzer
    ranker: BM25 | TfIdf
    rows: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, boosts: dict[str, float], analyzer: Analyzer | None = None, ranker: BM25 | TfIdf | None = None) -> FieldedEngine:
        if not boosts:
            raise ValueError("a fielded engine needs the boost of at least one field")
        return cls(docs.withColumn("doc_id", F.col("doc_id").cast("string")), {f: b or 1.0 for f, b in boosts.items()}, analyzer or default_analyzer(), ranker or BM25())

    def add(self, docs: DataFrame) -> FieldedEngine:
        """The engine with these documents in place of those of the same id, all fields of which go."""
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
        kept = self.docs.join(docs.select("doc_id"), "doc_id", "left_anti")
        return FieldedEngine(kept.unionByName(docs, allowMissingColumns=True), self.boosts, self.analyzer, self.ranker)

    def postings(self) -> DataFrame:
        """(field, doc_id, length, term, tf), from one scan whatever the number of fields, without a shuffle; a row with a null term for each field that a document has."""
        if self.rows is not None:
            return self.rows

        def text(name: str):
            own = F.col(name) if name in self.docs.columns and name != "fields" else F.lit(None).cast("string")
            return F.coalesce(F.try_element_at("fields", F.lit(name)), own) if "fields" in self.docs.columns else own

        pairs = F.array(*(F.struct(F.lit(name).alias("field"), text(name).cast("string").alias("text")) for name in self.boosts))
        rows = self.docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.field", "p.text").where("text is not null")
        cut = rows.select("field", "doc_id", self.analyzer.column(F.col("text")).alias("tokens"))
        return entries(cut, self.analyzer, ("field", "doc_id")).select("field", "doc_id", "length", "term", "tf")

    def save(self, path: str) -> None:
        """Write the fields' postings, sorted by field and term, for load()."""
        self.postings().repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{path}/fields")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str, boosts: dict[str, float], analyzer: Analyzer | None = None, ranker: BM25 | TfIdf | None = None) -> FieldedEngine:
        """An engine over what save() wrote; a field that was not written has no postings."""
        rows = spark.read.parquet(f"{path}/fields").where(F.col("field").isin(sorted(boosts)))
        return cls(spark.read.parquet(f"{path}/docs"), {f: b or 1.0 for f, b in boosts.items()}, analyzer or default_analyzer(), ranker or BM25(), rows)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        words = self.analyzer(query)
        rows = self.postings()
        stats = rows.where("term is null").groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
        ours = rows.where(F.col("term").isin(sorted(set(words))))
        df = ours.groupBy("field", "term").agg(F.count("*").alias("df"))
        weights = F.create_map(*[x for w in sorted(set(words)) for x in (F.lit(w), F.lit(words.count(w)))]) if words else F.create_map(F.lit(""), F.lit(0))
        boosts = F.create_map(*[x for f, b in self.boosts.items() for x in (F.lit(f), F.lit(float(b)))])
        scored = ours.join(df, ["field", "term"]).join(stats, "field").withColumn("qtf", F.try_element_at(weights, F.col("term")))
        return top(scored.groupBy("doc_id").agg(F.sum(boosts[F.col("field")] * self.ranker.term_score()).alias("score")), limit)
