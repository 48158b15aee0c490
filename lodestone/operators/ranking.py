"""Relevance scores as expressions over (doc_id, term, tf, qtf, df, length, n_docs, avg_length)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def term_score(self) -> Column:
        n, df, tf = (F.col(c).cast("double") for c in ("n_docs", "df", "tf"))
        mean = F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(1.0)
        idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
        return F.col("qtf") * idf * (tf * (self.k1 + 1.0)) / (tf + self.k1 * (1.0 - self.b + self.b * F.col("length") / mean))


@dataclass(frozen=True)
class TfIdf:
    def term_score(self) -> Column:
        return F.col("qtf") * (1.0 + F.log(F.col("tf").cast("double"))) * F.log(F.col("n_docs") / F.col("df"))


@dataclass(frozen=True)
class Proximity:
    """A base score, and weight / (1 + width of the least window that holds one of each matched term) where two or more terms match."""

    base: BM25 | TfIdf = BM25()
    weight: float = 1.0

    def term_score(self) -> Column:
        return self.base.term_score()


def least_windows(matched: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, width): in each document with two or more of the terms, the least span of positions with one of each that it holds.

    matched has (doc_id, term, positions). Running over a document's positions, the last position of each term is remembered; a window ends at each.
    """
    at = matched.select("doc_id", "term", F.explode("positions").alias("position"))
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc_id")
    lasts = [F.last(F.when(F.col("term") == t, F.col("position")), ignorenulls=True).over(w) for t in terms]
    seen = at.select("doc_id", "position", F.array(*lasts).alias("lasts"), F.size(F.collect_set("term").over(whole)).alias("present"))
    filled = F.filter("lasts", lambda x: x.isNotNull())
    full = seen.where(F.col("present") >= 2).where(F.size(filled) == F.col("present"))
    return full.groupBy("doc_id").agg(F.min(F.col("position") - F.array_min(filled)).alias("width"))
