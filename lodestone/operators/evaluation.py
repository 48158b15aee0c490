"""Retrieval quality: runs (query_id, rank from 1, doc_id) against judgments (query_id, doc_id, relevant)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evaluate(runs: DataFrame, judgments: DataFrame, k: int = 0) -> DataFrame:
    """(query_id, precision, recall, average_precision, ndcg) for every judged query; a query without results has zeros.

    k is cut to the length of the list, as it is if k is below 1, so a short list isn't held against precision or nDCG. Gains are binary, discounts
    1 / log2(rank + 1), and the ideal list is cut at the same k. Recall and the rest are 0 where nothing is relevant.
    """
    wanted = judgments.where("relevant").select("query_id", "doc_id").distinct()
    total = judgments.groupBy("query_id").agg(F.countDistinct(F.when(F.col("relevant"), F.col("doc_id"))).cast("int").alias("total"))
    listed = runs.select("query_id", "rank", "doc_id").join(wanted.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    listed = listed.withColumn("hits", F.sum("hit").over(so_far)).withColumn("length", F.count("*").over(Window.partitionBy("query_id")).cast("int"))
    cut = F.when((F.lit(k) <= 0) | (F.lit(k) > F.col("length")), F.col("length")).otherwise(F.lit(k))
    seen = F.col("rank") <= F.col("cut")
    gain = F.col("hit") / F.log2(F.col("rank") + F.lit(1.0))
    sums = listed.withColumn("cut", cut).groupBy("query_id").agg(
        F.max("cut").alias("cut"), F.sum(F.when(seen, F.col("hit")).otherwise(0)).alias("found"),
        F.sum(F.when(seen, gain).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"))
    best = F.least(F.col("total"), F.col("cut"))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), F.greatest(best, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1.0)))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return total.join(sums, "query_id", "left").select(
        "query_id", share(F.col("found"), F.col("cut")).alias("precision"), share(F.col("found"), F.col("total")).alias("recall"),
        share(F.col("precisions"), F.col("total")).alias("average_precision"), share(F.col("dcg"), ideal).alias("ndcg"))


def mean_average_precision(runs: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row (map): the mean over judged queries, 0 without any."""
    return evaluate(runs, judgments).agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"))


def compare(named: dict[str, DataFrame], judgments: DataFrame, k: int = 3) -> DataFrame:
    """(engine, query_id, precision, recall, ndcg, average_precision, map) of several runs over the same judgments."""
    out = None
    for name, runs in named.items():
        one = evaluate(runs, judgments, k).withColumn("engine", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to compare")
    return out.withColumn("map", F.avg("average_precision").over(Window.partitionBy("engine"))).select("engine", "query_id", "precision", "recall", "ndcg", "average_precision", "map")
