"""From raw documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, near_duplicates, quality, toxicity
from lodestone.llm.common import discard, materialise, read


# Each stage works on all rows of docs. The first four return rows of docs as they are, with all their columns, whatever further ones there are; a null id never makes a row go or fail.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, see quality.train() and quality.kept(): null texts go, repeated rows stay or go together, an empty table gives none."""
    return quality.kept(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, see toxicity.train() and toxicity.clean(): null texts stay, repeated rows stay or go together, an empty table gives none."""
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates, see near_duplicates.keep_one(): rows with a null id or text stay, as do repeated rows of an id that stays."""
    return near_duplicates.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, see decontaminate.remove(): null and empty texts stay, an empty benchmark leaves all rows."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, see bpe.encode(): a row for each row, nulls for a null text."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The classifiers are trained on the tables, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents: (doc_id, n_tokens, token_ids, round_trip) of what is left.

    Each stage's rows are written to the shared folder and read again, so a lost executor costs a stage's unwritten part at most; the rows before them are deleted then.
    Nulls, repeated rows, empty tables and further columns pass as the stages say.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
