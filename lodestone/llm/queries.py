"""The operators of this subpackage as queries over the tables documents, pages, embeddings, labels and benchmark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bit_sliced, bpe, decontaminate, html_extract, licenses, near_duplicates, quality, token_store, toxicity, warc
from lodestone.llm.common import new_path, read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20, among all rows."""
    vectors = read(spark, sf_dir, "embeddings")
    return bit_sliced.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a store of all documents' tokens, then fetch every document by its key."""
    docs = read(spark, sf_dir, "documents")
    uri = token_store.store(spark, docs)
    return token_store.lookup(docs, uri)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC files, then read them by byte ranges."""
    files = warc.write(read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.pages(warc.read(files, bodies=True))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_top_k, op3_token_store, op4_warc, op5_quality, op6_html, op7_toxicity, op8_near_duplicates, op9_decontaminate, op10_bpe)
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.scan_sql(),
    "op2_top_k": bit_sliced.SEARCH_SQL,
    "op4_warc": "SELECT page_id, url, html FROM pages",
    "op8_near_duplicates": near_duplicates.CLASSES_SQL,
    "op9_decontaminate": decontaminate.FIND_SQL,
}
