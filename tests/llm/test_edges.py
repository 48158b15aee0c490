"""Nulls, empty and long texts, repeated rows, empty tables and clashing further columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bit_sliced, bpe, decontaminate, html_extract, licenses, near_duplicates, quality, token_store, toxicity, warc

LONG = "a fairly ordinary sentence about rivers and boats number {} ends here. "
TEXTS = "doc_id long, text string, id string, words int, keep int, gone int, set_id int, bucket int, rank int, label int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6, 7) for i, t in rows], TEXTS)


@pytest.fixture(scope="module")
def awkward(spark):
    long = "".join(LONG.format(i) for i in range(8000))
    return docs(spark, [(1, LONG.format(1)), (1, LONG.format(1)), (None, "no id here at all, only words"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "ünï 漢字 \0 ☃"), (None, None)])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, None, None), (5, 0, 1), (None, 1, 1), (6, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(7, LONG.format(4321)), (None, "x y z"), (8, None), (9, ""), (10, "too short")], "item_id long, text string")


@pytest.fixture(scope="module")
def models(awkward, labels):
    return quality.train(awkward, labels), toxicity.train(awkward, labels)


def test_quality(spark, awkward, labels, models):
    rows = quality.classify(awkward, models[0]).collect()
    assert len(rows) == 9 and all((r.score is None) == (r.doc_id == 2 or (r.doc_id is None and not r.keep and r.score is None)) for r in rows)
    assert sum(r.score is None for r in rows) == 2 and not any(r.keep for r in rows if r.score is None)
    kept = quality.kept(awkward, models[0])
    assert kept.columns == awkward.columns and kept.count() == sum(r.keep for r in rows)
    none = docs(spark, [])
    assert quality.classify(none, quality.train(none, labels.limit(0))).count() == 0 and quality.kept(none, models[0]).count() == 0


def test_toxicity(spark, awkward, labels, models):
    rows = toxicity.classify(awkward, models[1]).collect()
    assert len(rows) == 9 and sum(r.p_toxic is None for r in rows) == 2 and not any(r.is_toxic for r in rows if r.p_toxic is None)
    kept = toxicity.clean(awkward, models[1])
    assert kept.columns == awkward.columns and kept.count() == 9 - sum(r.is_toxic for r in rows)
    none = docs(spark, [])
    assert toxicity.classify(none, toxicity.train(none, labels.limit(0))).count() == 0
    assert not any(r.is_toxic for r in toxicity.classify(awkward, toxicity.train(none, labels)).collect())


def test_near_duplicates(spark, awkward):
    assert near_duplicates.join(awkward).count() == 0  # a repeated row is no pair
    assert near_duplicates.keep_one(awkward).count() == 9 and near_duplicates.keep_one(awkward).columns == awkward.columns
    none = docs(spark, [])
    assert near_duplicates.join(none).count() == 0 and near_duplicates.keep_one(none).count() == 0
    copies = docs(spark, [(i, "one two three four") for i in (9, 3, 5)] + [(4, "!!!"), (8, "!!!")])
    assert {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.join(copies).collect()} == {(3, 5), (3, 9)}
    assert {tuple(r) for r in near_duplicates.classes(copies).collect()} == {(3, 3, 2), (5, 3, 2), (9, 3, 2), (4, 4, 0), (8, 8, 0)}
    several = docs(spark, [(1, "one two three four"), (2, "one two three four"), (2, "five six seven eight"), (7, "five six seven eight")])  # an id with two texts connects their classes
    assert {tuple(r) for r in near_duplicates.classes(several).collect()} == {(1, 1, 1), (2, 1, 2), (7, 1, 1)}
    assert [r.doc_id for r in near_duplicates.keep_one(several).collect()] == [1]
    assert {tuple(r) for r in near_duplicates.classes(awkward).collect()} == {(i, i, 0) for i in range(1, 7)} and near_duplicates.classes(none).count() == 0
    assert sorted(r.doc_id for r in near_duplicates.keep_one(copies).collect()) == [3, 4, 8]


def test_decontaminate(spark, awkward, benchmark):
    rows = decontaminate.find(awkward, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 7), (5, 7)}  # windows before and after the number match, too
    assert sorted(r.doc_id or 0 for r in decontaminate.remove(awkward, benchmark).collect()) == [0, 0, 2, 3, 4, 6]
    assert decontaminate.remove(awkward, benchmark.limit(0)).count() == 9 and decontaminate.find(awkward, benchmark.limit(0)).count() == 0
    assert decontaminate.find(docs(spark, []), benchmark).count() == 0


def test_bpe(spark, awkward):
    rows = bpe.encode(awkward).collect()
    assert len(rows) == 9 and sum(r.token_ids is None for r in rows) == 2 and all(r.round_trip in (True, None) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 3] == [0] and bpe.encode(docs(spark, [])).count() == 0


def test_licenses(spark, awkward):
    assert licenses.scan(awkward).count() == 0 and licenses.scan(docs(spark, [])).count() == 0
    own = licenses.known(spark, {"Own": "Copyright (c) 2020 Me\nUse it freely."})
    texts = docs(spark, [(1, "USE, it   freely"), (1, "USE, it   freely"), (2, "some words\n# use it freely!\nmore"), (3, None), (4, "use it freely, or not")])
    found = sorted((r.doc_id, r.unit, r.line_no, r.license_id) for r in licenses.scan(texts, own).collect())
    assert found == [(1, "text", 0, "Own"), (1, "text", 0, "Own"), (2, "line", 2, "Own")]


def test_token_store(spark, awkward):
    uri = token_store.store(spark, awkward)
    keys = spark.createDataFrame([(1,), (1,), (2,), (3,), (5,), (77,), (None,)], "doc_id long")
    rows = token_store.lookup(keys, uri).collect()
    assert len(rows) == 7 and {r[0] for r in rows if not r.found} == {77, None}
    assert [r.n_tokens for r in rows if r[0] in (2, 3)] == [0, 0]
    two = docs(spark, [(1, "a few words"), (1, "some other words"), (1, "a few words"), (1, None), (2, "a few words")])
    one = docs(spark, [(2, "a few words"), (1, "some other words"), (1, "a few words")])
    kept = [{r[0]: bytes(r.payload) for r in token_store.lookup(keys, token_store.store(spark, d.repartition(n))).collect() if r.found} for d, n in ((two, 1), (two, 3), (one, 2), (two, 5), (one, 1))]
    assert kept[0].keys() == {1, 2} and kept[0][1] != b"" and all(k == kept[0] for k in kept)
    empty = token_store.store(spark, docs(spark, []))
    assert not any(r.found for r in token_store.lookup(keys, empty).collect())
    assert token_store.lookup(keys.limit(0), uri).count() == 0


PAGES = "page_id long, url string, html string, text string, path string"


def test_pages(spark, tmp_path):
    rows = [(1, "http://a", "<article><p>Words, and more words.</p></article>"), (1, "http://a", "<article><p>Words, and more words.</p></article>"), (2, None, None), (None, "http://b\nx", ""), (3, "u", "<div>" * 3000 + "deep" + "\x1f\x8b\x08" * 9)]
    pages = spark.createDataFrame([(*r, "t", "p") for r in rows], PAGES)
    files = warc.write(pages, f"file://{tmp_path}/w")
    back = warc.pages(warc.read(files, split=100)).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, u and u.replace("\n", "%0A"), h)) for i, u, h in rows)
    none = spark.createDataFrame([], PAGES)
    assert warc.read(warc.write(none, f"file://{tmp_path}/n")).count() == 0
    model = html_extract.train(pages)
    texts = html_extract.extract(pages, model).collect()
    assert len(texts) == 5 and [r.text for r in texts if r.page_id == 2] == [None] and [r.n_runs for r in texts if r.page_id is None] == [0]
    assert html_extract.extract(none, html_extract.train(none)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [None, 1.0]), (None, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, part int")
    found = {(r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in bit_sliced.search(vectors, k=2).collect()}
    assert found == {(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 2.0), (3, 1, 1, 1.0), (3, 2, 2, 2.0)}
    none = vectors.where(F.lit(False))
    assert bit_sliced.search(none).count() == 0 and bit_sliced.search(vectors, none).count() == 0 and bit_sliced.search(none, vectors).count() == 0
    assert {(r.vec_id, r["rank"], r.neighbour_id) for r in bit_sliced.search(vectors, vectors.where("vec_id = 2"), k=1).collect()} == {(2, 1, 1)}


def test_pipeline_on_awkward_tables(spark, awkward, labels, benchmark, tmp_path):
    """Nulls, repeated rows, long and empty texts and clashing columns through all stages; then empty tables."""
    import corpus_pipeline

    for name, tables in (("some", (awkward, labels, benchmark)), ("none", (docs(spark, []), labels.limit(0), benchmark.limit(0)))):
        for table, df in zip(("documents", "labels", "benchmark"), tables):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    before = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, f"{tmp_path}/some")
        assert after.columns == awkward.columns and after.exceptAll(before).count() == 0  # only whole rows, as they were
        before = spark.createDataFrame(after.collect(), awkward.schema)
    rows = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert rows.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and sorted(str(r.doc_id) for r in rows.collect()) == sorted(str(r.doc_id) for r in before.collect())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
