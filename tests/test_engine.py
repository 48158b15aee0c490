"""Small corpora with known answers."""

import json
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.distance import edit_distance
from lodestone.functions.embedding import embed, hashes, py_embed, py_fnv1a
from lodestone.functions.stemmers import porter, russian
from lodestone.functions.text import LOWERCASE, STRIP, Analyzer, default_analyzer, english_analyzer, stemmer, stop_words
from lodestone.functions.varbyte import decode_gaps, encode_gaps, encode_lists
from lodestone.operators import evaluation, highlight
from lodestone.operators.fielded import FieldedEngine
from lodestone.operators.index import Index, postings
from lodestone.operators.ranking import TfIdf
from lodestone.operators.search import Engine
from lodestone.operators.semantic import Predictor, SemanticEngine, mean_pool, predicted_search, vector_search
from lodestone.plans.query import ParseError
from lodestone.sources import files
from lodestone.sources.segments import SegmentedStore
from lodestone.sources.server import answer
from lodestone.streaming.ingest import ingest


def table(spark, rows, schema="doc_id string, text string"):
    return spark.createDataFrame(rows, schema)


def ids(df):
    return [r.doc_id for r in df.collect()]


@pytest.fixture(scope="module")
def two(spark):
    return Engine.build(table(spark, [("d1", "go go rust"), ("d2", "python rust")]))


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        ("a", "go has memory safety and is fast", 2012, "go"), ("b", "rust has memory safety without a collector", 2015, "rust"),
        ("c", "go is fast and slow", 2009, "go"), ("d", "python is simple", 2020, "python"),
    ]
    return Engine.build(table(spark, rows, "doc_id string, text string, year int, tag string"))


def test_scores_by_hand(spark, two):
    score = lambda q, e=two: {r.doc_id: round(r.score, 6) for r in e.search(q).collect()}
    assert score("go") == {"d1": 0.902322}
    assert score("go go") == {"d1": 1.804644}
    assert score("rust") == {"d1": 0.168533, "d2": 0.198568}
    assert score("go", Engine(two.index, TfIdf())) == {"d1": 1.1736}


@pytest.mark.parametrize("query", ["", "   ", "!!!", "absent"])
def test_no_hits(two, query):
    assert ids(two.search(query)) == []


BOOLEAN = [
    ("go AND safety", "a"), ("go safety", "a"), ("rust OR python", "bd"), ("simple AND NOT go", "d"), ('"memory safety"', "ab"), ("year>2012", "bd"),
    ("year>=2015", "bd"), ("tag=go", "ac"), ("simple AND tag!=python", ""), ("safety AND year<2015", "a"), ("", ""), ("go AND fast OR python", "acd"),
    ("(rust OR go) AND fast", "ac"), ("missing=1", ""), ("hello!", ""),
]


@pytest.mark.parametrize("query, want", BOOLEAN)
def test_boolean(four, query, want):
    assert sorted(ids(four.search_bool(query))) == list(want)


@pytest.mark.parametrize("query", ["(go OR rust", "go AND", "NOT", "go OR", "year>"])
def test_boolean_errors(four, query):
    with pytest.raises(ParseError):
        four.search_bool(query).collect()


def test_phrases(spark):
    engine = Engine.build(table(spark, [("a", "the quick brown fox"), ("b", "brown quick fox"), ("c", "a quick brown dog fox"), ("n", None)]))
    assert sorted(ids(engine.search('"quick brown"'))) == ["a", "c"]
    assert sorted(ids(engine.search('"quick brown" "brown fox"'))) == ["a"]
    assert ids(engine.search('"brown the"')) == []


def test_ties_go_by_id_and_limits(spark):
    engine = Engine.build(table(spark, [("beta", "x y"), ("alpha", "x y"), ("gamma", "x z")]))
    assert ids(engine.search("y")) == ["alpha", "beta"]
    assert ids(engine.search("x", 1)) == ["alpha"]
    assert ids(engine.search_parallel("x", 8)) == ids(engine.search("x"))


def test_delete_upsert_stats(spark, two):
    with pytest.raises(KeyError):
        two.delete("zzz")
    one = two.delete("d1")
    assert one.index.stats().first().n_docs == 1 and ids(one.search("go")) == []
    again = two.add(table(spark, [("d1", "java")]))
    assert ids(again.search("go")) == [] and ids(again.search("java")) == ["d1"] and again.index.stats().first().n_docs == 2
    empty = Engine.build(table(spark, []))
    assert tuple(empty.index.stats().first()) == (0, 0, 0.0) and ids(empty.search("go")) == []


def test_wildcards_and_suggestions(spark):
    engine = Engine.build(table(spark, [("a", "program programming cat"), ("b", "programs cut"), ("c", "memory safety cot")]))
    assert sorted(ids(engine.search_wildcard("program*"))) == ["a", "b"]
    assert sorted(ids(engine.search_wildcard("c?t"))) == ["a", "b", "c"]
    assert ids(engine.search_wildcard("")) == []
    assert engine.did_you_mean("memmory safty") == ("memory safety", True)
    assert engine.did_you_mean("memory")[1] is False


def test_fielded(spark):
    docs = table(spark, [("a", "go tour", "other words"), ("b", "other", "go go tour")], "doc_id string, title string, body string")
    engine = FieldedEngine.build(docs, {"title": 5.0, "body": 1.0})
    assert ids(engine.search("go tour"))[0] == "a" and ids(engine.search("")) == []
    with pytest.raises(ValueError):
        FieldedEngine.build(docs, {})


def test_facet_and_server(four):
    assert {tuple(r) for r in four.facet("go", "tag").collect()} == {("go", 2)}
    code, found = answer(four, None, "/search?q=rust")
    assert code == 200 and found["query"] == "rust" and [(h["id"], h["text"][:4]) for h in found["hits"]] == [("b", "rust")]
    assert json.loads(json.dumps(found)) == found and answer(four, None, "/nowhere")[0] == 404
    assert answer(four, None, "/searchbool?q=go+AND")[0] == 400 and [h["id"] for h in answer(four, None, "/searchbool?q=tag%3Dgo")[1]["hits"]] == ["a", "c"]
    assert answer(four, None, "/wildcard?q=sa*")[1]["terms"] == ["safety"] and answer(four, None, "/facet?q=go&field=tag")[1] == {"query": "go", "field": "tag", "counts": {"go": 2}}
    assert answer(four, None, "/stats")[1]["documents"] == 4 and answer(four, None, "/snippet?id=zz&q=go")[0] == 404 and "**go**" in answer(four, None, "/snippet?id=a&q=go")[1]["snippet"]
    assert answer(four, None, "/suggest?q=memmory")[1] == {"query": "memmory", "suggestion": "memory", "changed": True} and answer(four, None, "/semantic?q=x")[0] == 404
    assert [h["id"] for h in answer(four, SemanticEngine.build(four.index.docs), "/semantic?q=python+is+simple&limit=1")[1]["hits"]] == ["d"]


def test_analysis():
    analyze = default_analyzer()
    assert analyze("The Quick (hello ... don't 'Fox'!") == ["the", "quick", "hello", "don't", "fox"]
    assert analyze(" \t\n") == []
    pairs = {"ponies": "poni", "filing": "file", "relational": "relat", "controll": "control", "go2": "go2", "naïve": "naïve", "is": "is"}
    assert {w: porter(w) for w in pairs} == pairs
    assert russian("памятью") == russian("памяти") and russian("ёлка") == russian("елка") and russian("latin") == "latin"


#: Published examples of the stemmer's steps, each word with what all steps make of it.
PORTER = """caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan
falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|digitizer digit|vietnamization vietnam|predication predic|operator oper
feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|triplicate triplic|formative form|formalize formal|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow
inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun|activate activ
effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll"""


def test_published_stems():
    pairs = dict(p.split() for p in PORTER.replace("\n", "|").split("|"))
    assert {w: porter(w) for w in pairs} == pairs
    groups = "книга книги книгу книгой|читать читал читала|красивый красивая красивое красивые|важнейший важнее|области область областью"
    assert all(len({russian(w) for w in g.split()}) == 1 for g in groups.split("|")[:1] + groups.split("|")[2:3] + groups.split("|")[4:])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBс.,-!$ \n\u00a0\u0085\u2003éΣ'’_1"), max_size=14), min_size=1, max_size=30))
def test_text_is_cut_alike_in_columns_and_in_python(spark, texts):
    analyzer = default_analyzer()
    rows = table(spark, [(str(i), t) for i, t in enumerate(texts)]).select("doc_id", analyzer.column(F.col("text")).alias("tokens")).collect()
    assert {r.doc_id: r.tokens for r in rows} == {str(i): analyzer(t) for i, t in enumerate(texts)}


def test_postings_by_hand(spark):
    analyzer = Analyzer((LOWERCASE, STRIP, stemmer(lambda w: w.rstrip("s")), stop_words(["b"])))  # a filter after a stemmer, and one that drops words
    rows = postings(table(spark, [("x", "Cats, cat bs dog cats"), ("y", ""), ("z", None), ("w", "b")]), analyzer).collect()
    assert {(r.doc_id, r.term, r.length, r.tf, tuple(r.positions)) for r in rows} == {("x", "cat", 4, 3, (0, 1, 3)), ("x", "dog", 4, 1, (2,))}
    assert [r.doc_id for r in Engine.build(table(spark, [("x", "Cats, cat bs dog cats"), ("y", "dogs")]), analyzer).search("dogs b").collect()] == ["y", "x"]


def test_of_an_ids_rows_the_last_counts(spark):
    rows = [("a", "old words", 1), ("a", "new text", 2), ("b", "words", 1), ("a", "older", 0)]
    docs = table(spark, rows, "doc_id string, text string, at int").repartition(3)
    for engine in (Engine(Index.build(docs, order="at")), Engine.build(table(spark, [("a", "x", 5)], "doc_id string, text string, at int")).add(docs, "at")):
        assert ids(engine.search("words")) == ["b"] and ids(engine.search("new")) == ["a"] and engine.index.stats().first().n_docs == 2
    twice = Engine.build(table(spark, [("a", "one two"), ("a", "one three"), ("a", "one three")]))  # without an order the greatest row
    assert twice.index.stats().first().n_docs == 1 and ids(twice.search("two")) == ["a"] and ids(twice.search("three")) == []


def test_metadata_in_a_map(spark):
    docs = files.front_matter(table(spark, [("a", "---\nyear: 2012\ntag: go\n---\ngo fast"), ("b", "---\nyear: 2009\n---\ngo slow"), ("c", "go")]))
    engine = Engine.build(docs)
    assert ids(engine.search_bool("go AND year>2010")) == ["a"] and ids(engine.search_bool("tag=go OR year=2009")) == ["a", "b"] and ids(engine.search_bool("tag!=go")) == []
    assert {tuple(r) for r in engine.facet("go", "year").collect()} == {("2012", 1), ("2009", 1)} and engine.facet("go", "none").count() == 0


def test_sample_corpus(spark):
    engine = Engine.build(files.sample_corpus(spark))
    assert set(ids(engine.search_bool("harbour OR herring"))) == {"harbour", "herring", "lighthouse"} and ids(engine.search_bool("year>2010 AND topic=food")) == ["bread", "хлеб"]


def test_semantic_engine(spark):
    docs = table(spark, [("a", "red apples and pears"), ("b", "fast cars"), ("c", "red cars")])
    engine = SemanticEngine.build(docs)
    assert ids(engine.ranked_ids("fast cars", 1)) == ["b"] and engine.count().first().n == 3
    changed = engine.delete("b").add(table(spark, [("a", "very fast cars"), ("d", "pears")]))
    assert ids(changed.search("fast cars", 1)) == ["a"] and changed.count().first().n == 3
    assert np.allclose(mean_pool(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3]), np.array([[1, 1, 0], [0, 0, 0]])), [[0.6, 0.8], [0.0, 0.0]])


def test_predictor_with_stems_and_thesaurus(spark):
    docs = table(spark, [("1", "memory leaks and leaking memory"), ("2", "memory safety leak"), ("3", "fast memory")])
    predictor = Predictor.build(docs, english_analyzer(), {"trouble": ["leaks", "absent"]})
    assert [tuple(r) for r in predictor.predict("trouble", 3).collect()] == [("leak", 2.0)]
    scores = {r.word: r.score for r in predictor.predict("memories", 10).collect()}
    assert scores == {"memory": 1.0, "leak": 2 / 3, "safety": 0.5, "fast": 0.5} and predictor.predict("nothing here").count() == 0
    grown = predictor.add(table(spark, [("4", "memory safety")]))
    assert {r.word: r.score for r in grown.predict("memory", 10).collect()}["safety"] == 2 / 3
    assert [r.doc_id for r in predicted_search(Engine.build(docs, english_analyzer()), predictor, "trouble", 5).collect()] == ["1", "2"]


@pytest.mark.parametrize("a, b, far", [("og", "go", 1), ("srach", "search", 2), ("поикс", "поиск", 1), ("", "ab", 2), ("same", "same", 0)])
def test_edit_distance(a, b, far):
    assert edit_distance(a, b) == far


@pytest.mark.parametrize("positions", [[], [0], [127, 128], [16383, 16384, 2097152], list(range(1000))])
def test_gap_code(positions):
    assert decode_gaps(encode_gaps(positions)) == positions and len(encode_gaps(positions)) < 8 * max(1, len(positions)) + 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.integers(0, 2**28), max_size=6, unique=True).map(sorted)), max_size=8))
def test_gap_code_of_a_batch(lists):
    batch = pa.array([None, *lists, None], pa.list_(pa.int32()))
    for part in (batch, batch.slice(1), batch.slice(0, 1), batch.slice(2, 0)):
        assert encode_lists(part).to_pylist() == [None if x is None else encode_gaps(x) for x in part.to_pylist()]


def test_highlights():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    assert "**eight**" in highlight.snippet(text, ["eight"], default_analyzer())
    assert highlight.snippet(text, ["absent"], default_analyzer()).startswith("one two")
    spans = highlight.spans(text, ["eight"], default_analyzer())
    assert [t.strip() for t, match in spans if match] == ["eight"]


def test_metrics(spark):
    runs = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate("abcd")], "query_id string, rank int, doc_id string")
    judged = spark.createDataFrame([("q", "a", True), ("q", "c", True), ("r", "a", True)], "query_id string, doc_id string, relevant boolean")
    assert abs(evaluation.mean_average_precision(runs, judged.where("query_id = 'q'")).first()[0] - 0.8333333) < 1e-6
    assert abs(evaluation.mean_average_precision(runs, judged).first()[0] - 0.8333333 / 2) < 1e-6


def test_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8]), ("w", [1.0, 0.0, 0.0]), ("n", None)], "doc_id string, vector array<float>")
    assert ids(vector_search(vectors, [1.0, 0.0])) == ["a", "c", "b"] and ids(vector_search(vectors, [1.0, 0.0], 1)) == ["a"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\ntext")
    (tmp_path / "b.HTML").write_text("<p>one &amp; two</p><script>no()</script><style>x</style>")
    (tmp_path / "c.rtf").write_text(r"{\rtf1\ansi Hello {\b world}}")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>first</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t></w:r></w:p>")
    found = {r.doc_id: r.text for r in files.load(spark, str(tmp_path)).collect()}
    assert found["a"] == "# Title\ntext" and found["b"] == "one & two" and "Hello" in found["c"] and "world" in found["c"]
    assert found["d"].split() == ["first", "second"]
    (tmp_path / "e.docx").write_bytes(b"PK not a zip")
    (tmp_path / "f.exe").write_text("text")
    loaded = {r.doc_id: r for r in files.load(spark, str(tmp_path)).collect()}
    assert loaded["e"].text is None and loaded["e"].error == "not a readable docx file" and loaded["a"].error is None and loaded["f"].text == "text"
    assert {r.doc_id for r in files.load(spark, str(tmp_path), every=False).collect()} == set("abcde")


def test_segments(spark, tmp_path):
    store = SegmentedStore(spark, str(tmp_path))
    store.add(table(spark, [("1", "go fast"), ("2", "rust")]))
    store.flush()
    store.add(table(spark, [("1", "java")]))
    store.flush()
    again = SegmentedStore(spark, str(tmp_path))
    engine = Engine(again.index())
    assert ids(engine.search("go")) == [] and ids(engine.search("java")) == ["1"] and engine.index.stats().first().n_docs == 2
    again.remove("2")
    again.flush()
    assert ids(Engine(SegmentedStore(spark, str(tmp_path)).index()).search("rust")) == []


def test_many_segments_are_one_scan_and_compact(spark, tmp_path):
    store, plain = SegmentedStore(spark, str(tmp_path), compact_after=3), {}
    for i in range(6):
        rows = [(str(k), f"word{k} round{i}", i) for k in range(i, i + 3)]
        plain |= {k: t for k, t, _ in rows}
        store.add(table(spark, rows, "doc_id string, text string" + (", extra int" if i % 2 else "") if i % 2 else "doc_id string, text string, other int"))
        store.flush()
    store.remove("4")
    store.flush()
    plain.pop("4")
    assert store.segment_count() <= 3
    index = SegmentedStore(spark, str(tmp_path)).index()
    assert {r.doc_id: r.text for r in index.docs.collect()} == plain and {r.term: r.df for r in index.term_stats().collect()} == dict(Counter(w for t in plain.values() for w in t.split()))
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2
    assert store.vacuum() and {r.doc_id for r in SegmentedStore(spark, str(tmp_path)).index().docs.collect()} == set(plain)


def test_stream(spark, tmp_path):
    table(spark, [("1", "go"), ("2", "rust go")]).write.parquet(str(tmp_path / "in"))
    store = SegmentedStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert sorted(ids(Engine(SegmentedStore(spark, str(tmp_path / "store")).index()).search("go"))) == ["1", "2"]


def test_plan_reads_only_what_it_needs(spark, sf_dir):
    from lodestone import queries

    plan = queries.engine(spark, sf_dir).index.posting("the").select("doc_id", "tf")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the)" in plan and "positions" not in plan.split("ReadSchema")[1]


def test_html_references_as_in_the_sql(spark, oracle, tmp_path):
    """A title is cut in the middle of a reference; the loader takes it for whole, as browsers do."""
    pages = ["<h1>a&amp;&amp</h1> &copy;&middot; &quot;x&quot", "&lt;b&gt; &#x27;&amp;lt; &a &am;", None, "&amp", ""]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    import duckdb

    from lodestone import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(queries.ORACLE_SQL["html_extract"]).fetchall())
    assert {r.page_id: r.text for r in queries.html_extract(spark, str(tmp_path)).collect()} == want and want[0] == " a&&amp ©· \"x&quot"
    assert files.py_unescape_closed("&notit; &nbsp;&#65;&#x41 &amp;amp;") == "&notit;  A&#x41 &amp;"
    assert rows.where("page_id = 3").select(files.html_text(F.col("html"))).first()[0] == "&"


def test_texts_without_words_have_no_cells_and_texts_of_an_id_count_as_one(spark, tmp_path):
    """A text of no words once got a cell for the hash of nothing."""
    texts = ["", "  ", None, "... !", "one", "One two, two"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, f"word{k} und w{k % 3}") for k in range(1200)] + [(4, "two"), (10, "x" * 300 + " é ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    from lodestone import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(i, c): v for i, c, v in con.execute(queries.ORACLE_SQL["hash_embedding"]).fetchall()}
    got = queries.hash_embedding(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.cell): r.value for r in got} == want and len(got) == len(want) and {i for i, _ in want} == {"4", "5", "9", "10"}
    vectors = {r.doc_id: r.vector for r in embed(docs).collect()}
    assert len(vectors) == 8 and all(len(v) == 256 for v in vectors.values()) and not any(vectors[0]) and not any(vectors[2])
    assert np.allclose(vectors[10], py_embed(rows[-1][1])) and np.allclose(vectors[4], py_embed("one two"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=100), max_size=20))
def test_hashes_of_a_batch(words):
    batch = pa.array(["", *words, "w" * 64, "w" * 65])
    assert hashes(batch).tolist() == [py_fnv1a(w) for w in batch.to_pylist()] and hashes(batch[1:]).tolist() == hashes(batch).tolist()[1:]
