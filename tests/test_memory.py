"""What Python workers hold, and what Spark asks of them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import memory, text
from lodestone.functions.memory import Remembered, runs
from lodestone.functions.text import default_analyzer, english_analyzer
from lodestone.operators.index import Index, entries
from lodestone.operators.search import Engine


class Caught:
    """A table that hands back the function that mapInArrow() is given."""

    def __init__(self, schema):
        self.schema, self.sparkSession = schema, self
        self.conf = {memory.BATCH[0]: "1"}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("analyzer", [default_analyzer(), english_analyzer()])
def test_cutting_a_large_batch_takes_little_beside_it(spark, analyzer):
    schema = spark.createDataFrame([], "doc_id string, tokens array<string>").schema
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(2_000)], "tokens": [[f"word{(i * k) % 5_000}" for k in range(1_000)] for i in range(2_000)]})
    run, rows, pool, most = entries(Caught(schema), analyzer), 0, pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for part in run(iter([batch])):
        rows, most = rows + part.num_rows, max(most, pa.total_allocated_bytes() - pool)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 2_000_000 * 0.4 and peak < 60e6 and most < 60e6  # 2 million tokens; a column of 8 bytes is 16 MB


def test_runs_hold_every_row_once():
    for sizes in ([], [0], [5, 0, 300, 1, 1, 0], [400] * 3, [0] * 9):
        found = list(runs(np.array(sizes, int), 10, 4))
        assert [k for a, b in found for k in range(a, b)] == list(range(len(sizes))) and all(b - a == 1 or (sum(sizes[a:b]) <= 10 and b - a <= 4) for a, b in found)


def test_words_in_use_are_remembered():
    asked = []
    known = Remembered(lambda w: asked.append(w) or w.upper(), 10)
    for i in range(100):
        assert known["often"] == "OFTEN" and known[f"w{i}"] == f"W{i}"
    assert asked.count("often") == 1 and len(asked) == 101 and len(known) + len(known.older) <= 20


def test_texts_are_looked_at_once_and_after_the_sort(spark):
    rows = [(str(i), f"some thing {'and more ' * (i % 7)}ending here") for i in range(300)] + [("n", None), ("o", "other words")]
    index = Index.build(spark.createDataFrame(rows, "doc_id string, text string"), unique=True)
    for shown, name in ((Engine(index).snippets("thing"), "snippet"), (Engine(index).highlights("thing"), "spans")):
        plan = shown.select("doc_id", F.explode(F.array(name)).alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.index("MapInArrow") < plan.index("Sort [score")
        got = shown.collect()
        assert [r.doc_id for r in got] == [r.doc_id for r in Engine(index).search("thing").collect()] and len(got) == 300 and all("thing" in str(r[name]) for r in got)


def test_batches_are_small_where_the_session_does_not_say(spark):
    spark.conf.unset(memory.BATCH[0])
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    Index.build(docs, unique=True)
    assert spark.conf.get(memory.BATCH[0]) == "4m"
    spark.conf.set(memory.BATCH[0], "8m")
    Index.build(docs, unique=True)
    assert spark.conf.get(memory.BATCH[0]) == "8m"
    spark.conf.unset(memory.BATCH[0])


def test_an_ids_rows_are_compared_once_when_an_index_is_saved(spark, tmp_path):
    """Entries come from the documents as written; of an id's rows the last was once looked for again."""
    from lodestone.operators import index

    docs = spark.createDataFrame([("a", "old words", 1), ("a", "new text", 2), ("b", "words", 1)], "doc_id string, text string, at int")
    seen = spark.sparkContext.accumulator(0)
    counted = docs.withColumn("text", F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()("text"))
    index.Index.build(counted, order="at").save(str(tmp_path))
    assert seen.value == 3 and {(r.term, r.doc_id) for r in Index.load(spark, str(tmp_path)).postings.collect()} == {("new", "a"), ("text", "a"), ("words", "b")}


def test_python_cuts_at_the_same_characters_either_way():
    assert all(text.py_tokenize(f"a{chr(c)}b") == [t for t in text._PY_SPACE.split(f"a{chr(c)}b") if t] for c in range(0x110000))
