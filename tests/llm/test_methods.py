"""Each operator against SQL, brute force, an exact round trip or held-out rows."""

import gzip
import os
import re
import time
import tracemalloc
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.window import Window

import corpus_pipeline
from lodestone.llm import bit_sliced, bpe, decontaminate, html_extract, licenses, near_duplicates, quality, token_store, toxicity, warc
from lodestone.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    oracle(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


def grams(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} - {()}


def similar(texts, threshold=near_duplicates.THRESHOLD):
    sets = {i: grams(t) for i, t in texts.items() if t}
    keys = sorted(i for i in sets if sets[i])
    pairs = {}
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold - 1e-9:
                pairs[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    return pairs


def links(texts, threshold=near_duplicates.THRESHOLD):
    """Rows of join(): pairs between the least ids of different texts, and each further id of a text with the least."""
    least = {}
    for i in sorted(texts):
        least.setdefault(frozenset(grams(texts[i] or "")), i)
    least.pop(frozenset(), None)
    same = {(least[g], i): 1.0 for i in texts if (g := frozenset(grams(texts[i] or ""))) and least[g] != i}
    return similar({i: texts[i] for i in least.values()}, threshold) | same


def classes(texts):
    """Rows of classes(): the least id of each connected group, and the number of documents that each is similar to."""
    root, pairs = {i: i for i in texts}, similar(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(i, find(i), sum(i in p for p in pairs)) for i in texts}


def group_texts(seed):
    rng, texts = np.random.default_rng(seed), {}
    for group in range(12):  # copies with words changed, and a passage that all groups share
        base = [f"w{x}" for x in rng.zipf(1.3, rng.integers(5, 120)) % 400]
        for copy in range(8):
            own = [w if rng.random() > 0.03 * copy else f"n{rng.integers(1000)}" for w in base]
            texts[group * 8 + copy] = " ".join(own + ("a passage that stands in a great many texts".split() if copy % 2 else []))
        texts[100 + group] = texts[group * 8]
    return texts


@pytest.mark.parametrize("seed, threshold, orders", [(1, 0.5, 3), (2, 0.8, 2), (3, 0.3, 4)])
def test_near_duplicates_against_all_pairs(spark, seed, threshold, orders):
    texts = group_texts(seed)
    found = near_duplicates.join(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), threshold, orders=orders)
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in found.collect()}
    want = links(texts, threshold)
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_near_duplicate_classes(spark):
    texts = group_texts(6)
    rows = near_duplicates.classes(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts) and {tuple(r) for r in rows} == classes(texts)


def test_near_duplicates_of_hot_grams_and_hubs(spark, monkeypatch):
    """Chunks of a frequent gram's sets and cells of a group's pairs give what one place would, and so do many buckets."""
    texts = group_texts(8)
    for i in range(60):  # a template: the same words but for a few
        texts[1000 + i] = " ".join([f"own{i}x{k}" for k in range(i % 7)] + [f"shared{k}" for k in range(30)])
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_duplicates, "CHUNK", 7)
    monkeypatch.setattr(near_duplicates, "CELL_GRAMS", 300)
    monkeypatch.setattr(near_duplicates, "BUCKET_BYTES", 500)
    got, want = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in near_duplicates.join(docs).collect()}, links(texts)
    assert got.keys() == want.keys() and len(want) > 1000 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def template_texts(n):
    """Different texts from one template, all but a few similar to most others, beside others."""
    rng, texts = np.random.default_rng(n), {i: t for i, t in group_texts(9).items()}
    for i in range(n):
        texts[1000 + i] = " ".join(w if rng.random() > 0.06 else f"n{rng.integers(10**6)}" for w in [f"form{k}" for k in range(40)])
    return texts


@pytest.mark.parametrize("chunk", [1024, 20])
def test_near_duplicates_of_a_large_template(spark, monkeypatch, chunk):
    """No step writes a row for each two texts of a template, and whatever its homes, each link counts once."""
    texts, written, real = template_texts(250), {}, near_duplicates.materialise

    def materialise(df, label):
        out = real(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    monkeypatch.setattr(near_duplicates, "materialise", materialise)
    rows = near_duplicates.classes(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    want = classes(texts)
    assert {tuple(r) for r in rows} == want and sum(n for _, _, n in want) > 30_000
    assert chunk < 1024 or all(n <= len(texts) for n in written.values()), written


def test_near_duplicates_hold_little_of_a_bucket_or_cell_at_once(spark, monkeypatch):
    """Beside what comes in, counting a bucket and verifying a cell take a few bytes a gram: two tasks of an executor share what its heap leaves."""
    got = {}
    monkeypatch.setattr(near_duplicates, "roomy", lambda f: got.setdefault(f.__name__, f))
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: got.setdefault("cell", f) and self._gd1._df)
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 600)) for _ in range(1200)]
    copies = [f"{t} {k} {k + 1}" for k, t in enumerate(base)]
    docs = spark.createDataFrame(list(enumerate(base + copies)), "doc_id long, text string")
    sigs = near_duplicates.signatures(docs, 1)
    bucket = near_duplicates._blocks(docs, 1, near_duplicates.GRAM).toArrow()

    def peak(f, *args):
        tracemalloc.start()
        try:
            return f(*args), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    n = 2 * 1200 * 598
    replies, took = peak(got["count"], bucket)
    assert replies.num_rows == bucket.num_rows and took < 50 * n
    tokens = [near_duplicates.gram_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in base + copies]
    sets = np.arange(2400)
    cell = pa.table({"set_id": sets, "home": np.zeros(2400, np.int64), "doc_id": sets, "m": np.ones(2400, np.int64), "n": np.array([len(x) for x in tokens], np.int32), "tokens": pa.array([x.tobytes() for x in tokens], pa.binary()), "classes": pa.array([bytes([8]) * len(x) for x in tokens], pa.binary())})
    near_duplicates.verified(sigs, spark.createDataFrame([(0, 0, 0, 0)], "hub long, part long, a long, b long"))
    found, took = peak(got["cell"], (0, 0), pa.table({"a": [0], "b": [0]}), cell)
    assert found.num_rows == 2400 and set(found["linked"].to_pylist()) == {1} and took < 50 * n


def test_candidates_hold_each_similar_pair(spark):
    """Pairs of homes are few beside the pairs of texts, and each similar pair lies in one of them."""
    texts = template_texts(300)
    sigs = near_duplicates.signatures(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), 8)
    home = {r.doc_id: r.home for r in sigs.select("doc_id", "home").collect()}
    pairs = {(r.a, r.b) for r in near_duplicates.candidates(sigs, 8).collect()}
    want = {tuple(sorted((home[a], home[b]))) for a, b in similar(texts) if texts[a] != texts[b]}
    assert want <= pairs and len(pairs) < 1000 and len(similar(texts)) > 20_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True))
def test_packed_numbers_come_back(numbers):
    ordered = np.sort(np.array(numbers, np.uint64))
    assert near_duplicates.unpack(near_duplicates.pack(ordered)).tolist() == ordered.tolist()


@pytest.mark.parametrize("again", ["same", "reversed"])
def test_near_duplicates_of_a_repeated_block(spark, again):
    rng, texts = np.random.default_rng(4), {}
    for group in range(6):
        base = [f"w{group}x{k}" for k in range(60)]
        for copy in range(4):  # similarities between about 0.2 and 1
            texts[group * 4 + copy] = " ".join(w if rng.random() > 0.08 * copy else f"n{rng.integers(10**6)}" for w in base)
    rows = sorted(texts.items())
    one, two = (spark.createDataFrame(spark.sparkContext.parallelize(r, 1), "doc_id long, text string") for r in (rows, rows if again == "same" else rows[::-1]))  # a block each
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in near_duplicates.join(one.union(two)).collect()}
    want = links(texts)
    assert got.keys() == want.keys() and len(want) > 3 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {tuple(r) for r in near_duplicates.classes(one.union(two)).collect()} == classes(texts)
    stay = one_of_each(texts)
    assert sorted(r.doc_id for r in near_duplicates.keep_one(one.union(two)).collect()) == sorted([*stay, *stay])


def one_of_each(texts):
    """Ids that stay when the least of each connected group does."""
    return {i for i, c, _ in classes(texts) if i == c}


STATEMENTS = ["Copyright (c) 2020 Foo", "Copyright The Kubernetes Authors.", "copyright Foo Corp., 2020", "Copyright by Foo 2020", "Copyright: 2020 Foo", "Portions Copyright (c) 2020 Foo", "<!-- Copyright (c) 2020 Foo -->", "# (C) 2019 Foo", "© Foo", "// Copyright© Foo", "All rights reserved."]
TEXT_LINES = ["Copyright notice and this permission notice shall be kept", "copyright holder or contributors be liable", "Copyright License to reproduce", "copyrighted by Foo", "the copyright of 2020", "copyright and related rights"]


def canonical(text):
    """The canonical form word by word, by its description; not by patterns."""
    about = set("notice notices holder holders owner owners law laws licence license licences licenses act acts protection protections infringement infringements interest interests claim claims status disclaimer disclaimers information management treaty treaties right rights term terms in and or is are was has may shall will must of as to for on under with that which".split())
    out = []
    for line in text.lower().replace("\r", "\n").split("\n"):
        bare = line.strip(" \t").lstrip("*#/;%<!|-").strip(" \t")
        if bare.startswith(("portions ", "portions\t")):
            bare = bare[8:].strip(" \t")
        after = bare[9:] if bare.startswith("copyright") else ""
        if bare.startswith(("(c) ", "(c)\t", "©", "all rights reserved")):
            continue
        if bare.startswith("copyright") and (after[:1] in (" ", "\t", ":", ",", "©") or after.startswith("(c)") or (not after and line.rstrip("\n") != line.rstrip())):
            word = re.match("[a-z0-9_]*", after.strip(" \t"))[0] if after[:1] in (" ", "\t") else ""
            if word not in about:
                continue
        words = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "N" else " " for c in line).split()
        if words:
            out.append(" ".join(words))
    text = "\n".join(out)
    for old, new in licenses.EQUIVALENT:
        text = text.replace(old, new)
    return text


def test_canonical_form_by_its_description(spark, texts):
    extra = {-1 - i: t for i, t in enumerate(["\n".join([*STATEMENTS, *TEXT_LINES]), *STATEMENTS, *TEXT_LINES, "a\r\nb\r c", "LICENCE; organisation -- non-commercial"])}
    asked = {i: t for i, t in (texts | extra).items() if t}
    rows = spark.createDataFrame(sorted(asked.items()), "doc_id long, text string").select("doc_id", licenses.canonical_lines(F.col("text")).alias("c")).collect()
    assert {r.doc_id: r.c for r in rows} == {i: canonical(t) for i, t in asked.items()}


def test_copyright_lines_do_not_hide_a_licence(spark):
    body = "Permission is granted.\n" + "\n".join(TEXT_LINES)
    own = licenses.known(spark, {"Own": body})
    rows = [(i, f"{s}\n\n{body}\n{s}") for i, s in enumerate(STATEMENTS)] + [(100, body.replace("\ncopyrighted by Foo", ""))]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), own).where("unit = 'text'").collect()
    assert sorted(r.doc_id for r in found) == list(range(len(STATEMENTS)))


def test_public_licence_texts_are_known(spark):
    """The licences that Linux distributions and Python packages come with, with a copyright line of our own on top."""
    import pyspark

    known = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    files = {f"/usr/share/common-licenses/{f}": i for f, i in known.items()}
    files |= {f"{os.path.dirname(pyspark.__file__)}/licenses/LICENSE-{f}.txt": i for f, i in {"modernizr": "MIT", "bootstrap": "MIT", "AnchorJS": "MIT", "CC0": "CC0-1.0", "xz": "0BSD", "d3.min.js": "ISC"}.items()}
    there = {f: i for f, i in files.items() if os.path.exists(f)}
    if not there:
        pytest.skip("no licence texts on this machine")
    rows = [(i, "/* Portions Copyright Some Corp., 2021 */\n" + open(f, encoding="utf-8", errors="replace").read().upper()) for f, i in there.items()]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).where("unit = 'text'").collect()
    assert sorted((r.doc_id, r.license_id) for r in found) == sorted((i, i) for i, _ in rows)


def leaks(text, windows):
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    return any(" ".join(words[i : i + n]) in windows for n in (5, 6, 7, 8) for i in range(len(words) - n + 1))


def windows_of(items):
    out = set()
    for text in items:
        words = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
        n = min(len(words), 8)
        if n >= 5:
            out |= {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    return out


def encoding():
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})


def test_pipeline_stage_by_stage(spark, sf_dir, documents):
    """Each stage's rows against brute force on what the stage before it kept; run() gives the same."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    windows = windows_of([r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, sf_dir)
        assert after.columns == documents.columns
        own = {r.doc_id for r in after.collect()}
        if stage is corpus_pipeline.quality_stage:
            want = {r.doc_id for r in quality.classify(docs, quality.train(docs, labels)).collect() if r.keep}
        elif stage is corpus_pipeline.toxicity_stage:
            want = {r.doc_id for r in toxicity.classify(docs, toxicity.train(docs, labels)).collect() if not r.is_toxic}
        elif stage is corpus_pipeline.near_duplicates_stage:
            want = one_of_each(before)
        else:
            want = {i for i, t in before.items() if not leaks(t or "", windows)}
        assert own == want and own < set(before)
        kept.append(len(own))
        docs = documents.where(F.col("doc_id").isin(sorted(own)))
    last, whole = {r.doc_id: r.text for r in docs.collect()}, encoding()
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.token_ids for r in rows} == {i: whole.encode_ordinary(t) for i, t in last.items()} and len(rows) == kept[-1]


def test_decontaminate_offsets(documents, texts, spark, sf_dir):
    rows = decontaminate.find(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    items = {r.item_id: decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert rows
    for r in rows:
        passage = decontaminate.normalise(texts[r.doc_id][r.start_char : r.end_char])
        assert len(passage.split()) == r.n_words
        first = " ".join(passage.split()[:8])
        assert first in items[r.item_id]


def test_short_items_and_case(spark):
    docs = spark.createDataFrame([(1, "So: WHAT is  the-capital of France?"), (2, "what is the capital"), (3, "somewhat is the capital of france")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the capital of France"), (2, "is the capital")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find(docs, bench).collect()] == [(1, 1, 4, 34, 6)]


def test_long_texts_and_parts_of_a_benchmark(spark, monkeypatch):
    rng = np.random.default_rng(9)
    item = lambda: " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(3, 40)))
    bench = [(i, item()) for i in range(40)]
    texts = [(i, ". ".join(" ".join(bench[rng.integers(40)][1].split()[: rng.integers(4, 30)]) + " Z" for _ in range(30))) for i in range(25)]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.find(docs, items).collect()))
    windows = windows_of([t for _, t in bench])
    assert {r[0] for r in want} == {i for i, t in texts if leaks(t, windows)} and len(want) > 30
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    assert sorted(map(tuple, decontaminate.find(docs, items).collect())) == want
    kept = {r.doc_id for r in decontaminate.remove(docs, items).collect()}
    assert kept == {i for i, t in texts if not leaks(t, windows)}
    whole = decontaminate.Machine(bench)
    found = [whole.spans(t) for _, t in texts]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        assert [whole.spans(t) for _, t in texts] == found and [whole.finds(t) for _, t in texts] == [bool(f) for f in found]


def test_items_of_a_few_words_in_sql(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(1, "So: WHAT is  the-capital of France?"), (2, "one two three four five six seven eight nine"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the capital of France"), (2, "is the capital"), (3, "two three four five six"), (4, "one two three four five six seven eight nine ten")], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(con.execute(decontaminate.FIND_SQL).fetchall()) == sorted(map(tuple, decontaminate.find(docs, bench).collect()))


def merged(piece, ranks):
    """BPE by its definition: merge the pair of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_against_its_definition(text):
    own = bpe.load()
    assert own.encode(text) == encoding().encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()
    piece = text.encode()
    if piece:
        assert own.merge(piece) == ([own.ranks[piece]] if piece in own.ranks else merged(piece, own.ranks))


def test_bpe_on_all_documents(documents, texts):
    whole = encoding()
    rows = bpe.encode(documents).collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.token_ids == whole.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in rows)


def test_bpe_remembers_pieces_that_come_again(monkeypatch):
    """However many other pieces come between, a piece in use is merged once; what is remembered stays bounded."""
    calls, real = [], bpe.Bpe.merge
    monkeypatch.setattr(bpe.Bpe, "merge", lambda self, piece: calls.append(piece) or real(self, piece))
    monkeypatch.setattr(bpe, "CACHE", 100)
    own = bpe.Bpe(bpe.load().ranks)
    text = "".join(f" x{chr(97 + k % 26) * (1 + k // 26)} zzqqy" for k in range(1000))
    assert own.encode(text) == encoding().encode_ordinary(text)
    assert calls.count(b" zzqqy") == 1
    assert len(own.known) + len(own.known.older) <= 100


def test_store_returns_every_document(spark, sf_dir, texts):
    whole = encoding()
    rows = QUERIES["op3_token_store"](spark, sf_dir).collect()
    assert {r[0]: token_store.ids(r.payload, r.n_tokens) for r in rows} == {i: whole.encode_ordinary(t) for i, t in texts.items()} and all(r.found for r in rows)


def test_store_answers_a_key_that_is_asked_for_often(spark, monkeypatch):
    monkeypatch.setattr(token_store, "HELD_BYTES", 2_000)
    monkeypatch.setattr(token_store, "REPEATS", 7)
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 5)
    words = {i: " ".join(f"word {k}" for k in range(i % 90)) for i in range(40)}
    uri = token_store.store(spark, spark.createDataFrame(sorted(words.items()), "doc_id long, text string"))
    asked = [3] * 500 + list(range(60)) + [None] * 20
    rows = token_store.lookup(spark.createDataFrame([(k,) for k in asked], "doc_id long"), uri).collect()
    assert sorted(map(str, asked)) == sorted(str(r.doc_id) for r in rows)
    assert all(r.found == (r.doc_id in words) and (not r.found or token_store.ids(r.payload, r.n_tokens) == encoding().encode_ordinary(words[r.doc_id])) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 20_000])
def test_minimal_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    own = token_store.MinimalHash.from_bytes(token_store.MinimalHash.build(keys).to_bytes())
    assert sorted(own(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("split", [37, 1000, 8 << 20])
def test_warc_ranges_read_each_record_once(spark, sf_dir, tmp_path, split):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id < 12")
    files = warc.write(pages.coalesce(2), f"file://{tmp_path}/w")
    rows = warc.pages(warc.read(files, split=split)).collect()
    assert sorted(map(tuple, rows)) == sorted((r.page_id, r.url, r.html) for r in pages.collect())


def test_warc_passes_over_damage(spark, tmp_path):
    good = [warc.record("response", f"http://{i}", b"body %d" % i, "text/html", {}) for i in range(3)]
    data = good[0] + b"\x1f\x8b\x08 noise" + good[1] + good[1][: len(good[1]) // 2] + good[2]
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = warc.listing(spark, f"file://{tmp_path}")
    for split in (11, 1 << 20):
        assert sorted(r.url for r in warc.read(files, split=split).collect()) == ["http://0", "http://1", "http://2"]


def test_warc_responses_and_foreign_headers(spark, tmp_path):
    body = gzip.compress("<p>größe</p>".encode())
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:7], body[7:], b""))
    plain, packed = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>one</p>", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    kind = "application/http; msgtype=response"
    records = [warc.record("response", "http://a", plain, kind, {}), warc.record("response", "http://b", packed, kind, {}), warc.record("response", "http://c", b"no head", kind, {}), warc.record("request", "http://d", b"GET /", "application/http", {})]
    for length in ("\u00b2", "9" * 5000, "-1", ""):  # foreign headers end their member, not the job
        records.append(gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nbody\r\n\r\n".encode()))
    records.append(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Page-ID: none\r\nX: 1\r\nx: 2\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(records))
    found = warc.read(warc.listing(spark, f"file://{tmp_path}"), split=100, bodies=True)
    assert sorted((r.url or "", r.html) for r in warc.pages(found).collect()) == [("", "hi"), ("http://a", "<p>one</p>"), ("http://b", "<p>größe</p>"), ("http://c", "")]
    assert [r.headers["x"] for r in found.where("url is null").collect()] == ["1, 2"]


def test_warc_records_across_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, f"http://{i}", bytes(rng.integers(97, 123, int(n), dtype=np.uint8)).decode()) for i, n in enumerate(rng.integers(1, 40_000, 60))]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    assert files.first().bytes > 20 * 5_000
    assert sorted(map(tuple, warc.pages(warc.read(files, split=5_000)).collect())) == rows


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 9), st.integers(1, 12), st.integers(0, 1 << 30))
def test_bit_slices_find_the_nearest(n, width, k, seed):
    rng = np.random.default_rng(seed)
    rows = (rng.normal(size=(n, width)) * rng.choice([1e-3, 1, 50], width)).round(rng.integers(0, 4)).astype(np.float32)
    query = rows[rng.integers(n)] if rng.random() < 0.5 else rng.normal(size=width).astype(np.float32) * 3
    near, far = bit_sliced.Segment(rows).top(query, k)
    true = np.abs(rows.astype(float) - query.astype(float)).sum(1)
    assert np.allclose(true[near], far)
    assert set(np.flatnonzero(true <= np.sort(true)[min(k, n) - 1])) <= set(near.tolist())
    bound = float(true[rng.integers(n)])  # rows up to the bound, it included, are still there
    near, far = bit_sliced.Segment(rows).top(query, k, bound)
    assert np.allclose(true[near], far) and set(np.flatnonzero((true <= np.sort(true)[min(k, n) - 1]) & (true <= bound))) <= set(near.tolist())


def test_search_over_many_segments(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(700, 6)).round(1).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    for name, value in (("SEGMENT_ROWS", 50), ("QUERY_ROWS", 20), ("GROUP_SEGMENTS", 3)):
        monkeypatch.setattr(bit_sliced, name, value)
    found = defaultdict(list)
    for r in bit_sliced.search(vectors, vectors.where("vec_id % 20 = 0"), k=5).sort("vec_id", "rank").collect():
        found[r.vec_id].append(r.neighbour_id)
    for i in range(0, 700, 20):
        far = np.abs(rows.astype(float) - rows[i].astype(float)).sum(1)
        assert found[i] == [j for j in np.lexsort((np.arange(700), far)) if j != i][:5]
    assert len(found) == 35


def test_quality_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").collect()
    good, bad = ([r.keep for r in rows if r.quality == q] for q in (1, 0))
    print("kept of good", np.mean(good), "rejected of bad", 1 - np.mean(bad), "prior", model.prior)
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def plain_features(text):
    """The features of one text, byte by byte."""
    data = text.encode()
    sets = [b"#$%&*+/<=>@\\^_`{|}~[]", b"!?", bytes(range(65, 91)), b"0123456789", b" \t\r", b".,;:'\"()-", b"\n"]
    symbols, marks, upper, digits, white, stops, lines = (sum(c in s for c in data) for s in sets)
    words = re.split(rb"[ \t\r\n]+", data)
    words = [w for w in words if w]
    n, size = max(len(words), 1), max(len(data), 1)
    solid = max(size - white - lines, 1)
    twice = sum(a == b and a in sets[0] + sets[1] for a, b in zip(data, data[1:]))
    again = sum(sorted(a) == sorted(b) for a, b in zip(words, words[1:]))  # the same letters, as words are told apart by the sum over their bytes
    return [symbols / n, marks / n, upper / solid, digits / solid, white / size, twice / n, np.log1p(solid / n), np.log1p(size), lines / n, stops / n, again / n]


def test_quality_scores_by_hand(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    odd = {-1: "!", -2: "!! !! ok ok ok", -3: "", -4: "one\n\ntwo two\ttwo", -5: "!", -6: "##a##"}
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(sorted(odd.items()), "doc_id long, text string")).coalesce(1).sort("doc_id")  # neighbours that begin and end alike
    model = quality.train(docs, labels)
    rows = quality.classify(docs, model).collect()
    assert len(rows) == len(texts) + len(odd)
    for r in rows:
        x = np.array(plain_features((texts | odd)[r.doc_id]))
        z = sum(w * min(6, max(-6, (v - m) / s)) for v, m, s, w in zip(x, model.mean, model.scale, model.weights)) + model.bias
        assert abs(z - r.score) < 1e-6 and r.keep == (r.score >= 0)
    assert {r.doc_id for r in quality.kept(docs, model).collect()} == {r.doc_id for r in rows if r.keep}


def test_quality_risk_by_definition():
    """The fitted weights against many others under the risk as it is written, without rounding off its corner."""
    rng = np.random.default_rng(6)
    positive, unlabelled = rng.normal(1, 1, (300, 2)), np.vstack((rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (300, 2))))
    model = quality.fit(positive, unlabelled, prior=0.5)

    def risk(w, b):
        loss = lambda x, y: np.mean(1 / (1 + np.exp(y * (np.clip((x - model.mean) / model.scale, -6, 6) @ w + b))))
        return 0.5 * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - 0.5 * loss(positive, -1)) + 0.5e-4 * w @ w

    own = risk(model.weights, model.bias)
    assert all(risk(model.weights + rng.normal(0, s, 2), model.bias + rng.normal(0, s)) > own - 2e-3 for s in (0.05, 0.3, 2.0) for _ in range(200))


def test_quality_risk_needs_no_negatives():
    rng = np.random.default_rng(5)
    positive, hidden, negative = (rng.normal(m, 1, (n, 2)) for m, n in ((2, 800), (2, 700), (-2, 300)))
    model = quality.fit(positive, np.vstack((hidden, negative)))
    assert abs(model.prior - 0.7) < 0.12
    assert (model.score(rng.normal(2, 1, (500, 2))) >= 0).mean() > 0.93 and (model.score(rng.normal(-2, 1, (500, 2))) < 0).mean() > 0.93


def test_quality_learns_from_all_documents(spark):
    """Junk that the first 8,000 documents by hash have none of."""
    plain = "A quiet river runs past the old mill, and the boats on it carry grain to the town number {}."
    first = spark.range(9000).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("at"))
    rows = [(r.doc_id, r.at <= 8000) for r in first.collect()]
    docs = spark.createDataFrame([(i, plain.format(i) * (1 + i % 5) if fine else f"{i} $$$$ #### 00 @@ " * 8) for i, fine in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, fine in rows if fine and i % 4 == 0], "doc_id long, quality int")
    model, fine = quality.train(docs, labels), dict(rows)
    kept = {r.doc_id: r.keep for r in quality.classify(docs, model).collect()}
    assert np.mean([kept[i] for i in kept if fine[i]]) > 0.97 and np.mean([kept[i] for i in kept if not fine[i]]) < 0.1
    x = {r.doc_id: r.x for r in quality._featured(docs).collect()}
    spread = np.array(list(x.values())).std(0)
    trusted = np.array([x[r.doc_id] for r in labels.collect()]).std(0)
    assert np.allclose(model.scale, np.maximum(trusted, 1e-3 + 0.05 * spread), rtol=1e-6)


def test_toxicity_on_held_out_labels(spark, sf_dir):
    """All held-out toxic documents count. Of the 35, 12 have none of the words that the others share and read like clean ones."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.classify(docs, chain).join(labels.where("doc_id % 2 = 1 and toxic is not null"), "doc_id").collect()
    toxic, alarms = ([r.is_toxic for r in rows if r.toxic == t] for t in (1, 0))
    print("caught", sum(toxic), "of", len(toxic), "false alarms", sum(alarms), "of", len(alarms), "words", chain.vocabulary)
    assert np.mean(toxic) > 0.6 and np.mean(alarms) < 0.01


def test_toxicity_scores_by_hand(spark, sf_dir):
    """Probabilities of every document from its words one by one, along the chain; and what clean() keeps."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels)
    assert chain.categories == ["kind_1", "kind_2", "toxic"] and chain.vocabulary
    text, gone = {r.doc_id: r.text for r in docs.collect()}, set()
    for r in toxicity.classify(docs, chain).collect():
        own, earlier = {w.lower() for w in re.findall(r"[^\W\d_]+", text[r.doc_id])}, []
        for name, w in zip(chain.categories, chain.weights):
            z = w[-1] + sum(x for v, x in zip(chain.vocabulary, w) if v in own) + sum(x * p for x, p in zip(w[len(chain.vocabulary) : -1], earlier))
            earlier.append(1 / (1 + np.exp(-z)))
            assert abs(r[f"p_{name}"] - earlier[-1]) < 1e-9
        assert r.is_toxic == (earlier[-1] >= 0.5)
        gone |= {r.doc_id} if r.is_toxic else set()
    assert gone and {r.doc_id for r in toxicity.clean(docs, chain).collect()} == set(text) - gone


def test_toxicity_takes_a_defined_text_of_a_repeated_id(spark):
    rows = [(i, f"plain words number {i} " + ("awful nasty" if i % 5 == 0 else "kind nice")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    again = rows + [(i, "zzz " + t) for i, t in rows]
    chains = [toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (again, 3), (again[::-1], 5))]
    for c in chains[1:]:
        assert c.vocabulary == chains[0].vocabulary == ["awful", "nasty"] and all(np.allclose(v, w) for v, w in zip(c.weights, chains[0].weights))


def test_logistic_and_kinds():
    rng = np.random.default_rng(4)
    dense, more = (rng.random((400, 6)) < 0.3).astype(float), rng.random((400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(dense @ rng.normal(0, 2, 6) + more[:, 0])))).astype(float)
    w = toxicity.logistic(toxicity.Words.of(dense), more, y, penalty=0.5)
    x = np.hstack((dense, more, np.ones((400, 1))))
    ridge = np.array([0.5] * 8 + [1e-3])
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + ridge * w).max() < 1e-4  # the gradient at the least
    two = np.zeros((40, 8))
    two[:20, :4] = rng.random((20, 4)) < 0.8
    two[20:, 4:] = rng.random((20, 4)) < 0.8
    two[:, [0, 4]] = np.repeat([[1, 0], [0, 1]], 20, axis=0)
    kind = toxicity.kinds(toxicity.Words.of(two), np.arange(40) % 4 > 0)
    assert set(kind[np.arange(40) % 4 == 0]) == {-1} and len(set(kind[:20]) - {-1}) == 1 and len(set(kind[20:]) - {-1}) == 1 and set(kind) == {-1, 0, 1}


def test_chain_feeds_probabilities_forward():
    rng = np.random.default_rng(3)
    x = (rng.random((600, 3)) < 0.5).astype(float)
    first = x[:, 0]
    y = np.column_stack((first, np.where(rng.random(600) < 0.9, first, 1 - first)))
    chain = toxicity.fit(toxicity.Words.of(x), y, ["a", "b"], ["p", "q", "r"])
    assert [len(w) for w in chain.weights] == [4, 5] and chain.weights[1][3] > 0
    p = chain.probabilities(x)
    assert ((p[:, 0] > 0.5) == first.astype(bool)).all() and np.mean((p[:, 1] > 0.5) == y[:, 1].astype(bool)) > 0.85


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>t</title><h1>One</h1><p>two", ["One", "two"]), ("<head><meta charset=x>\n<title>t</title>bare <b>text</b>", ["bare text"]),
    ("<head><title>t</title><style>x{}</style></head><body><p>one", ["one"]), ('<p>one</p><svg class="i"/><p>two</p><svg><text>no</text></svg><p>three', ["one", "two", "three"]),
    ("<p>one</p><iframe src=x><p>two</p><object><p>three", ["one", "two", "three"]), ("<p>one</p><script>if (a) <p>no", ["one"]),
])
def test_html_keeps_what_follows_an_open_head_or_element(page, want):
    assert [t for t in html_extract.parse(page).texts if t] == want


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a b="x' * 150_000, "<a b='x" * 150_000 + ">", "<div>" * 100_000 + "</p>" * 100_000, "<ul><li>" + "<div>" * 100_000 + "<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<!--" * 250_000, "<svg>" * 200_000, "<" * 1_000_000, "<a '\">" * 100_000 + '"'])
def test_html_of_a_malformed_megabyte_in_linear_time(page):
    began = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - began < 4  # about 1 s; a walk to the end for each tag takes an hour


@pytest.mark.parametrize("page, want", [
    ('<p class="a>b">one</p>', ["one"]), ("<p title='>'>one</p>two", ["one", "two"]), ("a < b and c > d<p>two", ["a < b and c > d", "two"]), ('<p>one<b class="x>two</b><p>three', ["onetwo", "three"]),
    ("one<!-- <p>no --><p>two<!-- open <p>no", ["one", "two"]), ("<!doctype html><?xml v?><p>one", ["one"]), ("one <p", ["one <p"]), ("<UL><LI>one<LI>two<UL><LI>three</UL></UL>four", ["one", "two", "three", "four"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
])
def test_html_tags_and_quotes(page, want):
    assert [t for t in html_extract.parse(page).texts if t] == want


def test_html_features_of_a_small_page():
    tree = html_extract.parse('<div class="mainText"><h1>Title</h1><p>Some, words. <a>link</a></p></div><footer>end</footer>')
    assert tree.tags == ["#root", "div", "h1", "#text", "p", "#text", "footer", "#text"] and tree.parents == [-1, 0, 1, 2, 1, 4, 0, 6]
    x = {n: c for n, c in zip(html_extract.NAMES, html_extract.features(tree, {"main": 2.0, "text": 0.5}).T)}
    chars = np.array([25, 22, 5, 5, 17, 17, 3, 3])
    assert x["depth"].tolist() == [0, 1, 2, 3, 2, 3, 1, 2] and np.allclose(np.expm1(x["chars"]), chars)
    assert np.allclose(np.expm1(x["tags"]), [9, 6, 2, 1, 3, 2, 2, 1]) and np.allclose(x["density"], np.log1p(chars / np.array([9, 6, 2, 1, 3, 2, 2, 1])))
    assert np.allclose(x["link_share"], [4 / 25, 4 / 22, 0, 0, 4 / 17, 4 / 17, 0, 0]) and x["is_text"].tolist() == [0, 0, 0, 1, 0, 1, 0, 1]
    assert x["attributes"].tolist() == [0, 2.5, 0, 0, 0, 0, 0, 0] and x["path_attributes"].tolist() == [0, 2.5, 2.5, 2.5, 2.5, 2.5, 0, 0] and x["under_around"].tolist() == [0] * 6 + [1, 1]
    assert x["index"].tolist() == [0, 0, 0, 0, 0.5, 0, 0.5, 0] and np.allclose(np.expm1(x["siblings"]), [1, 2, 2, 1, 2, 1, 2, 1]) and np.allclose(np.expm1(x["sibling_chars"]), [0, 3, 17, 0, 5, 0, 22, 0])


def test_boosting_against_exhaustive_splits():
    """The first tree's root against every feature and cut, and the score against the trees walked by hand."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 1] > 5) ^ (x[:, 3] > 8) ^ (rng.random(300) < 0.1)).astype(float)
    model = html_extract.boost(x, y, trees=6, depth=2)
    g, h = np.full(300, y.mean()) - y, np.full(300, y.mean() * (1 - y.mean()))
    gains = {(f, c): (g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)) for f in range(4) for c in range(11) if (m := x[:, f] <= c).any() and (~m).any()}
    assert abs(gains[int(model.splits[0, 0]), int(model.cuts[0, 0])] - max(gains.values())) < 1e-9
    for row, p in zip(x[:50], model.probability(x[:50])):
        score = model.base
        for split, cut, leaf in zip(model.splits, model.cuts, model.leaves):
            node = 0
            while node < 3:
                node = 2 * node + (2 if row[split[node]] > cut[node] else 1)
            score += leaf[node - 3]
        assert abs(1 / (1 + np.exp(-score)) - p) < 1e-9
    assert np.mean((model.probability(x) > 0.5) == y) > 0.8


def test_html_learns_from_capital_tags(spark):
    page = "<HTML><BODY><DIV CLASS=menu>" + "<A HREF=x>go</A> " * 9 + "</DIV><ARTICLE><P>" + "Words of an article, quite a few of them. " * 9 + "{}</P></ARTICLE></BODY></HTML>"
    pages = spark.createDataFrame([(i, page.format(i)) for i in range(30)], "page_id long, html string")
    rows = html_extract.extract(pages, html_extract.train(pages)).collect()
    assert all("article" in r.text and "go" not in r.text.split() for r in rows)


def test_html_on_held_out_pages(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    pages = [r.html for r in spark.read.parquet(f"{folder}/pages.parquet").where("html is not null").sort("page_id").collect()]
    model = html_extract.fit(pages[::2])
    tally = defaultdict(int)
    for page in pages[1::2]:
        tree = html_extract.parse(page)
        if (y := html_extract.marked(tree)) is None:
            continue
        x = html_extract.features(tree, model.weights, plain=True)  # as if the page didn't mark its content
        chosen = html_extract.decode(tree.parents, model.probability(x))
        assert all(chosen[p] or not c for p, c in zip(tree.parents[1:], chosen[1:]))
        for i, text in enumerate(tree.texts):
            if text:
                tally[bool(y[i]), bool(chosen[i])] += len(text)
    precision, recall = (tally[True, True] / max(1, tally[True, True] + tally[k]) for k in ((False, True), (True, False)))
    print("characters: precision", precision, "recall", recall)
    assert precision > 0.9 and recall > 0.9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 20), st.floats(0.01, 0.99)), min_size=1, max_size=9))
def test_decoding_is_the_likeliest_consistent_choice(nodes):
    parents = [-1] + [a % (i + 1) for i, (a, _) in enumerate(nodes)]
    p = np.array([0.5] + [q for _, q in nodes])
    weight = lambda c: sum(np.log(q if x else 1 - q) for x, q in zip(c[1:], p[1:]))
    choices = [[True] + [bool(m >> i & 1) for i in range(len(nodes))] for m in range(1 << len(nodes))]
    best = max(weight(c) for c in choices if all(c[parents[i]] for i in range(1, len(c)) if c[i]))
    assert abs(weight(html_extract.decode(parents, p)) - best) < 1e-6
