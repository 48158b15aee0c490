"""Operator 9: benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import filesystem, lean, new_path, slices

WORD = re.compile(r"[^\W_]+")
#: Words in a row that count as a leak; an item of fewer words is looked for whole if it has at least SHORTEST words.
WINDOW, SHORTEST = 8, 5
#: Bytes of benchmark text in one automaton, which has a node for each digit of a window: some 130 bytes of memory a byte of text were measured. A larger benchmark is
#: split over several automata, each with a pass of its own.
PART_BYTES = 2 << 20
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20


def normalise(text: str) -> str:
    """Lower-case words (letters and digits) with one space between them."""
    return " ".join(WORD.findall(text)).lower()


class Machine:
    """All windows of some items in one automaton: a window's end -> its number of words, and the items that have it.

    A word of the items is written as its number, two or three digits to the base 256 with signs of their own for each place, so that no node has many branches, which are looked through one by one;
    any other word is as many zeros.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, shortest: int = SHORTEST):
        self.window, cut = window, []
        for item, text in items:
            words = normalise(text).split(" ")
            n = min(window, len(words))
            if n >= min(shortest, window) and words != [""]:
                cut.append((item, n, words))
        distinct = dict.fromkeys(w for _, _, words in cut for w in words)
        self.digits = 2 if len(distinct) <= 1 << 16 else 3
        self.signs = {w: "".join(chr(1 + (place << 8) + (i >> 8 * place & 255)) for place in range(self.digits)) for i, w in enumerate(distinct)}
        found: dict[str, tuple[int, ...]] = {}
        for item, n, words in cut:
            written = "".join(map(self.signs.__getitem__, words))
            for i in range(0, len(written) - (n - 1) * self.digits, self.digits):
                own = found.get(at := written[i : i + n * self.digits], ())
                if item not in own[-1:]:
                    found[at] = (*own, item)
        self.automaton, self.owners = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        same: dict[tuple[int, ...], int] = {}
        for pattern, own in found.items():
            if own not in same:
                same[own] = len(self.owners)
                self.owners.append(tuple(sorted(set(own))))
            self.automaton.add_word(pattern, same[own] * (window + 1) + len(pattern) // self.digits)
        if found:
            self.automaton.make_automaton()

    def _written(self, text: str) -> str:
        """A text's words in the automaton's signs."""
        normal = normalise(text)
        return "".join(map(self.signs.get, normal.split(" "), repeat("\0" * self.digits))) if normal else ""

    def finds(self, text: str) -> bool:
        """Whether any window is in a text."""
        tail, keep = "", (self.window - 1) * self.digits
        for a, b in _pieces(text) if self.signs else ():
            written = tail + self._written(text[a:b])
            if next(self.automaton.iter(written), None) is not None:
                return True
            tail = written[max(0, len(written) - keep) :]
        return False

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of each maximal run of matching windows; start and end are characters of the text itself."""
        runs: dict[int, list[list[int]]] = {}
        tail, tail_places, before = "", [], 0  # the last words of the piece before, their places, and how many words came before them
        for a, b in _pieces(text) if self.signs else ():
            piece = text[a:b]
            written = tail + self._written(piece)
            hits = [(end // self.digits, value) for end, value in self.automaton.iter(written) if end >= len(tail)]
            places = tail_places + [(a + m.start(), a + m.end()) for m in WORD.finditer(piece)] if hits or b < len(text) else []
            for at, value in hits:
                owners, n = divmod(value, self.window + 1)
                last = before + at
                for item in self.owners[owners]:
                    own = runs.setdefault(item, [])
                    if own and own[-1][0] == last - 1 and n == own[-1][3]:
                        own[-1][0], own[-1][2] = last, places[at][1]
                    else:
                        own.append([last, places[at - n + 1][0], places[at][1], n, last])
            n = len(written) // self.digits
            keep = min(self.window - 1, n)
            before += n - keep
            tail, tail_places = written[(n - keep) * self.digits :], places[len(places) - keep :] if places else []
        return sorted((item, start, end, last - first + n) for item, own in runs.items() for last, start, end, n, first in own)


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE characters that cut no word."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and (rest := WORD.match(text, end)):
            end = rest.end()
        yield at, end
        at = end


def _parts(benchmark: DataFrame) -> tuple[str, int]:
    """Write distinct items in parts of about PART_BYTES, each item to the part of its hash: (where, number of parts). Nothing of them comes to the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    uri = new_path(benchmark.sparkSession, "benchmark")
    items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).repartition(parts, "part").write.partitionBy("part").parquet(uri)
    return uri, parts


@lru_cache(maxsize=1)
def machine(uri: str, part: int, window: int, shortest: int) -> Machine:
    """The automaton of one written part; a worker builds it once and holds one at a time."""
    files, folder = filesystem(f"{uri}/part={part}")
    if files.get_file_info(folder).type == pafs.FileType.NotFound:
        return Machine([], window, shortest)
    rows = pads.dataset(folder, format="parquet", filesystem=files).to_table(columns=["item_id", "text"]).sort_by([("item_id", "ascending"), ("text", "ascending")])
    return Machine(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())), window, shortest)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of benchmark items in texts: (doc_id, item_id, start_char, end_char, n_words).

    Every item's normalised text is cut into windows of ``window`` words (an item of fewer words, but at least
    ``shortest``, is one window); one automaton over words holds all of them and each normalised text is scanned once. Windows that
    match at consecutive words make one row, with its characters in the original text. A window that several items
    contain counts for each. A benchmark of more than PART_BYTES is written in parts, with a pass over the texts for each, so a worker holds one part's automaton; an item is never split.
    Null or empty texts and items match nothing, as do items shorter than ``shortest``; null item ids are dropped, null
    document ids kept; repeated documents give repeated rows, repeated items none; empty tables give no rows. Long texts
    are scanned whole, a piece at a time; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base, out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), None
    uri, parts = _parts(benchmark)
    for part in range(parts):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            own = machine(uri, part, window, shortest)
            for batch in slices(batches):
                at, rows = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if text:
                        for row in own.spans(text):
                            at.append(i)
                            rows.append(row)
                item, start, end, words = zip(*rows) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.int32())], ["id", "item_id", "start_char", "end_char", "n_words"])

        one = base.mapInArrow(lean(run), f"id {kind}, item_id long, start_char int, end_char int, n_words int")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, text_col: str = "text") -> DataFrame:
    """The rows of docs in which find() finds nothing, with all their columns: one pass a part of the benchmark, without a shuffle.

    Null and empty texts stay, as do rows with a null id; repeated rows stay or go together; an empty benchmark leaves all rows, and an empty table gives none.
    """
    at_text = docs.columns.index(text_col)
    uri, parts = _parts(benchmark)
    for part in range(parts):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            own = machine(uri, part, window, shortest)
            for batch in slices(batches):
                yield batch.filter(pa.array([not text or not own.finds(text) for text in batch.column(at_text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


FIND_SQL = rf"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS pieces FROM documents WHERE text <> ''
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') FROM benchmark WHERE text <> ''),
pieces AS (SELECT kind, id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM words),
placed AS (SELECT kind, id, piece, i, sum(length(piece)) OVER (PARTITION BY kind, id ORDER BY i) AS end_char FROM pieces),
only_words AS (SELECT kind, id, i, lower(piece) AS word, end_char - length(piece) AS start_char, end_char FROM placed WHERE regexp_matches(piece, '^[\p{{L}}\p{{N}}]')),
listed AS (SELECT kind, id, list(word ORDER BY i) AS w, list(start_char ORDER BY i) AS starts, list(end_char ORDER BY i) AS ends FROM only_words GROUP BY kind, id),
sized AS (SELECT id AS item_id, w, least(len(w), {WINDOW}) AS n FROM listed WHERE kind = 'b' AND len(w) >= {SHORTEST}),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS text FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
windows AS (
    SELECT id AS doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS text, starts[k] AS start_char, ends[k + n - 1] AS end_char
    FROM (SELECT id, w, starts, ends, n, unnest(range(1, len(w) - n + 2)) AS k FROM listed, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, k, start_char, end_char, k - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k) AS island FROM windows JOIN items USING (n, text))
SELECT doc_id, item_id, CAST(min(start_char) AS INTEGER) AS start_char, CAST(max(end_char) AS INTEGER) AS end_char, CAST(max(k) - min(k) + any_value(n) AS INTEGER) AS n_words
FROM hits GROUP BY doc_id, item_id, island"""
