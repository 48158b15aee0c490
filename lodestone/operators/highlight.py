"""Snippets and highlights of query terms in a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.functions.memory import Remembered, lean, runs, small_batches
from lodestone.functions.text import Analyzer, py_tokenize


@dataclass(frozen=True)
class Options:
    """Words around a hit, marks around it, what stands for left-out words, and how many windows are shown."""

    radius: int = 6
    opening: str = "**"
    closing: str = "**"
    ellipsis: str = "..."
    fragments: int = 12

    def filled(self) -> Options:
        """Defaults in place of what is empty or not positive."""
        base = Options()
        marks = (self.opening, self.closing) if self.opening or self.closing else (base.opening, base.closing)
        return Options(self.radius if self.radius > 0 else base.radius, *marks, self.ellipsis or base.ellipsis, self.fragments if self.fragments > 0 else base.fragments)


class Hits(Remembered):
    """word -> whether one of its terms is wanted; each distinct word in use is analysed once."""

    def __init__(self, terms: list[str], analyze: Callable[[str], list[str]]):
        wanted = set(terms)
        super().__init__(lambda word: not wanted.isdisjoint(analyze(word)))


def _preview(words: list[str], options: Options) -> str:
    end = 2 * options.radius
    return " ".join([*words[:end], options.ellipsis] if end < len(words) else words)


def snippet(text: str, terms: list[str], analyze: Callable[[str], list[str]], options: Options = Options(), hits: Hits | None = None) -> str:
    """One window from the first hit to the last with ``radius`` words on either side; without hits the first 2 * radius words."""
    o = options if options.opening or options.closing else Options()
    o = Options(o.radius if o.radius > 0 else 6, o.opening, o.closing, o.ellipsis or "...", o.fragments)
    words = py_tokenize(text)
    hit = list(map((Hits(terms, analyze) if hits is None else hits).__getitem__, words))
    if not any(hit):
        return _preview(words, o)
    first, last = hit.index(True), len(hit) - 1 - hit[::-1].index(True)
    start, end = max(0, first - o.radius), min(len(words), last + o.radius + 1)
    shown = [f"{o.opening}{w}{o.closing}" if h else w for w, h in zip(words[start:end], hit[start:end])]
    return " ".join([o.ellipsis] * (start > 0) + shown + [o.ellipsis] * (end < len(words)))


def spans(text: str, terms: list[str], analyze: Callable[[str], list[str]], options: Options = Options(), hits: Hits | None = None) -> list[tuple[str, bool]]:
    """(text, is a hit) in order: windows of ``radius`` words around hits, joined where they touch, at most ``fragments`` of them."""
    o = options.filled()
    words = py_tokenize(text)
    if not words:
        return []
    hit = list(map((Hits(terms, analyze) if hits is None else hits).__getitem__, words))
    if not any(hit):
        return [(_preview(words, o), False)]
    windows: list[list[int]] = []
    for i in (i for i, h in enumerate(hit) if h):
        start, end = max(0, i - o.radius), min(len(words), i + o.radius + 1)
        if windows and start <= windows[-1][1]:
            windows[-1][1] = max(end, windows[-1][1])
        else:
            windows.append([start, end])
    shown = windows[: o.fragments]
    pieces: list[tuple[str, bool]] = []
    for k, (start, end) in enumerate(shown):
        if k or start:
            pieces.append((o.ellipsis, False))
        pieces += zip(words[start:end], hit[start:end])
    if len(shown) < len(windows) or shown[-1][1] < len(words):
        pieces.append((o.ellipsis, False))
    out: list[tuple[str, bool]] = []
    plain = ""
    for k, (word, is_hit) in enumerate(pieces):
        plain += " " if k else ""
        if is_hit:
            if plain:
                out.append((plain, False))
            out.append((word, True))
            plain = ""
        else:
            plain += word
    return [*out, (plain, False)] if plain else out


def highlights(text: str, terms: list[str], analyze: Callable[[str], list[str]], options: Options = Options()) -> str:
    o = options.filled()
    return "".join(f"{o.opening}{t}{o.closing}" if h else t for t, h in spans(text, terms, analyze, options))


def _shown(rows: DataFrame, name: str, kind: str, of: Callable[[list[str | None], Hits], pa.Array], terms: list[str], analyzer: Analyzer) -> DataFrame:
    """rows with ``text``, their last column, replaced by what is shown of it. Not an expression: Spark would also work that out for sorts, and for filters below a join, which then looks at all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(terms, analyzer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for start, end in runs(sizes, BYTES, ROWS):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], of(part.column("text").to_pylist(), hits)], [*part.schema.names[:-1], name])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"{name} {kind}"])
    return small_batches(rows).mapInArrow(lean(run), kinds)


#: Bytes and number of the texts that a worker looks at before it passes on what it has.
BYTES, ROWS = 1 << 20, 500


def with_snippets(rows: DataFrame, terms: list[str], analyzer: Analyzer, options: Options = Options()) -> DataFrame:
    """(..., snippet) of rows (..., text), in their order; a word that texts share is analysed once a task."""

    def of(texts: list[str | None], hits: Hits) -> pa.Array:
        return pa.array([None if t is None else snippet(t, terms, analyzer, options, hits) for t in texts], pa.string())

    return _shown(rows, "snippet", "string", of, terms, analyzer)


def with_spans(rows: DataFrame, terms: list[str], analyzer: Analyzer, options: Options = Options()) -> DataFrame:
    """(..., spans) of rows (..., text), in their order."""

    def of(texts: list[str | None], hits: Hits) -> pa.Array:
        found = [None if t is None else spans(t, terms, analyzer, options, hits) for t in texts]
        flat = [x for f in found if f for x in f]
        pairs = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([m for _, m in flat], pa.bool_())], ["text", "match"])
        starts = np.cumsum([0, *(len(f or ()) for f in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts, mask=np.array([*(f is None for f in found), False])), pairs)

    return _shown(rows, "spans", "array<struct<text:string,match:boolean>>", of, terms, analyzer)
