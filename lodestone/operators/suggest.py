"""Spelling suggestions from a dictionary of terms."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.distance import distance, within
from lodestone.functions.text import bigrams, py_tokenize


def py_bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)] or ([word] if word else [])


def suggest(terms: DataFrame, word: str, most: int = 2, overlap: float = 0.3) -> DataFrame:
    """One row (word, suggestion) from terms (term, df): the term that is nearest within ``most`` edits among those that share enough bigrams with
    the word; then the more frequent, then the lesser. Null if the word is a term itself or nothing is near.

    Shared bigrams are counted with multiplicity on both sides. One pass over the dictionary; the exact distance is computed for what passes the cheap tests.
    """
    own = Counter(py_bigrams(word))
    if not own:
        return terms.sparkSession.createDataFrame([(word, None)], "word string, suggestion string")
    weights = F.create_map(*[x for b, n in sorted(own.items()) for x in (F.lit(b), F.lit(n))])
    shared = F.aggregate(bigrams(F.col("term")), F.lit(0), lambda s, b: s + F.coalesce(F.try_element_at(weights, b), F.lit(0)))
    known = F.col("term") == word
    enough = shared / F.lit(sum(own.values())) >= overlap
    near = terms.where(known | (enough & (F.abs(F.length("term") - len(word)) <= most) & (F.levenshtein(F.col("term"), F.lit(word)) <= 2 * most)))
    near = near.withColumn("far", distance(F.col("term"), F.lit(word)))
    best = F.min(F.when(~known & (F.col("far") <= most), F.struct("far", (-F.col("df")).alias("rare"), "term")))
    found = near.agg(F.coalesce(F.max(known), F.lit(False)).alias("known"), best.alias("best"))
    return found.select(F.lit(word).alias("word"), F.when(~F.col("known"), F.col("best.term")).alias("suggestion"))


def correct(terms: DataFrame, query: str, most: int = 2, overlap: float = 0.3) -> tuple[str, bool]:
    """The query with each word that has a suggestion replaced, and whether one had."""
    words = py_tokenize(query)
    lower = sorted({w.lower() for w in words})
    if not lower:
        return "", False
    frames = [suggest(terms, w, most, overlap) for w in lower]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    better = {r.word: r.suggestion for r in every.collect() if r.suggestion}
    return " ".join(better.get(w.lower(), w) for w in words), any(w in better for w in lower)


def expand(terms: DataFrame, words: list[str], most: int) -> dict[str, list[str]]:
    """For each word the terms within ``most`` edits, in order; a word near to none stands for itself."""
    distinct = list(dict.fromkeys(words))
    if not distinct:
        return {}
    asked = terms.sparkSession.createDataFrame([(w,) for w in distinct], "word string")
    near = terms.select("term").crossJoin(F.broadcast(asked)).where(within(F.col("term"), F.col("word"), most))  # as many rows as the query has words
    found: dict[str, list[str]] = {}
    for row in near.sort("word", "term").collect():
        found.setdefault(row.word, []).append(row.term)
    return {w: found.get(w, [w]) for w in distinct}
