"""Searching an index: ranked, boolean, wildcard and fuzzy queries, facets, snippets and suggestions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.distance import within
from lodestone.functions.text import Analyzer
from lodestone.operators import highlight
from lodestone.operators.index import Index
from lodestone.operators.ranking import BM25, Proximity, TfIdf, least_windows
from lodestone.operators.suggest import correct, expand, suggest
from lodestone.plans import query as q


def top(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Best score first, ties by id as a string; no limit, or one below 1, gives all."""
    ordered = results.orderBy(F.desc("score"), "doc_id")
    return ordered.limit(limit) if limit and limit > 0 else ordered


def _phrase_matches(places: str, terms: list[str]) -> Column:
    """Whether some start has each term at its offset; ``places`` is a map from term to positions."""
    def shifted(by: int):
        return lambda x: x - by

    starts = None
    for i, term in enumerate(terms):
        at = F.transform(F.coalesce(F.try_element_at(places, F.lit(term)), F.array().cast("array<int>")), shifted(i))
        starts = at if starts is None else F.array_intersect(starts, at)
    return F.size(starts) > 0


@dataclass(frozen=True)
class Engine:
    """An index with a ranker. ``fuzzy`` expands each query word to the terms within so many edits.

    Documents are indexed with exact terms; fuzzy_documents() expands documents as well, for an index in which each near term occurs once a document.
    """

    index: Index
    ranker: BM25 | TfIdf | Proximity = BM25()
    fuzzy: int = 0

    def __post_init__(self) -> None:
        if self.index is None or self.ranker is None:
            raise ValueError("an engine needs an index and a ranker")

    @classmethod
    def build(cls, docs: DataFrame, analyzer: Analyzer | None = None, ranker: BM25 | TfIdf | Proximity | None = None, fuzzy: int = 0) -> Engine:
        return cls(Index.build(docs, analyzer), ranker or BM25(), fuzzy)

    def add(self, docs: DataFrame, order: str | None = None) -> Engine:
        """The engine with these documents, in place of those of the same id; of several rows of one id the last counts, by ``order``."""
        return replace(self, index=self.index.upsert(docs, order))

    def delete(self, doc_id: str) -> Engine:
        return replace(self, index=self.index.delete([doc_id]))

    def save(self, path: str) -> None:
        self.index.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer | None = None, ranker: BM25 | TfIdf | Proximity | None = None) -> Engine:
        return cls(Index.load(spark, path, analyzer), ranker or BM25())

    def compile(self, text: str) -> q.Plain:
        plain = q.compile_plain(text, self.index.analyzer)
        if not self.fuzzy:
            return plain
        near = expand(self.index.terms(), plain.terms, self.fuzzy)
        loose = plain.terms[: len(plain.terms) - sum(map(len, plain.phrases))]
        expanded = lambda words: list(dict.fromkeys(t for w in words for t in near[w]))
        phrases = [expanded(p) for p in plain.phrases]
        return q.Plain(expanded(loose) + [t for p in phrases for t in p], phrases)

    def _matched(self, weights: dict[str, int]) -> DataFrame:
        """Postings of the terms with what a ranker needs. Frequencies and corpus statistics are one row each, from scans that the terms prune."""
        ours = F.col("term").isin(sorted(weights))
        rows = self.index.postings.where(ours)
        df = rows.groupBy("term").count().agg(F.map_from_entries(F.collect_list(F.struct("term", "count"))).alias("dfs"))
        qtf = F.create_map(*[x for t, n in sorted(weights.items()) for x in (F.lit(t), F.lit(n))])
        return rows.crossJoin(df).crossJoin(self.index.corpus_stats()).withColumn("df", F.col("dfs")[F.col("term")]).withColumn("qtf", qtf[F.col("term")]).drop("dfs")

    def _scored(self, weights: dict[str, int], extra: list[Column] | None = None) -> DataFrame:
        """(doc_id, score, extra aggregates): one shuffle, on doc_id."""
        return self._matched(weights).groupBy("doc_id").agg(F.sum(self.ranker.term_score()).alias("score"), *(extra or []))

    def _boosted(self, scored: DataFrame, terms: list[str]) -> DataFrame:
        if not isinstance(self.ranker, Proximity) or not self.ranker.weight or len(terms) < 2:
            return scored
        distinct = list(dict.fromkeys(terms))
        windows = least_windows(self.index.postings.where(F.col("term").isin(distinct)).select("doc_id", "term", "positions"), distinct)
        bonus = F.coalesce(F.lit(float(self.ranker.weight)) / (1 + F.col("width")), F.lit(0.0))
        return scored.join(windows, "doc_id", "left").withColumn("score", F.col("score") + bonus).drop("width")

    def _nothing(self) -> DataFrame:
        return self.index.docs.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))

    def _places(self, terms: set[str]) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("term").isin(sorted(terms)), F.struct("term", "positions")))).alias("places")

    def hits(self, text: str) -> DataFrame:
        """(doc_id, score) of a plain query, without order: documents with any of its words or, if it has phrases, with all phrases.

        The terms near to the words of a fuzzy query stay in the plan; only phrases and windows need them by name.
        """
        if self.fuzzy and not isinstance(self.ranker, Proximity):
            exact = q.compile_plain(text, self.index.analyzer)
            if exact.terms and not exact.phrases:
                near = [within(F.col("term"), F.lit(w), self.fuzzy) for w in dict.fromkeys(exact.terms)]
                return self._scored_rows(self.index.postings.join(self.index.terms().where(reduce(or_, near)), "term"))
        plain = self.compile(text)
        if not plain.terms:
            return self._nothing()
        if plain.phrases:
            scored = self._scored(plain.weights, [self._places({t for p in plain.phrases for t in p})])
            for phrase in plain.phrases:
                scored = scored.where(_phrase_matches("places", phrase))
            scored = scored.drop("places")
        else:
            scored = self._scored(plain.weights)
        return self._boosted(scored, plain.terms)

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        return top(self.hits(text), limit)

    def search_parallel(self, text: str, workers: int = 4, limit: int | None = None) -> DataFrame:
        """search(): its tasks already run in parallel, so ``workers`` changes nothing."""
        return self.search(text, limit)

    def with_documents(self, results: DataFrame) -> DataFrame:
        return top(results.join(self.index.docs, "doc_id"))

    def boolean_hits(self, text: str) -> DataFrame:
        """(doc_id, score) of a boolean query: terms and phrases become flags in one aggregation over their postings, the tree one predicate over documents."""
        near = (lambda w: expand(self.index.terms(), [w], self.fuzzy)[w]) if self.fuzzy else None
        tree = q.parse(text, self.index.analyzer, near)
        if tree is None:
            return self._nothing()
        nodes = [n for n in dict.fromkeys(q.leaves(tree)) if isinstance(n, (q.Term, q.Phrase, q.AnyOf))]
        flags = {n: f"__flag{i}" for i, n in enumerate(nodes)}
        positive = q.positive_terms(tree)
        docs = self.index.docs
        if nodes:
            terms = {t for n in nodes for t in ([n.term] if isinstance(n, q.Term) else n.terms)}
            phrases = [n for n in nodes if isinstance(n, q.Phrase)]
            extra = [F.max(F.col("term").isin([n.term] if isinstance(n, q.Term) else list(n.terms))).alias(flags[n]) for n in nodes if n not in phrases]
            if phrases:
                extra.append(self._places({t for p in phrases for t in p.terms}))
            weights = dict.fromkeys(sorted(terms), 0) | dict.fromkeys(positive, 1)
            scored = self._scored(weights, extra)
            for p in phrases:
                scored = scored.withColumn(flags[p], _phrase_matches("places", list(p.terms)))
            docs = docs.join(scored.drop("places") if phrases else scored, "doc_id", "left")
        else:
            docs = docs.withColumn("score", F.lit(0.0))
        found = docs.where(q.evaluate(tree, docs, flags)).select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
        return self._boosted(found, positive)

    def search_bool(self, text: str, limit: int | None = None) -> DataFrame:
        return top(self.boolean_hits(text), limit)

    def expand_wildcard(self, pattern: str) -> DataFrame:
        """(term) in order: the terms that a pattern with * and ? covers. The pattern isn't analysed, only trimmed and lower-cased."""
        test = q.wildcard(pattern)
        return self.index.terms().where(F.lit(False) if test is None else test).orderBy("term")

    def wildcard_hits(self, pattern: str) -> DataFrame:
        """(doc_id, score) over all terms that the pattern covers: a filter on postings, so that their number doesn't matter."""
        test = q.wildcard(pattern)
        if test is None:
            return self._nothing()
        return self._scored_rows(self.index.postings.where(test))

    def _scored_rows(self, rows: DataFrame) -> DataFrame:
        """(doc_id, score) over postings, each term as if asked for once, however many terms these are."""
        df = rows.groupBy("term").agg(F.count("*").alias("df"))
        matched = rows.join(df, "term").crossJoin(self.index.corpus_stats()).withColumn("qtf", F.lit(1))
        return matched.groupBy("doc_id").agg(F.sum(self.ranker.term_score()).alias("score"))

    def search_wildcard(self, pattern: str, limit: int | None = None) -> DataFrame:
        return top(self.wildcard_hits(pattern), limit)

    def facet(self, text: str, name: str) -> DataFrame:
        """(value, n) over all hits of a plain query, for a column of the documents or an entry of their map ``meta``; missing values don't count."""
        docs = self.index.docs
        if (found := q.meta_column(docs, name)) is None:
            return docs.where(F.lit(False)).select(F.lit("").alias("value"), F.lit(0).cast("long").alias("n"))
        values = self.hits(text).select("doc_id").join(docs.select("doc_id", found[0].cast("string").alias("value")), "doc_id")
        return values.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))

    def snippets(self, text: str, limit: int | None = None, options: highlight.Options = highlight.Options()) -> DataFrame:
        """(doc_id, score, snippet) of a plain query's results."""
        terms = self.compile(text).terms
        shown = self.search(text, limit).join(self.index.docs.select("doc_id", "text"), "doc_id")
        return highlight.with_snippets(top(shown.select("doc_id", "score", "text")), sorted(set(terms)), self.index.analyzer, options)

    def highlights(self, text: str, limit: int | None = None, options: highlight.Options = highlight.Options()) -> DataFrame:
        """(doc_id, score, spans) of a plain query's results; spans: array of (text, match)."""
        terms = self.compile(text).terms
        shown = self.search(text, limit).join(self.index.docs.select("doc_id", "text"), "doc_id")
        return highlight.with_spans(top(shown.select("doc_id", "score", "text")), sorted(set(terms)), self.index.analyzer, options)

    def term_occurrences(self, text: str) -> DataFrame:
        """One row (occurrences): how often the query's words occur, a repeated word as often again."""
        weights = q.compile_plain(text.replace('"', " "), self.index.analyzer).weights
        if not weights:
            return self.index.docs.agg(F.lit(0).cast("long").alias("occurrences"))
        qtf = F.create_map(*[x for t, n in sorted(weights.items()) for x in (F.lit(t), F.lit(n))])
        return self.index.postings.where(F.col("term").isin(sorted(weights))).agg(F.coalesce(F.sum(F.col("tf") * qtf[F.col("term")]), F.lit(0)).alias("occurrences"))

    def stats(self) -> DataFrame:
        return self.index.stats()

    def suggestion(self, word: str, most: int = 2, overlap: float = 0.3) -> DataFrame:
        return suggest(self.index.term_stats(), word, most, overlap)

    def did_you_mean(self, text: str, most: int = 2, overlap: float = 0.3) -> tuple[str, bool]:
        return correct(self.index.term_stats(), text, most, overlap)


def fuzzy_documents(docs: DataFrame, vocabulary: DataFrame, most: int, analyzer: Analyzer) -> DataFrame:
    """(doc_id, text) in which every token gave way to the vocabulary's terms within ``most`` edits, each once a document: documents as a fuzzy analyzer would index them.

    Distances are computed between distinct tokens and terms only.
    """
    at = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode_outer(analyzer.column(F.col("text"))).alias("position", "token"))
    words = at.select("token").where("token is not null").distinct()
    vocabulary = vocabulary.select("term").distinct().withColumn("size", F.length("term"))
    banded = words.withColumn("size", F.explode(F.sequence(F.greatest(F.length("token") - most, F.lit(0)), F.length("token") + most)))
    near = banded.join(vocabulary, "size").where(within(F.col("token"), F.col("term"), most)).select("token", "term")
    grown = at.join(near, "token", "left").select("doc_id", "position", F.coalesce("term", "token").alias("term"))
    first = grown.groupBy("doc_id", "term").agg(F.min("position").alias("position"))
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("position", "term")))), lambda x: x["term"])
    return first.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("text"))
