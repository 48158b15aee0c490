"""Query strings: plain queries with quoted phrases, the boolean language, and wildcard patterns."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import Analyzer


class ParseError(ValueError):
    """A boolean query that isn't well-formed."""


@dataclass(frozen=True)
class Plain:
    """Terms in order, duplicates kept, and the phrases among them, all of which must match."""

    terms: list[str]
    phrases: list[list[str]]

    @property
    def weights(self) -> dict[str, int]:
        return dict(Counter(self.terms))


def compile_plain(text: str, analyzer: Analyzer) -> Plain:
    """What lies between quotes is a phrase, after an unpaired quote all the rest; every word counts for the score."""
    terms, phrases = [], []
    for i, part in enumerate(text.split('"')):
        words = analyzer(part)
        if words and i % 2:
            phrases.append(words)
        elif words:
            terms += words
    return Plain(terms + [w for p in phrases for w in p], phrases)


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class AnyOf:
    """Any of several terms: a word's fuzzy alternatives."""

    terms: tuple[str, ...]


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Negation:
    inner: object


@dataclass(frozen=True)
class Meta:
    name: str
    op: str
    value: str


_LEXEME = re.compile(r'\s+|(?P<paren>[()])|"(?P<phrase>[^"]*)(?:"|$)|(?P<op>[<>=]=?|!=)|(?P<bang>!)|(?P<word>[^\s()"<>=!]+)')


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value): keywords only in capitals; a lone ! is a word."""
    out = []
    for m in _LEXEME.finditer(text):
        kind = m.lastgroup
        if kind == "bang":
            out.append(("word", "!"))
        elif kind == "word" and m[kind] in ("AND", "OR", "NOT"):
            out.append((m[kind], m[kind]))
        elif kind == "paren":
            out.append((m[kind], m[kind]))
        elif kind:
            out.append((kind, m[kind]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str, analyzer, expand):
        self.tokens, self.at, self.analyzer, self.expand = lex(text), 0, analyzer, expand

    def peek(self) -> str:
        return self.tokens[self.at][0]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self):
        left = self.both()
        while self.peek() == "OR":
            self.take()
            left = Either(self.needed(left, "OR"), self.needed(self.both(), "OR"))
        return left

    def both(self):
        left = self.unary()
        while self.peek() in ("AND", "NOT", "(", "phrase", "word"):
            if self.peek() == "AND":
                self.take()
            left = Both(self.needed(left, "AND"), self.needed(self.unary(), "AND"))
        return left

    def unary(self):
        if self.peek() == "NOT":
            self.take()
            return Negation(self.needed(self.unary(), "NOT"))
        return self.primary()

    def primary(self):
        kind = self.peek()
        if kind == "(":
            self.take()
            inner = self.either()
            if self.peek() != ")":
                raise ParseError("missing closing parenthesis")
            self.take()
            return Nothing() if inner is None else inner
        if kind in ("phrase", "word"):
            value = self.take()
            if kind == "word" and self.peek() == "op":
                op = self.take()
                if self.peek() not in ("word", "phrase"):
                    raise ParseError(f"no value after {value}{op}")
                return Meta(value, op, self.take())
            return self.node(value)
        if kind in ("end", ")"):
            return None
        raise ParseError(f"unexpected {self.tokens[self.at][1]}")

    def node(self, text: str):
        terms = self.analyzer(text)
        if not terms:
            return Nothing()
        if len(terms) > 1:
            return Phrase(tuple(terms))
        found = self.expand(terms[0]) if self.expand else terms
        return Term(found[0]) if len(found) == 1 else AnyOf(tuple(found))

    @staticmethod
    def needed(node, operator: str):
        if node is None:
            raise ParseError(f"{operator} lacks an operand")
        return node


def parse(text: str, analyzer: Analyzer, expand=None):
    """The tree of a boolean query, or None for a blank one. NOT binds before AND, also when AND is left out, and AND before OR. ``expand`` gives a word's alternatives."""
    parser = _Parser(text, analyzer, expand)
    tree = parser.either()
    if parser.peek() != "end":
        raise ParseError(f"unexpected {parser.tokens[parser.at][1]}")
    return tree


def leaves(node) -> list:
    if isinstance(node, (Both, Either)):
        return leaves(node.left) + leaves(node.right)
    if isinstance(node, Negation):
        return leaves(node.inner)
    return [] if node is None else [node]


def positive_terms(node) -> list[str]:
    """Distinct terms that aren't under NOT, in order."""
    if isinstance(node, (Both, Either)):
        return list(dict.fromkeys(positive_terms(node.left) + positive_terms(node.right)))
    if isinstance(node, Term):
        return [node.term]
    return list(dict.fromkeys(node.terms)) if isinstance(node, (Phrase, AnyOf)) else []


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def meta_column(docs: DataFrame, name: str) -> tuple[Column, str] | None:
    """A document's metadata of a name, and its type: the column of that name or, where there is none, the entry of the map ``meta``. None if there is neither."""
    kinds = dict(docs.dtypes)
    if name in kinds:
        return F.col(f"`{name}`"), kinds[name]
    if (kind := kinds.get("meta", "")).startswith("map<string,"):
        return F.try_element_at("meta", F.lit(name)), kind[len("map<string,") : -1]
    return None


def meta_predicate(docs: DataFrame, meta: Meta) -> Column:
    """A filter on a document's metadata, see meta_column(); false where it is missing or null, also for !=. Numbers compare as numbers if both sides are."""
    found = meta_column(docs, meta.name)
    if found is None or meta.op == "==":
        return F.lit(False)
    raw, kind = found
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if numeric:
        left = raw.cast("double")
    elif kind == "string":
        left = F.when(raw.rlike(_NUMBER), F.trim(raw).try_cast("double"))
    else:
        left = F.lit(None).cast("double")
    right = float(meta.value) if re.match(_NUMBER, meta.value) else None
    if meta.op in ("=", "!="):
        text = F.when(F.lit(numeric) & (raw.cast("double") == F.floor(raw.cast("double"))), F.floor(raw.cast("double")).cast("string")).otherwise(raw.cast("string")) if numeric else raw if kind == "string" else F.lit("")
        equal = text == meta.value
        if right is not None:
            equal = F.when(left.isNotNull(), (left == right) & ~F.isnan(left)).otherwise(equal)
        return F.coalesce(raw.isNotNull() & (equal if meta.op == "=" else ~equal), F.lit(False))
    if right is None:
        return F.lit(False)
    test = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[meta.op]
    return F.coalesce(test & ~F.isnan(left), F.lit(False))


def evaluate(node, docs: DataFrame, flags: dict) -> Column:
    """The tree as one predicate; ``flags`` names the boolean column of each term and phrase."""
    if isinstance(node, Both):
        return evaluate(node.left, docs, flags) & evaluate(node.right, docs, flags)
    if isinstance(node, Either):
        return evaluate(node.left, docs, flags) | evaluate(node.right, docs, flags)
    if isinstance(node, Negation):
        return ~evaluate(node.inner, docs, flags)
    if isinstance(node, Meta):
        return meta_predicate(docs, node)
    if isinstance(node, (Term, Phrase, AnyOf)):
        return F.coalesce(F.col(flags[node]), F.lit(False))
    return F.lit(False)


def wildcard(pattern: str) -> Column | None:
    """The predicate on term of a pattern with * and ?, or None for a blank one. A single * at the end is a prefix, which Parquet can look up."""
    pattern = pattern.strip().lower()
    term = F.col("term")
    if not pattern:
        return None
    if not set("*?") & set(pattern):
        return term == pattern
    if pattern.endswith("*") and not set("*?") & set(pattern[:-1]):
        return term.startswith(pattern[:-1])
    return term.like("".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in pattern))
