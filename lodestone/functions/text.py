"""Text analysis as column expressions, with the same steps in Python for query strings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, in the syntax that Java and RE2 share.
SPACE = r"[\t\n\x0B\f\r \x{85}\p{Z}]+"
PUNCTUATION = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"
#: The same at the ends of all of a text's tokens at once.
EDGES = r"(?<![^\t\n\x0B\f\r \x{85}\p{Z}])[\p{P}\p{S}]+|[\p{P}\p{S}]+(?![^\t\n\x0B\f\r \x{85}\p{Z}])"

ENGLISH_STOP_WORDS = tuple("a an and are as at be but by for from has have he in is it its of on or that the this to was were will with you your".split())
RUSSIAN_STOP_WORDS = tuple(sorted(set(
    "бы был было быть | вам вас вот все вы в во | да даже для до | его ее ему если ещё еще | же | за | и из или им их | к как который которая которые которых | "
    "ли | между меня мне может можно мы | на над нам не него нет ним них но ну нужно | о он она они оно от | по под при | с со сам сама свой своя свои своего своих себя | "
    "та так также там те теперь то тоже только тот ты | у уже | чем чём через что чтобы | это этот эта эти | я а без | благодаря включая поддерживает"
    .replace("|", " ").split())))


def tokenize(text: Column) -> Column:
    """Runs of characters that aren't white space. Null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def strip_punctuation(tokens: Column) -> Column:
    """Punctuation and symbols go from both ends of each token; what is left empty goes."""
    return F.filter(F.transform(tokens, lambda x: F.regexp_replace(x, PUNCTUATION, "")), lambda x: x != "")


def remove_words(tokens: Column, words: Iterable[str]) -> Column:
    """Tokens that aren't among words, whatever their case; repeated tokens stay."""
    stop = sorted({w.lower() for w in words})
    return F.filter(tokens, lambda x: ~F.lower(x).isin(stop))


def letters_and_digits(text: Column, least: int = 1) -> Column:
    """Lower-case runs of letters and digits of at least ``least`` characters: the tokens of embedders (1) and predictors (3)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda x: F.length(x) >= least)


def bigrams(word: Column) -> Column:
    """Pairs of neighbouring characters; a word of one character is its own, an empty one has none."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2)))
    return F.when(F.length(word) > 0, pairs).otherwise(F.array().cast("array<string>"))


# The same for strings on the driver.

_PY_SPACE = re.compile("[\t\n\x0b\x0c\r \x85" + "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")) + "]+")


def _mark(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


#: What str.split() takes for white space besides.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def py_tokenize(text: str) -> list[str]:
    return text.split() if _SEPARATORS.search(text) is None else [t for t in _PY_SPACE.split(text) if t]


def py_strip(token: str) -> str:
    a, b = 0, len(token)
    while a < b and _mark(token[a]):
        a += 1
    while b > a and _mark(token[b - 1]):
        b -= 1
    return token[a:b]


def py_letters_and_digits(text: str, least: int = 1) -> list[str]:
    return [w for w in "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower()).split(" ") if len(w) >= max(least, 1)]


@dataclass(frozen=True)
class Filter:
    """A step of an analyzer: for columns of tokens, and for a list of tokens. ``stem`` marks a step word -> word that runs in Python, once for each distinct word. ``text`` does the same to a whole text before it is cut at white space."""

    column: Callable[[Column], Column] | None
    words: Callable[[list[str]], list[str]]
    stem: Callable[[str], str] | None = None
    text: Callable[[Column], Column] | None = None


LOWERCASE = Filter(lowercase, lambda ts: [t.lower() for t in ts], text=F.lower)
STRIP = Filter(strip_punctuation, lambda ts: [s for t in ts if (s := py_strip(t))], text=lambda t: F.regexp_replace(t, EDGES, ""))


def stop_words(words: Iterable[str]) -> Filter:
    stop = frozenset(w.lower() for w in words)
    return Filter(lambda c: remove_words(c, stop), lambda ts: [t for t in ts if t.lower() not in stop])


def stemmer(stem: Callable[[str], str]) -> Filter:
    return Filter(None, lambda ts: [stem(t) for t in ts], stem)


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer and filters in order. Filters up to the first stemmer are column expressions; from there on they run in Python, once for each distinct word."""

    filters: tuple[Filter, ...] = (LOWERCASE, STRIP)
    tokenizer: Callable[[Column], Column] = tokenize
    splitter: Callable[[str], list[str]] = py_tokenize
    stems: tuple[Filter, ...] = field(init=False)

    def __post_init__(self) -> None:
        first = next((i for i, f in enumerate(self.filters) if f.stem is not None), len(self.filters))
        object.__setattr__(self, "stems", self.filters[first:])

    def column(self, text: Column) -> Column:
        """Tokens before stemming. Leading steps that can work on whole texts do, which costs far less than token by token."""
        steps, text = list(self.filters[: len(self.filters) - len(self.stems)]), F.coalesce(text, F.lit(""))
        while self.tokenizer is tokenize and steps and steps[0].text is not None:
            text = steps.pop(0).text(text)
        out = self.tokenizer(text)
        for step in steps:
            out = step.column(out)
        return out

    def __call__(self, text: str) -> list[str]:
        out = self.splitter(text)
        for step in self.filters:
            out = step.words(out)
        return out

    def stem(self, word: str) -> str | None:
        """What the steps from the first stemmer on make of a word; None if they drop it."""
        out = [word]
        for step in self.stems:
            out = step.words(out)
        return out[0] if out else None


def default_analyzer() -> Analyzer:
    return Analyzer()


def english_analyzer() -> Analyzer:
    from lodestone.functions.stemmers import porter

    return Analyzer((LOWERCASE, STRIP, stop_words(ENGLISH_STOP_WORDS), stemmer(porter)))


def fuzzy_analyzer() -> Analyzer:
    """For engines that expand words to near ones: the default steps, so that distances are those of whole words."""
    return Analyzer()


def bilingual_analyzer() -> Analyzer:
    from lodestone.functions.stemmers import porter, russian

    return Analyzer((LOWERCASE, STRIP, stop_words(ENGLISH_STOP_WORDS), stop_words(RUSSIAN_STOP_WORDS), stemmer(porter), stemmer(russian)))
