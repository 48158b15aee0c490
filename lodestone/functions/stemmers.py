"""Stemmers for English and Russian, and their application to a column of distinct terms."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile("[a-z]{3,}")


_SHAPES = str.maketrans({c: "v" if c in "aeiou" else c if c == "y" else "c" for c in "abcdefghijklmnopqrstuvwxyz"})


def _shape(word: str) -> str:
    """c or v for each letter a-z; y is a vowel after a consonant."""
    out = word.translate(_SHAPES)
    while (at := out.find("y")) >= 0:
        out = out[:at] + ("v" if at and out[at - 1] == "c" else "c") + out[at + 1 :]
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """consonant, vowel, consonant other than w, x and y"""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


#: Per step: by the letter that decides where to look, endings in the order in which they are tried, and what replaces them.
_STEP2 = {"a": "ational:ate tional:tion", "c": "enci:ence anci:ance", "e": "izer:ize", "l": "bli:ble alli:al entli:ent eli:e ousli:ous", "o": "ization:ize ation:ate ator:ate",
          "s": "alism:al iveness:ive fulness:ful ousness:ous", "t": "aliti:al iviti:ive biliti:ble", "g": "logi:log"}
_STEP3 = {"e": "icate:ic ative: alize:al", "i": "iciti:ic", "l": "ical:ic ful:", "s": "ness:"}
_STEP4 = {"a": "al", "c": "ance ence", "e": "er", "i": "ic", "l": "able ible", "n": "ant ement ment ent", "o": "ion ou", "s": "ism", "t": "ate iti", "u": "ous", "v": "ive", "z": "ize"}


def _replace(word: str, rules: str) -> str:
    for rule in rules.split(" "):
        ending, _, new = rule.partition(":")
        if ending and word.endswith(ending):
            return word[: -len(ending)] + new if _measure(word[: -len(ending)]) > 0 else word
    return word


def porter(word: str) -> str:
    """The Porter stem of a word of three or more letters a-z; any other word is its own stem."""
    if not _PLAIN.fullmatch(word):
        return word
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-3] + "i"
    elif w.endswith("s") and w[-2] != "s":
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _doubled(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if len(w) < 2:
        return w
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _STEP2.get(w[-2], "")) if len(w) > 1 else w
    w = _replace(w, _STEP3.get(w[-1], ""))
    if len(w) > 1:
        for ending in _STEP4.get(w[-2], "").split():
            if w.endswith(ending):
                stem = w[: -len(ending)]
                if ending == "ion" and not stem.endswith(("s", "t")):
                    continue
                if _measure(stem) > 1:
                    w = stem
                break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("l") and _doubled(w) and _measure(w) > 1:
        w = w[:-1]
    return w


def _endings(text: str) -> tuple[str, ...]:
    """Longest first: of two endings that both fit, one ends the other."""
    return tuple(sorted(text.split(), key=lambda e: (-len(e), e)))


_RU_VOWELS = "аеиоуыэюя"
_GERUND_A, _GERUND = _endings("в вши вшись"), _endings("ив ивши ившись ыв ывши ывшись")
_REFLEXIVE = _endings("сь ся")
_ADJECTIVE = _endings("ая ее ей ем ею ие ий им их ое ой ом ою ую ые ый ым ых юю яя его ему ими ого ому ыми")
_PARTICIPLE_A, _PARTICIPLE = _endings("вш ем нн щ ющ"), _endings("ивш ующ ывш")
_VERB_A = _endings("ем ет ете ешь й йте л ла ли ло н на нно но ны ть ют")
_VERB = _endings("ей ейте ен ена ено ены ил ила или ило им ит ите ить ишь уй уйте ует уют ую ыл ыла ыли ыло ым ыт ыть ю ят")
_NOUN = _endings("а ам ами ах е ев еи ей ем и ие ией ием ии ий ию ия иям иями иях й о ов ой ом у ы ь ье ью ья ю я ям ями ях")
_DERIVATION, _SUPERLATIVE = _endings("ост ость"), _endings("ейш ейше")


def _cut(word: str, region: int, endings: tuple[str, ...], after_a: bool = False) -> str | None:
    """The word without the first of the endings that lies in its region (and follows а or я)."""
    for ending in endings:
        at = len(word) - len(ending)
        if at >= region and word.endswith(ending) and (not after_a or (at > 0 and word[at - 1] in "ая")):
            return word[:at]
    return None


def russian(word: str) -> str:
    """A Russian stem; ё counts as е, and a word without Russian endings is returned in lower case."""
    w = word.lower().replace("ё", "е")
    n = len(w)
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_VOWELS), n)

    def region(start: int) -> int:
        return next((i + 2 for i in range(start, n - 1) if w[i] in _RU_VOWELS and w[i + 1] not in _RU_VOWELS), n)

    r2 = region(region(0))
    short = _cut(w, rv, _GERUND_A, True)
    if short is None:
        short = _cut(w, rv, _GERUND)
    if short is None:
        base = _cut(w, rv, _REFLEXIVE)
        base = w if base is None else base
        short = _cut(base, rv, _ADJECTIVE)
        if short is not None:
            part = _cut(short, rv, _PARTICIPLE_A, True)
            part = _cut(short, rv, _PARTICIPLE) if part is None else part
            short = short if part is None else part
        else:
            for endings, after_a in ((_VERB_A, True), (_VERB, False), (_NOUN, False)):
                short = _cut(base, rv, endings, after_a)
                if short is not None:
                    break
        short = base if short is None else short

    def drop(word: str, start: int, *endings: str) -> str:
        cut = _cut(word, start, endings)
        return word if cut is None else cut

    def single(word: str) -> str:
        return word[:-1] if word.endswith("нн") and len(word) - 2 >= rv else word

    short = single(drop(drop(short, rv, "и"), r2, *_DERIVATION))
    less = _cut(short, rv, _SUPERLATIVE)
    short = short if less is None else single(less)
    return drop(short, rv, "ь")


def stem_column(term: Column, stem: Callable[[str], str]) -> Column:
    """stem applied in Arrow batches; meant for distinct terms, not for every token of a corpus."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w))

    return run(term)
