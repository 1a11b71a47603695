"""Analyzers: text column to an array of terms.

An analyzer is a function of a column expression.  ``simple`` and the stop-word analyzers stay in the JVM;
stemming is a Pandas UDF that stems each distinct word of a batch once.  Register more with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import stemmer, stemmers
from .scoring import MAX_TERM

WORD = r"[\p{L}\p{N}]+"
#: Words joined by hyphens give the whole and its parts.
HYPHENATED = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+|[\p{L}\p{N}]+"

Analyzer = Callable[[Column], Column]


def simple(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null stays null; terms above MAX_TERM characters are ignored."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)
    return F.filter(words, lambda w: F.length(w) <= MAX_TERM)


def with_stop_words(stop: frozenset[str]) -> Analyzer:
    # becomes one look-up in a hash set for each word
    listed = sorted(stop)
    return lambda text: F.filter(simple(text), lambda w: ~w.isin(listed))


_WORDS = regex.compile(HYPHENATED)
_SIMPLE = regex.compile(WORD)


LANGUAGES: dict[str, tuple[frozenset[str], Callable[[str], str]]] = {
    "english": (stemmer.ENGLISH_STOP, stemmer.english),
    "french": (stemmers.FRENCH_STOP, stemmers.french),
    "german": (stemmers.GERMAN_STOP, stemmers.german),
    "spanish": (stemmers.SPANISH_STOP, stemmers.spanish),
}


def language_terms(language: str, text: str, memory: dict[str, str | None]) -> list[str]:
    """Stems in text order; ``memory`` keeps the stem of each word (None for stop words) from text to text."""
    stop, stem = LANGUAGES[language]
    out = []
    for m in _WORDS.finditer(text.lower()):
        whole = m[0]
        for w in ([whole, *whole.split("-")] if "-" in whole else [whole]):
            if w not in memory:
                memory[w] = None if w in stop or len(w) > MAX_TERM else stem(w)
            if memory[w]:
                out.append(memory[w])
    return out


def language_analyzer(language: str) -> Analyzer:
    """Stop words removed, the rest stemmed; hyphenated words give the whole and its parts."""

    @F.pandas_udf(ArrayType(StringType()))
    def stems(texts: pd.Series) -> pd.Series:
        memory: dict[str, str | None] = {}
        return texts.map(lambda t: None if t is None else language_terms(language, t, memory))

    return lambda text: stems(text)


ANALYZERS: dict[str, Analyzer] = {"simple": simple, **{n: language_analyzer(n) for n in LANGUAGES}, "english_stop": with_stop_words(stemmer.ENGLISH_STOP)}


#: The same analyses of a text that the caller holds, so that a single search needs no job for its query.
LITERAL: dict[str, Callable[[str], list[str]]] = {
    "simple": lambda text: [w for w in _SIMPLE.findall(text.lower()) if len(w) <= MAX_TERM],
    **{n: lambda text, n=n: language_terms(n, text, {}) for n in LANGUAGES},
    "english_stop": lambda text: [w for w in _SIMPLE.findall(text.lower()) if len(w) <= MAX_TERM and w not in stemmer.ENGLISH_STOP],
}


def register(name: str, analyzer: Analyzer) -> None:
    ANALYZERS[name] = analyzer
    LITERAL.pop(name, None)


def analyzer(name: str) -> Analyzer:
    """The analyzer of a (possibly qualified) configuration name."""
    short = name.rpartition(".")[2]
    if short not in ANALYZERS:
        raise ValueError(f'text search configuration "{name}" does not exist')
    return ANALYZERS[short]
