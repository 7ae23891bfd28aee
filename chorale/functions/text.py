"""Text columns: tokens, sentences, adjacent pairs, and counts over them.  All JVM expressions, one row per text."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

PUNCT = ".,!?;:"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_of(c: Column | str) -> Column:
    return F.split(F.trim(F.regexp_replace(as_col(c), r"\s+", " ")), " ")


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(PUNCT)))


def bare(w: Column) -> Column:
    return F.regexp_replace(w, NOT_WORD, "")


def sentences_of(c: Column | str) -> Column:
    parts = F.transform(F.split(as_col(c), r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: s != "")


def n_words(sentence: Column) -> Column:
    return F.size(F.split(sentence, " "))


def count_if(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))


def pairs_if(items: Column, test: Callable[[Column, Column], Column], step: int = 1) -> Column:
    """How many items and their ``step``-th successor satisfy ``test``."""
    flags = F.zip_with(items, F.slice(items, 1 + step, F.greatest(F.size(items), F.lit(1))), lambda a, b: test(a, b))
    return F.size(F.filter(flags, lambda f: f))


def within(words: Iterable[str]) -> Callable[[Column], Column]:
    vocabulary = sorted(words)
    return lambda w: w.isin(vocabulary)


def regexp_n(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(as_col(c), F.lit(pattern))


def literal_n(c: Column | str, piece: str) -> Column:
    c = as_col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def moments(numbers: Column) -> Column:
    """(n, s, q): count, sum and sum of squares in one pass; no aggregate is ever nested in a lambda."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(numbers, zero, lambda a, x: F.struct(
        (a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))


def mean(m: str) -> Column:
    return F.col(f"{m}.s") / F.col(f"{m}.n")


def std(m: str) -> Column:
    n, s, q = (F.col(f"{m}.{x}") for x in "nsq")
    return F.sqrt(F.greatest(F.lit(0.0), n * q - s * s)) / n


def band(x: Column, low: float, high: float, floor: float, centre: float, slope: float) -> Column:
    """1 inside the band, falling off linearly around ``centre`` outside it, never below ``floor``."""
    return F.when(x.between(low, high), 1.0).otherwise(F.greatest(F.lit(floor), 1.0 - F.abs(x - centre) * slope))


def spaced(c: Column | str) -> Column:
    """Separators doubled, so that neighbouring words need not share one when phrases are counted."""
    return F.concat(F.lit(" "), F.regexp_replace(as_col(c), f"({NOT_WORD})", "$1$1"), F.lit(" "))


def phrases_n(spaced_text: Column | str, phrases: Iterable[str]) -> Column:
    """Occurrences of whole words or phrases in a ``spaced`` text."""
    return F.regexp_count(as_col(spaced_text), F.lit(phrase_pattern(phrases)))


def phrase_pattern(phrases: Iterable[str]) -> str:
    return f"{NOT_WORD}(?:" + "|".join(p.replace(" ", "  ") for p in phrases) + f"){NOT_WORD}"
