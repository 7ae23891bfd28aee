"""Token keys, similarities, token shape scores and time formats as columns."""
from __future__ import annotations

from difflib import SequenceMatcher
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

from chorale.functions.text import as_col

# fixed values: units and technical token shapes
UNITS = [
    "mg", "ml", "kg", "lb", "oz", "ft", "in", "cm", "mm", "m", "km", "mph", "kph", "rpm", "hz", "khz", "mhz",
    "ghz", "mb", "gb", "tb", "kb", "bits", "bytes", "px", "dpi", "psi", "bar", "atm", "sku", "upc", "api", "sdk",
    "url", "uri", "css", "html", "xml", "json", "sql", "tcp", "udp", "http", "https", "ftp", "ssh", "version", "v",
    "model", "rev", "build", "id", "uuid", "guid", "usd", "eur", "gbp", "cad", "aud", "jpy", "cny", "inr", "btc",
    "eth", "ltc", "xrp", "ada", "dot", "roi", "kpi", "p&l", "ebitda", "q1", "q2", "q3", "q4", "h1", "h2", "fy",
    "cy", "ytd", "mtd", "qoq", "yoy", "mom", "wow",
]
TECHNICAL_SHAPES = [
    (1.0, r"(?i)v?\d+\.[\d\.]+(?:-[a-zA-Z0-9]+)?"),
    (1.0, r"[a-zA-Z]{1,4}-?\d{2,6}[a-zA-Z]?"),
    (1.0, r"[a-zA-Z0-9]{6,12}"),
    (0.9, r"[qQ]\d{1}-?\d{2,4}"),
    (0.8, r"\d+\.?\d*%"),
    (0.9, r"\d+\.?\d*\s*[a-zA-Z]{1,4}"),
    (0.9, r"(?i)\$\d+(?:,\d{3})*(?:\.\d{2})?|\d+\s*(?:usd|eur|gbp)"),
    (0.8, r"\d{3}-?\d{3}-?\d{4}"),
    (0.8, r"[a-zA-Z0-9._%-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    (0.7, r"https?://[^\s]+|www\.[^\s]+\.[a-zA-Z]{2,}"),
    (0.7, r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    (0.7, r"[0-9A-Fa-f]{2}[:-]?[0-9A-Fa-f]{2}[:-]?[0-9A-Fa-f]{2}[:-]?[0-9A-Fa-f]{2}[:-]?[0-9A-Fa-f]{2}[:-]?[0-9A-Fa-f]{2}"),
]


def word_key(c: Column | str) -> Column:
    """Lower case without punctuation; whole-number tokens lose leading zeros without an integer cast."""
    plain = F.regexp_replace(F.lower(F.trim(as_col(c))), r"[^\p{L}\p{N}_\s]", "")
    return F.regexp_replace(plain, r"^0+([0-9]+)$", "$1")


def edit_sim(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.split(F.lower(as_col(c)), r"[\s\-_]+"))


def set_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return set_jaccard(token_set(a), token_set(b))


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio; only for pairs that a join has already selected."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def fold_accents(c: pd.Series) -> pd.Series:
    def fold(x):
        return None if x is None else "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k))

    return c.map(fold)


def plain_term(c: Column | str) -> Column:
    cut = F.regexp_replace(F.lower(as_col(c)), r"[^\p{L}\p{N}_\s\-]", "")
    return fold_accents(F.trim(F.regexp_replace(cut, r"\s+", " ")))


def visual_sim(a: str, b: str, plain_a: str, plain_b: str) -> Column:
    """0.4 block ratio + 0.3 edit similarity on folded terms + 0.3 token overlap on the raw ones."""
    return seq_ratio(plain_a, plain_b) * 0.4 + edit_sim(plain_a, plain_b) * 0.3 + jaccard(a, b) * 0.3


def _rest(c: Column) -> Column:
    return F.substr(c, F.lit(2))


def case_score(c: Column | str) -> Column:
    c = as_col(c)
    upper, lower = r"\p{Lu}", r"\p{Ll}"
    all_upper = (c == F.upper(c)) & c.rlike(upper)
    all_lower = (c == F.lower(c)) & c.rlike(lower)
    return F.when(F.length(c) <= 1, 0.0).when(all_upper, 1.0).when(c.rlike("^" + upper) & _rest(c).rlike(lower), 0.9) \
        .when(_rest(c).rlike(upper) & c.rlike(lower), 0.8).when(all_lower & c.rlike(r"\p{Nd}|-"), 0.6) \
        .when(all_lower, 0.1).otherwise(0.3)


def technical_score(c: Column | str) -> Column:
    c = as_col(c)
    hits = [F.when(c.rlike(f"^(?:{p})$"), w).otherwise(0.0) for w, p in TECHNICAL_SHAPES]
    mix = F.when(c.rlike(r"\p{Nd}") & c.rlike(r"\p{L}"), 0.6).otherwise(0.0)
    hyphen = F.when(c.contains("-") & (F.length(c) > 3), 0.5).otherwise(0.0)
    return F.greatest(*hits, mix, hyphen)


def unit_score(token: Column | str, context: Column | str) -> Column:
    """1 for a unit itself, else by distance of each unit's first mention from the middle of the context."""
    low = F.transform(as_col(context), lambda w: F.lower(w))
    middle = F.floor(F.size(low) / 2)
    first = F.transform(low, lambda w, i: F.when(w.isin(UNITS) & (F.array_position(low, w) == i + 1), F.abs(i - middle)))
    near = F.array_min(F.array_compact(first))
    return F.when(F.lower(as_col(token)).isin(UNITS), 1.0).when(near.isNull(), 0.0).when(near <= 1, 0.8) \
        .when(near <= 2, 0.6).otherwise(0.4)


def term_type(c: Column | str) -> Column:
    c = as_col(c)
    upper, lower = r"\p{Lu}", r"\p{Ll}"
    return F.when((F.length(c) >= 2) & (c == F.upper(c)) & c.rlike(upper), "acronym") \
        .when(c.rlike("^" + upper) & _rest(c).rlike(lower), "proper_noun") \
        .when(c.rlike(r"\p{Nd}|-") | (_rest(c).rlike(upper) & c.rlike(lower)), "technical").otherwise("general")


def _hms(ms: Column) -> tuple[Column, Column, Column]:
    s = F.floor(ms / 1000)
    return F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60


def fmt_clock(ms: Column | str) -> Column:
    return F.format_string("%02d:%02d:%02d", *_hms(as_col(ms)))


def fmt_srt(ms: Column | str) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_hms(as_col(ms)), as_col(ms) % 1000)


def fmt_vtt(ms: Column | str) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", *_hms(as_col(ms)), as_col(ms) % 1000)


def fmt_ass(ms: Column | str) -> Column:
    """Centiseconds, rounded half up from milliseconds."""
    cs = F.floor((as_col(ms) + 5) / 10)
    h, m, s = _hms(cs * 10)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, cs % 100)


def fmt_duration(ms: Column | str) -> Column:
    h, m, s = _hms(as_col(ms))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)) \
        .otherwise(F.format_string("%ds", s))
