"""Typed entities: counts stay in the JVM, character spans come from an Arrow-batched finder."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_NUMBER_WORDS = ("zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen"
                 "|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand"
                 "|million|billion")
# fixed values: (type, pattern), matched without regard to case
PATTERNS = [
    ("phone_number", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("phone_number", r"\b\(\d{3}\)\s?\d{3}[-.]?\d{4}\b"),
    ("phone_number", r"\b\+\d{1,3}\s?\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("currency", r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?"),
    ("currency", r"\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?dollars?\b"),
    ("currency", r"\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?USD\b"),
    ("percentage", r"\b\d{1,3}(?:\.\d{1,2})?\s?%\b"),
    ("percentage", r"\b\d{1,3}(?:\.\d{1,2})?\s?percent\b"),
    ("date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("date", rf"\b{_MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b"),
    ("date", rf"\b\d{{1,2}}\s+{_MONTHS}\s+\d{{4}}\b"),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2})?\s?(?:AM|PM|am|pm)?\b"),
    ("time", r"\b(?:at\s+)?\d{1,2}\s?(?:o'clock|oclock)\b"),
    ("number", r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"),
    ("number", rf"\b(?:{_NUMBER_WORDS})\b"),
    ("alphanumeric_code", r"\b[A-Z]\d+[A-Z]?\b"),
    ("alphanumeric_code", r"\b\d+[A-Z]+\d*\b"),
    ("alphanumeric_code", r"\b[A-Z]{2,}\d{2,}\b"),
]
#: Pieces of pattern and the small piece of text without which it cannot match; any pattern with \\d needs a digit.
_PIECES = {"@": "@", r"\$": "$", "dollars": "dollar", "USD": "usd", "%\\b": "%", "percent": "percent", "clock": "cloc", r"\d{1,2}:": ":", r"\(": "(", r"\b\+": "+"}
#: Letters that match a letter of another form without regard to case.
_ODD = frozenset("\u0130\u0131\u017f\u212a")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
CONTEXT_WORDS = {
    "phone_number": ["call", "phone", "number", "contact", "reach"],
    "currency": ["cost", "price", "pay", "spend", "budget", "revenue"],
    "percentage": ["rate", "growth", "increase", "decrease", "percent"],
}
# the second, first-match set used when words are fused
_OPEN, _SHUT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_MONTH_WORDS = "january|february|march|april|may|june|july|august|september|october|november|december"
FUSION_TYPES = [
    ("number", rf"{_OPEN}\d+(?:\.\d+)?{_SHUT}"),
    ("date", rf"(?i){_OPEN}(?:{_MONTH_WORDS}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}-\d{{1,2}}-\d{{2,4}}){_SHUT}"),
    ("time", rf"(?i){_OPEN}\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s*[ap]m)?{_SHUT}"),
    ("money", rf"(?i)\$\d+(?:,\d{{3}})*(?:\.\d{{2}})?|{_OPEN}\d+\s*dollars?{_SHUT}"),
    ("percentage", rf"{_OPEN}\d+(?:\.\d+)?%[\p{{L}}\p{{N}}_]"),
    ("phone", rf"{_OPEN}\d{{3}}-\d{{3}}-\d{{4}}{_SHUT}"),
    ("proper_name", rf"{_OPEN}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*{_SHUT}"),
]


def entity_matches(df: DataFrame, text: str = "text", patterns=PATTERNS) -> DataFrame:
    """One row per match, with its type, without positions.  A pattern with \\d must not match without a digit."""
    def found(p: str):
        all_ = F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0))
        return F.when(F.col("_digit"), all_) if r"\d" in p else F.when(F.contains(F.col(text), F.lit("@")), all_) if "@" in p else all_

    rows = F.array(*[F.struct(F.lit(kind).alias("entity_type"), found(p).alias("found")) for kind, p in patterns])
    keep = [c for c in df.columns if c != text]
    d = df.withColumn("_digit", F.col(text).rlike("[0-9]"))
    return d.select(*keep, F.inline(rows)).select(*keep, "entity_type", F.explode("found").alias("entity"))


def fusion_type(c):
    col, out = F.col(c) if isinstance(c, str) else c, F
    for kind, p in FUSION_TYPES:
        out = out.when(col.rlike(p), kind)
    return out


def entity_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Matches with character offsets and the context-checked validation score.

    A pattern is tried only on texts that hold a digit, a piece or a word without which it cannot match.
    """
    words = frozenset(_NUMBER_WORDS.split("|"))
    compiled = [(kind, re.compile(p, re.IGNORECASE), r"\d" in p, [piece for part, piece in _PIECES.items() if part in p], _NUMBER_WORDS in p) for kind, p in PATTERNS]

    @F.pandas_udf("array<struct<entity_type:string,entity:string,start_char:int,end_char:int,validation:double>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            out = []
            if not t:
                return out
            low = t.casefold()
            odd = not t.isascii() and not _ODD.isdisjoint(t)
            digit, named = _DIGIT.search(t), odd or not words.isdisjoint(_WORD.findall(low))
            for kind, rx, by_digit, pieces, by_word in compiled:
                if by_digit and not digit or by_word and not named or not odd and any(x not in low for x in pieces):
                    continue
                for m in rx.finditer(t):
                    before = t[max(0, m.start() - 20):m.start()].lower()
                    score = 0.5
                    if any(w in before for w in CONTEXT_WORDS.get(kind, ())):
                        score += 0.3
                    if kind == "phone_number" and sum(ch.isdigit() for ch in m.group()) == 10:
                        score += 0.2
                    out.append({"entity_type": kind, "entity": m.group(), "start_char": m.start(), "end_char": m.end(),
                                "validation": min(1.0, score)})
            return out

        return texts.map(one)

    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.inline(find(text)))
