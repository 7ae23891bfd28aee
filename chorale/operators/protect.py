"""Protected spans: identifiers, doses, versions, dates and terms that normalisation must leave as they are.

Matches of every pattern are weighted by the category's priority, the match's confidence and the pattern's quality.  Matches that overlap
become one span over all of them, named by the heaviest, so no part of a match is left open.  Normalisation then works on a text
in which each span is one mark, and the spans are put back in order: only the gaps between spans are rewritten.

Patterns see a text of the same length in which letters and digits beyond ASCII are ``x`` and other characters beyond ASCII are spaces (the signs that
patterns name are kept), so word borders are the same in every engine.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import zip_longest
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.text import NOT_WORD, as_col
from chorale.operators import corpus

# fixed values: category -> priority, patterns
CATEGORIES: dict[str, tuple[int, list[str]]] = {
    "legal_cases": (100, [r"\b[0-9]{4,8}/[0-9]{4}\b", r"\b[0-9]{2,6}-[0-9]{2,4}-[0-9]{2,8}\b", r"\bNo\.\s*[0-9]{4,8}\b", r"\b[A-Z]{2,4}-[0-9]{4,8}\b", r"\b[0-9]{4}\s*[A-Z]{2,4}\s*[0-9]{4,6}\b"]),
    "doses_units": (95, [
        r"\b[0-9]+\.?[0-9]*\s*mg\b", r"\b[0-9]+\.?[0-9]*\s*ml\b", r"\b[0-9]+\.?[0-9]*\s*g\b", r"\b[0-9]+,?[0-9]*\s*IU\b", r"\b[0-9]+\.?[0-9]*\s*mcg\b", r"\b[0-9]+\.?[0-9]*\s*cc\b",
        r"\b[0-9]+\.?[0-9]*\s*units?\b", r"\b[0-9]+\.?[0-9]*\s*μg\b", r"\b[0-9]+\.?[0-9]*\s*kg\b", r"\b[0-9]+\.?[0-9]*\s*lb\b", r"\b[0-9]+\.?[0-9]*\s*oz\b",
    ]),
    "mixed_alphanumeric": (90, [
        r"\b[A-Z]{2}-[0-9]{4}\b", r"\b[0-9][A-Z][0-9]-[0-9]\b", r"\b[A-Z][0-9]{1,2}[A-Z]-[0-9]{2}\b", r"\b[A-Z]{2,6}-[0-9]{2,4}\b", r"\b[0-9]{1,3}-[A-Z]{2}-[0-9]{2}\b", r"\b[A-Z]{2,4}[0-9]{2,6}\b",
        r"\b[0-9]{2,4}[A-Z]{2,4}\b", r"\b[A-Z][0-9]{2,4}[A-Z]{2,4}\b", r"\b[A-Z]{1,3}[0-9]{1,4}[A-Z]{1,3}[0-9]{1,4}\b",
    ]),
    "versions": (85, [r"\bv[0-9]+\.[0-9]+\.[0-9]+\b", r"\bV[0-9]+\.[0-9]+\.[0-9]+\b", r"\b[0-9]+\.[0-9]+\.[0-9]+\b", r"\bversion\s+[0-9]+\.[0-9]+\b", r"\brel\s+[0-9]+\.[0-9]+\b", r"\bbuild\s+[0-9]+\b"]),
    "date_codes": (80, [r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b", r"\bQ[1-4]-[0-9]{2}\b", r"\b[0-9]{2}Q[1-4]\b", r"\bFY[0-9]{2,4}\b", r"\b[A-Z]{3}[0-9]{2,4}\b"]),
    "acronyms": (75, [r"\b[A-Z]{2,6}\b", r"\b[A-Z][0-9]+[A-Z]*\b", r"\b[A-Z]{1,3}[0-9]{1,4}\b", r"\b[A-Z]+[-_][A-Z0-9]+\b"]),
    "technical_terms": (70, [r"\b[a-z]+\.[a-z]+\b", r"\b[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*\b", r"\b\w+@\w+\.\w+\b", r"\b#\w+\b", r"\b@\w+\b"]),
    "numbers": (60, [r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b", r"\b\d+(?:\.\d+)?[%$€£¥]\b", r"\b\d+[a-zA-Z]{1,3}\b", r"\b\d+[-/]\d+[-/]\d+\b"]),
}
#: Categories whose spans must come through a rewriting exactly.
EXACT = ("legal_cases", "doses_units", "mixed_alphanumeric", "versions")
SPECIFIC, BOUNDED, STRUCTURED = 0.4, 0.3, 0.3
#: Signs of structure in a pattern, and characters outside ASCII that patterns name, with the stand-ins both engines see.
STRUCTURE = ["-", ".", "/", r"\s+", r"\d+", "[A-Z]+", "[0-9]+"]
NAMED, STAND_INS = "μ€£¥", "\x01\x02\x03\x04"
MARK = "\ue000"
SPANS = "array<struct<start:int,end:int,category:string,categories:string,matches:int,score:double>>"


def quality(pattern: str) -> float:
    """How specific, bounded and structured a pattern is, 0 to 1."""
    edge = r"\b" in pattern
    specific = 0.5 + 0.2 * ("[A-Z]" in pattern or "[0-9]" in pattern) + 0.2 * edge + 0.1 * ("{" in pattern)
    bounded = 1.0 if pattern.startswith(r"\b") and pattern.endswith(r"\b") else 0.7 if edge else 0.5
    structured = 0.5 + min(0.5, 0.1 * sum(sign in pattern for sign in STRUCTURE))
    return min(1.0, SPECIFIC * specific + BOUNDED * bounded + STRUCTURED * structured)


class Rule(NamedTuple):
    category: str
    priority: int
    pattern: str  # as both engines run it
    quality: float


def rules() -> list[Rule]:
    return [Rule(category, priority, p.translate(str.maketrans(NAMED, STAND_INS)), quality(p)) for category, (priority, patterns) in CATEGORIES.items() for p in patterns]


@cache
def compiled() -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(r.pattern, re.ASCII)) for r in rules()]


FOREIGN = re.compile(r"[^\x00-\x7f]")

@cache
def without_figures() -> list[tuple[int, Rule, re.Pattern]]:
    """The rules that can match a text without a digit, with their places."""
    figure = re.compile(r"\[0-9\](?!\*)|\\d")
    return [(at, r, c) for at, (r, c) in enumerate(compiled()) if not figure.search(r.pattern)]


FIGURES, CAPITALS = re.compile("[0-9]+"), re.compile("[A-Z]+")


class Search(NamedTuple):
    at: int
    rule: Rule
    pattern: re.Pattern
    starts: re.Pattern | None  # every match starts where one of its runs does, at a word border
    hint: re.Pattern | None  # found wherever the pattern is


@cache
def searches() -> list[Search]:
    """How the matches of each rule are looked for without trying its pattern at every letter."""
    out = []
    for at, (rule, pattern) in enumerate(compiled()):
        begins = rule.pattern.removeprefix(r"\b")
        starts = FIGURES if begins.startswith(("[0-9]", r"\d")) else CAPITALS if begins.startswith("[A-Z]") else None
        # what a pattern that begins with small letters or any word is told by stands after them
        hint = None if starts else re.compile(re.sub(r"^(\[a-z\]|\\w)\+", "", begins), re.ASCII)
        out.append(Search(at, rule, pattern, starts if rule.pattern.startswith(r"\b") else None, hint))
    return out


def matches(search: Search, seen: str, places: list[int]) -> Iterator[re.Match]:
    """The matches that ``finditer`` gives; ``places``: where runs of the rule's first letters start at a word border."""
    if search.starts is None:
        if search.hint is None or search.hint.search(seen):
            yield from search.pattern.finditer(seen)
        return
    end = 0
    for place in places:
        if place >= end and (m := search.pattern.match(seen, place)):
            yield m
            end = m.end()


def plain(text: str) -> str:
    """The text as patterns see it: same length, ASCII only."""
    if text.isascii():
        return text
    foreign = {c for c in set(text) if c > "\x7f"}
    if len(foreign) < 50:  # a pass for each sign is shorter than a call for each place
        for c in foreign:
            text = text.replace(c, STAND_INS[NAMED.index(c)] if c in NAMED else "x" if c.isalnum() else " ")
        return text
    named = str.maketrans(NAMED, STAND_INS)
    return FOREIGN.sub(lambda m: "x" if m[0].isalnum() else " ", text.translate(named))


def spans_in(text: str | None) -> list[tuple[int, int, str, str, int, float]]:
    """Disjoint spans in order: start, end, heaviest category, all categories, matches, weight."""
    if not text:
        return []
    seen = plain(text)
    found = []
    borders = {runs: [a for m in runs.finditer(seen) if not (a := m.start()) or not (seen[a - 1].isalnum() or seen[a - 1] == "_")] for runs in (FIGURES, CAPITALS)}
    for search in searches():
        at, rule = search.at, search.rule
        for m in matches(search, seen, borders.get(search.starts, [])):
            a, b = m.span()
            size, token = b - a, seen[a:b]
            sure = rule.quality * (0.8 if size < 3 else 0.9 if size > 20 else 1.0)
            sure *= 0.9 if a and seen[a - 1].isalnum() else 1.0
            sure *= 0.9 if b < len(seen) and seen[b].isalnum() else 1.0
            if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
                sure *= 1.1
            found.append((a, b, at, rule.category, round(rule.priority * 0.5 + min(1.0, sure) * 30 + rule.quality * 20, 6)))
    found.sort()
    out: list[tuple[int, int, str, str, int, float]] = []
    i = 0
    while i < len(found):
        j, end = i + 1, found[i][1]
        while j < len(found) and found[j][0] < end:
            end = max(end, found[j][1])
            j += 1
        group = found[i:j]
        best = min(group, key=lambda x: (-x[4], *x[:3]))
        out.append((group[0][0], end, best[3], "+".join(sorted({x[3] for x in group})), j - i, best[4]))
        i = j
    return out


def with_spans(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with the spans of each text as an array; a null text has none."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "end", "category", "categories", "matches", "score"), s, strict=True)) for s in spans_in(t)])

    return df.withColumn(name, find(as_col(text)))


def protected_spans(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a span: keys, start, end (code points), token, category, categories, matches, score."""
    rows = with_spans(df, text).select(*keys, as_col(text).alias("_t"), F.explode("spans").alias("s"))
    return rows.select(*keys, "s.start", "s.end", F.substring("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("token"), "s.category", "s.categories", "s.matches", "s.score")


def masked_text(t: str | None) -> tuple[str | None, list[str]]:
    """The text with one mark for each span, and what the marks stand for; a mark of the text itself is held too."""
    pieces, kept, at = [], [], 0
    for start, end, *_ in spans_in(t):
        gap = (t[at:start]).split(MARK)
        pieces += gap
        kept += [MARK] * (len(gap) - 1) + [t[start:end]]
        at = end
    gap = (t or "")[at:].split(MARK)
    pieces += gap
    kept += [MARK] * (len(gap) - 1)
    return None if t is None else MARK.join(pieces), kept


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``masked``, the text with one mark for each span, and ``held``, what the marks stand for; a mark of the text itself is held too."""

    @F.pandas_udf("struct<masked:string,held:array<string>>")
    def hide(texts: pd.Series) -> pd.DataFrame:
        masked, held = zip(*map(masked_text, texts)) if len(texts) else ((), ())
        return pd.DataFrame({"masked": masked, "held": held})

    return df.withColumn("_m", hide(as_col(text))).select(*df.columns, "_m.masked", "_m.held")


def restore(masked: Column | str, held: Column | str) -> Column:
    """The text with the spans back in the places of the marks."""
    gaps = F.split(as_col(masked), MARK)
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(as_col(held), F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")


def normalize_protected(df: DataFrame, profile: str, text: str = "text") -> DataFrame:
    """``corpus.normalize_corpus`` with protected spans left as they are, and ``protected``, their number."""
    d = mask(df, text)
    done = corpus.normalize_corpus(d, profile, "masked")
    count = lambda c: F.size(F.split(corpus.tidy_spaces(as_col(c)), " "))
    done = done.withColumn("normalized", restore("normalized", "held"))
    return done.select(*df.columns, "profile", "normalized", count(text).alias("words_before"), count("normalized").alias("words_after"), F.size("held").alias("protected"))


SPACE = r"[ \t\n\x0b\f\r]"  # what \s is in the engine; \W is what it calls neither letter nor figure nor underscore


def either_case(rule: str) -> re.Pattern:
    """A rule of ``corpus`` as the engine reads it: without regard to the case of ASCII letters only."""
    literal = re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", rule.removeprefix("(?i)").replace(NOT_WORD, "\0").replace(r"\s", "\1"))
    return re.compile(literal.replace("\0", r"\W").replace("\1", SPACE))


@cache
def fillers() -> dict[str, tuple[re.Pattern, Callable]]:
    """The filler rules, and what a lowered text must hold to match one."""
    twice, single, any_one = (re.compile(rf"{p}(?!\w)(?<!\w{'.' * n})") for p, n in (("(?:um|uh|er|ah) (?:um|uh|er|ah)", 5), ("(?:um|uh)", 2), ("(?:um|uh|er|ah)", 2)))
    any_of = {"double": twice.search, "single": single.search, "all": any_one.search, "phrases": lambda low: "you know" in low or "i mean" in low}
    return {name: (either_case(rule), any_of[name]) for name, rule in corpus.FILLER_RULES.items()}


COMMA = re.compile(corpus.COMMA_RULE.replace(r"\s]", " \t\n\x0b\f\r]").replace(r"\s", SPACE))
STOPS, NOT_A_WORD = re.compile("[.!?]+"), re.compile(r"\W")
NAME_SET, NUMBER_SET, EMPHASIS_SET = frozenset(corpus.NAMES), frozenset(corpus.NUMBER_WORDS), frozenset(corpus.EMPHASIS)


def words_of(t: str) -> list[bytes]:
    """Words between the white space that the engine's \\s knows."""
    return t.encode().split()


def tidy(t: str) -> str:
    return b" ".join(words_of(t)).decode()


def capitalised(t: str) -> str:
    return t[:1].upper() + t[1:]


def without_fillers(t: str, rules: Sequence[str]) -> str:
    """A tidy text without the matches of ``rules``, each taken twice."""
    for name in rules:
        rule, possible = fillers()[name]
        if possible(t.lower()) and (once := rule.sub(r"\1\2", t)) != t:
            t = tidy(rule.sub(r"\1\2", once))
    return t


def rewritten(t: str, p: dict) -> str:
    """What a profile makes of a tidy text without fillers; it stays tidy throughout."""
    if p["repeats"] or p["names"] or p["numbers"]:
        words, low = t.split(" "), t.lower().split(" ")
        if p["repeats"]:
            gone = {i for i, (a, b) in enumerate(zip(low, low[1:]), 1) if a == b and b not in EMPHASIS_SET and not NOT_A_WORD.search(words[i])}
            if gone:
                words, low = ([w for i, w in enumerate(x) if i not in gone] for x in (words, low))
        if p["numbers"] and not NUMBER_SET.isdisjoint(words):
            words = [corpus.NUMBER_WORDS.get(w, w) for w in words]
        if p["names"] and not NAME_SET.isdisjoint(low):
            words = [capitalised(x) if x in NAME_SET else w for w, x in zip(words, low)]
        t = " ".join(words)
    if p["commas"] and (" and " in t or " but " in t or " or " in t):
        t = COMMA.sub(r"\1, \2 ", t)
    if p["quotes"]:
        t = t.replace("“", '"').replace("”", '"').replace("‘", "'").replace("’", "'")
    if p["sentences"]:
        t = ". ".join(capitalised(s) for part in STOPS.split(t) if (s := part.strip(" ")))
    return t


def profiles_of(t: str | None, profiles: Sequence[str]) -> list[tuple[str | None, int | None, int | None, int]]:
    """Of each profile: the text with its spans left as they are, words before and after, spans."""
    masked, held = masked_text(t)
    if t is None:
        return [(None, None, None, 0)] * len(profiles)
    start, before, known, out = tidy(masked), max(1, len(words_of(t))), {}, []
    for name in profiles:
        p = corpus.PROFILES[name]
        open_text = without_fillers(start, p["fillers"])
        key = open_text, *(p[k] for k in ("repeats", "names", "numbers", "commas", "quotes", "sentences"))  # two profiles often do the same to a text
        if key not in known:
            done = "".join(x for pair in zip_longest(rewritten(open_text, p).split(MARK), held, fillvalue="") for x in pair)
            known[key] = done, max(1, len(words_of(done)))
        done, after = known[key]
        out.append((done, before, after, len(held)))
    return out


#: Characters of texts whose profiles a task holds at a time.
BLOCK_CHARS = 4_000_000


def normalize_protected_profiles(df: DataFrame, keys: list[str], profiles: Sequence[str], text: str = "text") -> DataFrame:
    """``normalize_protected`` of several profiles, keys only: spans are looked for once a text, and what profiles share is done once."""
    profiles = list(profiles)
    names = [*keys, "profile", "normalized", "words_before", "words_after", "protected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            block = pc.cumulative_sum(pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())).to_numpy() // BLOCK_CHARS
            cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                rows = [(name, *values) for t in texts.slice(lo, hi - lo).to_pylist() for name, values in zip(profiles, profiles_of(t, profiles))]
                at = pa.array(np.repeat(np.arange(lo, hi), len(profiles)))
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))], names)

    given = df.select(*keys, as_col(text).alias("_t"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, profile string, normalized string, words_before int, words_after int, protected int")
