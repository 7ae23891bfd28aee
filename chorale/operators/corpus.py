"""Corpus jobs: normalisation profiles, guardrail audit of text pairs, and punctuation / disfluency levels.

Everything is a row-wise column pipeline (no shuffle before the final roll-ups), over whole texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chorale import words as W
from chorale.functions.text import NOT_WORD, as_col, moments, mean, n_words, phrases_n, regexp_n, sentences_of, spaced

# fixed values: profile -> fillers, repeats, commas, sentence capitals, proper nouns, small numbers, quotes, change limit
PROFILES = {
    "verbatim": dict(fillers=[], repeats=False, commas=False, sentences=False, names=False, numbers=False, quotes=False, limit=0.02),
    "light": dict(fillers=["double"], repeats=False, commas=False, sentences=True, names=True, numbers=False, quotes=True, limit=0.05),
    "readable": dict(fillers=["double", "single"], repeats=True, commas=True, sentences=True, names=True, numbers=True, quotes=True, limit=0.10),
    "executive": dict(fillers=["double", "all", "phrases"], repeats=True, commas=True, sentences=True, names=True, numbers=True, quotes=True, limit=0.15),
}
FILLER_RULES = {
    "double": rf"(?i)(^|{NOT_WORD})(?:um|uh|er|ah)\s+(?:um|uh|er|ah)({NOT_WORD}|$)",
    "single": rf"(?i)(^|{NOT_WORD})(?:um|uh)({NOT_WORD}|$)",
    "all": rf"(?i)(^|{NOT_WORD})(?:um|uh|er|ah)({NOT_WORD}|$)",
    "phrases": rf"(?i)(^|{NOT_WORD})(?:you\s+know|I\s+mean)({NOT_WORD}|$)",
}
COMMA_RULE = r"([^,.!?;:\s])\s+(and|but|or)\s+"
# fixed values
NAMES = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march",
    "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
NUMBER_WORDS = {"1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten"}
EMPHASIS = ["very", "really", "so"]
READABILITY = {"sentence_length": 0.2, "punctuation_density": 0.15, "disfluency_ratio": 0.25, "capitalization_consistency": 0.15,
               "technical_term_preservation": 0.15, "flow_continuity": 0.1}
NEGATIONS = ["not", "no", "never", "none", "nothing", "nobody", "nowhere"]
QUANTIFIERS = ["all", "every", "each", "some", "any", "many", "few", "several"]
CONNECTORS = ["but", "however", "although", "unless", "because", "since"]


def tidy_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def drop_twice(c: Column, rule: str, keep: str = "$1$2") -> Column:
    """Neighbouring matches share a separator, so the second pass takes those the first one stepped over."""
    return F.regexp_replace(F.regexp_replace(c, rule, keep), rule, keep)


def drop_repeats(words: Column, keep: list[str] = EMPHASIS) -> Column:
    """Drop a bare word equal to the word before it, emphasis words excepted."""
    low = F.transform(words, lambda w: F.lower(w))
    both = F.zip_with(words, F.concat(F.array(F.lit(None).cast("string")), F.slice(low, F.lit(1), F.greatest(F.size(low) - 1, F.lit(0)))),
                      lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    left = F.filter(both, lambda x: ~F.coalesce((F.lower(x["w"]) == x["p"]) & ~x["w"].rlike(NOT_WORD) & ~x["p"].isin(keep), F.lit(False)))
    return F.transform(left, lambda x: x["w"])


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def normalize_corpus(df: DataFrame, profile: str, text: str = "text") -> DataFrame:
    """One profile over a corpus: ``normalized`` plus audit columns; the change limit is reported by the guardrails."""
    p = PROFILES[profile]
    d = df.withColumn("_t", tidy_spaces(as_col(text))).withColumn("_n", F.size(F.split("_t", " ")))
    for rule in p["fillers"]:
        # a tidy text without a match is as it was
        d = d.withColumn("_u", F.regexp_replace("_t", FILLER_RULES[rule], "$1$2")).withColumn("_t", F.when(F.col("_u") == F.col("_t"), F.col("_t")).otherwise(
            tidy_spaces(F.regexp_replace("_u", FILLER_RULES[rule], "$1$2")))).drop("_u")
    if p["repeats"] or p["names"] or p["numbers"]:  # the text is lowered once, not word by word
        d = d.withColumn("_l", F.split(F.lower("_t"), " ")).withColumn("_w", F.zip_with(F.split("_t", " "), "_l", lambda w, low: F.struct(w.alias("w"), low.alias("l"))))
        if p["repeats"]:
            d = d.withColumn("_w", F.filter("_w", lambda x, i: ~F.coalesce((x["l"] == F.get("_l", i - 1)) & ~x["w"].rlike(NOT_WORD) & ~x["l"].isin(EMPHASIS), F.lit(False))))

        def word(x: Column) -> Column:
            out = x["w"]
            if p["numbers"]:
                spelled = F
                for k, v in NUMBER_WORDS.items():
                    spelled = spelled.when(x["w"] == k, v)
                out = F.when(F.length(x["w"]) <= 2, spelled.otherwise(x["w"])).otherwise(out)
            return F.when(x["l"].isin(NAMES), capitalise(x["l"])).otherwise(out) if p["names"] else out

        d = d.withColumn("_t", F.array_join(F.transform("_w", word), " "))
    if p["commas"]:
        d = d.withColumn("_t", F.regexp_replace("_t", COMMA_RULE, "$1, $2 "))
    if p["quotes"]:
        d = d.withColumn("_t", F.regexp_replace(F.regexp_replace("_t", "[“”]", '"'), "[‘’]", "'"))
    if p["sentences"]:
        d = d.withColumn("_s", sentences_of("_t")).withColumn("_t", F.array_join(F.transform("_s", capitalise), ". ")).drop("_s")
    return d.select(*df.columns, F.lit(profile).alias("profile"), F.col("_t").alias("normalized"), F.col("_n").alias("words_before"),
                    F.size(F.split(tidy_spaces(F.col("_t")), " ")).alias("words_after"))


def readability(df: DataFrame, text: str, name: str) -> DataFrame:
    """Weighted sum of sentence length, punctuation density, fillers, capitals, protected terms and flow."""
    d = df.withColumn("_s", sentences_of(text)).withColumn("_m", moments(F.transform("_s", n_words))).withColumn("_w", F.split(tidy_spaces(as_col(text)), " "))
    n = F.size("_w")
    d = d.withColumn("_l", F.transform(F.filter("_w", lambda w: F.length(w) > 3), lambda w: F.lower(w))).withColumn(
        "_f", phrases_n(spaced(F.lower(text)), ["um", "uh", "er", "ah", "like", "you know", "i mean"]))
    some = F.size("_s") > 0
    zero = F.lit(0.0)
    parts = {
        "sentence_length": F.when(some, F.greatest(zero, 1.0 - F.abs(mean("_m") - 17.5) / 17.5)).otherwise(0.5),
        "punctuation_density": F.greatest(zero, 1.0 - F.abs(regexp_n(text, "[.!?,:;]") / n - 0.1) / 0.1),
        "disfluency_ratio": F.greatest(zero, 1.0 - F.col("_f") / n * 5),
        "capitalization_consistency": F.when(some, F.size(F.filter("_s", lambda s: s.rlike(r"^\p{Lu}"))) / F.greatest(F.size("_s"), F.lit(1))).otherwise(0.5),
        "technical_term_preservation": F.when(regexp_n(text, rf"{NOT_WORD}[A-Z0-9]{{2,}}{NOT_WORD}") > 0, 1.0).otherwise(0.8),
        "flow_continuity": F.greatest(zero, 1.0 - (F.size("_l") - F.size(F.array_distinct("_l"))) / n * 2),
    }
    total = zero
    for k, w in READABILITY.items():
        total = total + parts[k] * w
    return d.withColumn(name, total).drop("_s", "_m", "_w", "_l", "_f")


def normalization_summary(done: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up per profile and key: texts, changed texts, words removed."""
    return done.groupBy("profile", *keys).agg(
        F.count("*").alias("texts"), F.count(F.when(F.col("normalized") != F.col("text"), 1)).alias("changed"),
        F.sum("words_before").alias("words_before"), F.sum("words_after").alias("words_after"))


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(as_col(c)), NOT_WORD + "+"), lambda t: t != ""))


def token_changes(pairs: DataFrame, original: str = "original", changed: str = "normalized") -> DataFrame:
    """Added (minus allowed), removed and preserved tokens with the change ratio."""
    allowed = F.array(*[F.lit(w) for w in NUMBER_WORDS.values()])
    d = pairs.withColumn("o", tokens(original)).withColumn("n", tokens(changed))
    d = d.withColumn("added", F.array_except(F.array_except("n", "o"), allowed)).withColumn("removed", F.array_except("o", "n"))
    return d.withColumn("preserved", F.array_intersect("o", "n")).withColumn(
        "change_ratio", F.when(F.size("o") > 0, F.size("added") / F.greatest(F.size("o"), F.lit(1))).otherwise(F.when(F.size("added") > 0, 1.0).otherwise(0.0))).drop("o", "n")


def guardrail_audit(pairs: DataFrame, limit: float = 0.10, original: str = "original", changed: str = "normalized") -> DataFrame:
    """Invented tokens, change ratio, lost negations / quantifiers / connectors, lost protected tokens; pass, confidence, advice."""
    d = token_changes(pairs, original, changed)
    lost = lambda ws: F.size(F.array_intersect("removed", F.array(*[F.lit(w) for w in ws])))
    protected = F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), as_col(original), F.lit(" ")), F.lit(rf"{NOT_WORD}([A-Z]{{2,}}[0-9]*|[0-9]+[A-Z]+|[A-Za-z]+[0-9]+){NOT_WORD}"), F.lit(1)))
    d = d.withColumn("_p", protected).withColumn("protected_lost", F.size(F.filter("_p", lambda t: ~F.contains(as_col(changed), t))))
    d = d.withColumn("invented", F.size("added")).withColumn("negations_lost", lost(NEGATIONS)).withColumn("quantifiers_lost", lost(QUANTIFIERS)).withColumn("connectors_lost", lost(CONNECTORS))
    over = F.col("change_ratio") > limit
    critical = F.when(over, 1).otherwise(0) + F.when(F.col("negations_lost") > 0, 1).otherwise(0) + F.when(F.col("protected_lost") > 0, 1).otherwise(0)
    moderate = F.when(F.col("quantifiers_lost") > 0, 1).otherwise(0) + F.when(F.col("connectors_lost") > 0, 1).otherwise(0)
    d = d.withColumn("critical", critical).withColumn("moderate", moderate)
    return d.withColumn("passed", F.col("critical") == 0).withColumn("confidence", F.greatest(F.lit(0.0), 1.0 - F.col("critical") * 0.3 - F.col("moderate") * 0.1)) \
        .withColumn("advice", F.when(F.col("critical") >= 2, "verbatim").when(F.col("critical") == 1, "light").otherwise("keep")).drop("_p", "added", "removed", "preserved")


def guardrail_summary(audit: DataFrame, keys: list[str]) -> DataFrame:
    return audit.groupBy(*keys).agg(F.count("*").alias("pairs"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.sum("invented").alias("invented"),
                                    F.avg("change_ratio").alias("mean_change"), F.min("confidence").alias("min_confidence"))


def timing_drift(a: DataFrame, b: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Positional word pairs whose edges moved by more than ``limit``.  ``a``, ``b``: keys, pos, start, end."""
    x = a.select(*keys, "pos", F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = b.select(*keys, "pos", F.col("start").alias("s2"), F.col("end").alias("e2"))
    d = F.greatest(F.abs(F.col("s1") - F.col("s2")), F.abs(F.col("e1") - F.col("e2")))
    r = F.col("drift") / limit
    return x.join(y, [*keys, "pos"]).withColumn("drift", d).where(F.col("drift") > limit).select(
        *keys, "pos", "drift", F.when(r <= 1.5, "minor").when(r <= 3.0, "moderate").otherwise("severe").alias("severity"))


LEVELS = {"light": ["pause"], "moderate": ["all", "repeats"], "aggressive": ["all", "phrases", "repeats"]}
PUNCT_COMMA = r"([^,.!?;:\s])\s+(and|but|or|however|therefore)\s+"


def punctuate_corpus(df: DataFrame, level: str = "moderate", text: str = "text") -> DataFrame:
    """Rule-based punctuation and disfluency levels: a final period, conjunction commas, sentence capitals, change counts."""
    d = df.withColumn("_t", tidy_spaces(as_col(text)))
    if "pause" in LEVELS[level]:
        d = d.withColumn("_t", F.regexp_replace("_t", r"(?i)(?:\[pause\]|\[silence\]){2,}", "[pause]"))
    for rule in ("all", "phrases"):
        if rule in LEVELS[level]:
            d = d.withColumn("_t", tidy_spaces(drop_twice(F.col("_t"), FILLER_RULES[rule])))
    if "repeats" in LEVELS[level]:
        d = d.withColumn("_t", F.array_join(drop_repeats(F.split("_t", " "), []), " "))
    d = d.withColumn("removed", F.size(F.split(tidy_spaces(as_col(text)), " ")) - F.size(F.split("_t", " ")))
    d = d.withColumn("commas", regexp_n("_t", PUNCT_COMMA)).withColumn("_t", F.regexp_replace("_t", PUNCT_COMMA, "$1, $2 "))
    d = d.withColumn("period_added", ~F.col("_t").rlike("[.!?]$"))
    d = d.withColumn("_t", F.when(F.col("period_added"), F.concat("_t", F.lit("."))).otherwise(F.col("_t")))
    pieces = F.regexp_extract_all("_t", F.lit(r"([^.!?]+|[.!?]+)"), F.lit(1))
    d = d.withColumn("_t", F.array_join(F.transform(pieces, lambda s: F.when(s.startswith(" "), F.concat(F.lit(" "), capitalise(F.ltrim(s)))).otherwise(capitalise(s))), ""))
    return d.withColumn("punctuated", F.col("_t")).withColumn("confidence", F.greatest(F.lit(0.3), 1.0 - F.col("removed") * 0.1)).drop("_t")
