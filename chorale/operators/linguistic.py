"""Text plausibility, punctuation and disfluency scores: column arithmetic over token arrays of one row."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chorale import words as W
from chorale.functions.marks import COUNTS, marks_of
from chorale.functions.text import (bare, band, count_if, literal_n, lowered, mean, moments, n_words, pairs_if, phrases_n, regexp_n, sentences_of,
                                    spaced, std, within, words_of)


def _clip01(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _ratio(test, items="low"):
    return count_if(F.col(items), test) / F.size(items)


def score_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Vocabulary, grammar, combinations, coherence, names and function words -> ``l_text``."""
    n = F.col("n")
    d = df.withColumn("w", words_of(text)).withColumn("n", F.size("w")).withColumn("low", lowered(F.col("w")))
    d = d.withColumn("clean", F.filter(F.transform("w", lambda x: bare(F.lower(x))), lambda x: x != ""))
    d = d.withColumn("sent", sentences_of(text)).withColumn("long", F.filter("sent", lambda s: n_words(s) >= 3))
    c = F.size("clean")
    ttr = F.col("u") / c
    d = d.withColumn("lens", moments(F.transform("clean", lambda x: F.length(x)))) \
        .withColumn("sizes", moments(F.transform("long", n_words))).withColumn("sp", spaced(F.lower(text))) \
        .withColumn("u", F.size(F.array_distinct("clean")))
    length = mean("lens")
    simple = count_if(F.col("clean"), within(W.SIMPLE)) / c
    repeats = (c - F.col("u")) / c
    vocab = (F.least(F.lit(1.0), ttr * 2.0) + band(length, 4.0, 7.0, 0.3, 5.5, 0.2) + band(simple, 0.15, 0.35, 0.4, 0.25, 3)
             + F.greatest(F.lit(0.0), 1.0 - repeats * 2)) / 4
    vocab = F.when(c == 0, 0.0).otherwise(vocab)

    d = d.withColumn("art", _ratio(within(W.ARTICLES))).withColumn("con", _ratio(within(W.CONJUNCTIONS))) \
        .withColumn("prep", _ratio(within(W.PREPOSITIONS))).withColumn("pron", _ratio(within(W.PRONOUNS))) \
        .withColumn("aux", _ratio(within(W.AUXILIARIES)))
    art, con = F.col("art"), F.col("con")
    article = F.when(n < 10, 0.7).when(art.between(0.08, 0.15), 1.0).when(art.between(0.05, 0.20), 0.8).otherwise(0.5)
    conj = F.when(n < 10, 0.7).when(con.between(0.03, 0.08), 1.0).when(con.between(0.01, 0.12), 0.8).otherwise(0.5)
    structure = F.when(F.size("long") < 2, 0.6).otherwise(
        (band(mean("sizes"), 8, 20, 0.4, 14, 0.1) + F.least(F.lit(1.0), std("sizes") / 5.0)) / 2)
    articles, degree, joiners = within(W.ARTICLES), within(W.DEGREE), within(W.JOINERS)
    bad_order = pairs_if(F.col("low"), lambda a, b: (articles(a) & articles(b)) | (degree(a) & joiners(b)))
    order = F.greatest(F.lit(0.3), 1.0 - bad_order / F.greatest(n - 1, F.lit(1)) * 3)
    grammar = (article + structure + order + conj) / 4

    preps, asks = within(W.SHORT_PREPOSITIONS), within(W.QUESTION_STARTS)
    odd = pairs_if(F.col("low"), lambda a, b: (articles(a) & articles(b)) | (preps(a) & preps(b)) | (asks(a) & asks(b))
                   | F.concat(a, F.lit(" "), b).isin(W.UNLIKELY_PAIRS))
    combination = F.greatest(F.lit(0.0), 1.0 - odd / F.greatest(n - 1, F.lit(1)) * 5)

    stop = within(W.TOPIC_STOP)
    topics = F.transform("long", lambda s: F.array_distinct(
        F.filter(lowered(F.split(s, " ")), lambda x: (~stop(x)) & (F.length(x) > 2))))
    d = d.withColumn("topics", topics)
    shared = F.zip_with("topics", F.slice("topics", 2, F.greatest(F.size("topics"), F.lit(1))), lambda a, b: F.when(
        b.isNotNull(), F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))))
    d = d.withColumn("overlap", moments(F.array_compact(shared)))
    topic = F.least(F.lit(1.0), mean("overlap") * 4)
    third = within(W.THIRD_PERSON)
    pronoun = F.when(F.exists("long", lambda s: F.exists(lowered(F.split(s, " ")), third)), 0.7).otherwise(0.8)
    for name, words in (("past", W.PAST), ("now", W.PRESENT), ("later", W.FUTURE)):
        d = d.withColumn(name, phrases_n("sp", words))
    past, now, later = F.col("past"), F.col("now"), F.col("later")
    top = F.greatest(past, now, later) / (past + now + later)
    tense = F.when(past + now + later == 0, 0.7).when(top >= 0.7, 0.9).when(top >= 0.5, 0.8).otherwise(0.6)
    coherence = F.when((n < 10) | (F.size("long") < 2), 0.6).otherwise((topic + pronoun + tense) / 3)

    marks = F.transform("w", lambda x, i: F.struct(
        bare(x).alias("b"), ((i == 0) | F.coalesce(F.get("w", i - 1).rlike("[.,!?;:]$"), F.lit(False))).alias("start")))
    names = F.transform(F.filter(marks, lambda m: (F.length(m["b"]) > 1) & m["b"].rlike(r"^\p{Lu}") & ~m["start"]),
                        lambda m: F.lower(m["b"]))
    d = d.withColumn("names", names)
    likely = count_if(F.col("names"), lambda x: ((F.length(x) >= 3) & x.rlike(W.NAME_ENDINGS)) | ~x.isin(W.NOT_NAMES))
    noun = F.when(F.size("names") == 0, 0.8).otherwise(F.greatest(F.lit(0.3), likely / F.size("names")))

    function = F.when(n < 10, 0.7).otherwise((
        band(art, 0.08, 0.15, 0.4, 0.12, 5) + band(F.col("prep"), 0.10, 0.20, 0.4, 0.15, 3)
        + band(F.col("pron"), 0.08, 0.18, 0.4, 0.13, 3)
        + band(F.col("aux"), 0.08, 0.16, 0.4, 0.12, 4)) / 4)
    parts = {"vocabulary": vocab, "grammar": grammar, "combination": combination, "coherence": coherence,
             "names_score": noun, "function_words": function}
    d = d.select(*df.columns, "n", *[x.alias(k) for k, x in parts.items()])
    total = 0.20 * F.col("vocabulary") + 0.25 * F.col("grammar") + 0.20 * F.col("combination") \
        + 0.15 * F.col("coherence") + 0.10 * F.col("names_score") + 0.10 * F.col("function_words")
    return d.withColumn("l_text", F.when(n < 5, 0.5).otherwise(_clip01(total)))


def score_punctuation(df: DataFrame, text: str = "text") -> DataFrame:
    """Boundaries, missing marks, placement, pairing and capitals -> ``l_punct``."""
    d = df.withColumn("_m", marks_of(text))
    m = {name: F.col(f"_m.{name}") for name in COUNTS}
    n, sentences = m["n"], m["sentences"]
    dots, asks, shouts, commas = (m[name] for name in ("dots", "asks", "shouts", "commas"))
    capital = m["capitals"] / F.greatest(sentences, F.lit(1))
    total = dots + asks + shouts + commas
    spread = F.when(total == 0, 0.5).otherwise(
        (band(dots / total, 0.6, 0.8, 0.5, 0.7, 2) + band(commas / total, 0.15, 0.3, 0.7, 0.22, 3)) / 2)
    boundary = F.when((dots + asks + shouts == 0) | (sentences == 0), 0.3).otherwise(
        0.5 * capital + 0.3 * band(m["sentence_words"] / sentences, 5, 25, 0.4, 15, 0.05) + 0.2 * spread)

    missing = F.when(n < 10, 0.7).otherwise(
        0.5 * F.greatest(F.lit(0.0), 1.0 - m["long_runs"] * 0.02)
        + 0.3 * F.when(m["lists"] > 0, m["listed"] / m["lists"]).otherwise(0.8)
        + 0.2 * F.when(m["questions"] > 0, F.least(F.lit(1.0), asks / m["questions"])).otherwise(0.8))

    contractions = m["proper"] + m["loose"]
    placement = 0.5 * F.greatest(F.lit(0.0), 1.0 - m["errors"] / n * 10) \
        + 0.25 * F.when(m["abbr"] == 0, 0.8).otherwise(m["dotted"] / m["abbr"]) \
        + 0.25 * F.when(contractions == 0, 0.8).otherwise(m["proper"] / contractions)

    def balanced(a, b):
        off = F.abs(m[a] - m[b])
        return F.when(off == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off * 0.2))

    single, quoted = m["single"], F.floor(m["double"] / 2)  # every second mark closes a quotation
    quote = F.when(quoted == 0, 0.9).otherwise(F.greatest(F.lit(0.3), 1.0 - m["hard_quotes"] / quoted))
    matching = 0.3 * balanced("opened", "closed") + 0.2 * balanced("opened_square", "closed_square") \
        + 0.2 * F.when(m["double"] % 2 == 0, 1.0).otherwise(0.7) \
        + 0.1 * F.when((single - m["apostrophes"]) % 2 == 0, 1.0).otherwise(F.when(single > 0, 0.8).otherwise(1.0)) \
        + 0.2 * quote

    def share(part, whole):
        return F.when(m[whole] == 0, 0.8).otherwise(m[part] / m[whole])

    misplaced = F.when(n < 10, 0.8).when(m["caps"] == 0, 0.8).otherwise(F.greatest(F.lit(0.0), 1.0 - m["wrong"] / m["caps"] * 2))
    case = F.when(n < 5, 0.6).otherwise(
        0.25 * F.when(sentences == 0, 0.5).otherwise(capital) + 0.25 * share("named", "inner") + 0.20 * share("titled", "runs")
        + 0.15 * misplaced + 0.15 * share("fine", "acronyms"))
    parts = {"boundary": boundary, "missing": missing, "placement": placement, "matching": matching, "capitals": case}
    d = d.select(*df.columns, *[x.alias(k) for k, x in parts.items()])
    return d.withColumn("l_punct", _clip01(0.25 * F.col("boundary") + 0.20 * F.col("missing") + 0.20 * F.col("placement")
                                           + 0.15 * F.col("matching") + 0.20 * F.col("capitals")))


def _steps(x, *bands, rest):
    out = F
    for high, score in bands:
        out = out.when(x <= high, score)
    return out.otherwise(rest)


def score_disfluency(df: DataFrame, text: str = "text") -> DataFrame:
    """Fillers, repetitions, broken words, false starts and pauses -> ``l_disfluency``."""
    n, low = F.col("n"), F.col("low")
    d = df.withColumn("w", words_of(text)).withColumn("n", F.size("w")).withColumn("low", lowered(F.col("w")))
    d = d.withColumn("low_text", F.lower(text)).withColumn("sp", spaced("low_text"))
    lower_text = F.col("low_text")
    fillers = count_if(low, within(W.FILLERS)) + phrases_n("sp", W.DISCOURSE) \
        + phrases_n("sp", W.FALSE_STARTS) + count_if(low, within(W.HESITATIONS))
    d = d.withColumn("fr", fillers / n)
    fr = F.col("fr")
    filler = F.when(fr == 0, 0.6).when(fr.between(0.01, 0.08), 0.9).when((fr > 0.08) & (fr <= 0.12), 0.8) \
        .when((fr > 0.12) & (fr <= 0.18), 0.6).otherwise(0.3)

    def echoes(step):
        same = F.zip_with(low, F.slice(low, 1 + step, F.greatest(n, F.lit(1))), lambda a, b: a == b)
        for _ in range(step - 1):  # the phrase repeats when every one of its words does
            same = F.zip_with(same, F.slice(same, 2, F.greatest(n, F.lit(1))), lambda a, b: a & b)
        return F.size(F.filter(same, lambda f: f)) * step

    again = pairs_if(low, lambda a, b: (a == b) & (F.length(a) > 2))
    stutter = count_if(F.col("w"), lambda x: (F.length(bare(x)) >= 4)
                       & (F.substring(bare(F.lower(x)), 1, 2) == F.substring(bare(F.lower(x)), 3, 2)))
    fixed = count_if(F.slice(low, F.lit(2), F.greatest(n - 2, F.lit(0))), within(W.CORRECTIONS))
    d = d.withColumn("rr", (again + echoes(2) + echoes(3) + stutter + fixed) / n)
    repeat = _steps(F.col("rr"), (0.0, 0.8), (0.02, 0.9), (0.05, 0.8), (0.10, 0.6), rest=0.3)
    broken = count_if(F.transform("w", lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_\-]", "")),
                      lambda x: (F.length(x) >= 2) & (x.endswith("-") | x.rlike("[bcdfghjklmnpqrstvwxyz]{3}$")))
    d = d.withColumn("ir", broken / n)
    incomplete = _steps(F.col("ir"), (0.0, 0.9), (0.02, 0.8), (0.05, 0.6), rest=0.3)
    starts = phrases_n(spaced(F.lower(F.array_join("w", " "))), W.START_PHRASES) \
        + pairs_if(F.col("w"), lambda a, b: F.concat(F.lower(a), F.lit(" "), F.lower(b)).isin(W.RESTARTS))
    d = d.withColumn("sr", starts / n)
    false_start = _steps(F.col("sr"), (0.0, 0.9), (0.03, 0.8), (0.06, 0.7), rest=0.5)
    pauses = regexp_n(text, r"\.{2,}") + literal_n(text, "—") + literal_n(text, "–")
    for p in W.PAUSES:
        pauses = pauses + literal_n(lower_text, p)
    d = d.withColumn("ur", pauses / n)
    pause = _steps(F.col("ur"), (0.0, 0.9), (0.02, 0.8), (0.05, 0.7), rest=0.5)
    parts = {"filler": filler, "repetition": repeat, "incomplete": incomplete, "false_start": false_start, "pause": pause}
    d = d.select(*df.columns, "n", *[x.alias(k) for k, x in parts.items()])
    total = 0.30 * F.col("filler") + 0.25 * F.col("repetition") + 0.20 * F.col("incomplete") \
        + 0.15 * F.col("false_start") + 0.10 * F.col("pause")
    return d.withColumn("l_disfluency", F.when(n < 5, 0.7).otherwise(_clip01(total)))


def score_linguistic(df: DataFrame, text: str = "text") -> DataFrame:
    """The three text scores and their .40/.35/.25 combination ``l``."""
    d = score_disfluency(score_punctuation(score_text(df, text).drop("n"), text), text).drop("n")
    return d.withColumn("l", 0.40 * F.col("l_text") + 0.35 * F.col("l_punct") + 0.25 * F.col("l_disfluency"))
