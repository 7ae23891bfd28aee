"""Word and segment statistics, the D, A and O scores, conversation flow and topic development."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chorale import words as W
from chorale.functions.strings import set_jaccard
from chorale.functions.text import NOT_WORD, bare, spaced
from chorale.operators.skew import attach, scan_over, top_n
from chorale.operators.turns import KEY, _bucket, find_overlaps, neighbours, speaker_smoothness, transition_consistency

FLOW_STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were",
             "be", "been", "have", "has", "had", "will", "would", "could", "should", "can", "may", "might", "this", "that", "these",
             "those", "i", "you", "he", "she", "it", "we", "they"]
MOMENTUM = ["and", "also", "furthermore", "additionally", "moreover", "but", "however", "although", "despite", "nevertheless",
            "so", "therefore", "thus", "consequently", "as a result", "specifically", "for example", "in particular", "namely"]
ASKING = ["what", "where", "when", "why", "how", "who", "which", "do", "does", "did", "can", "could", "would", "should"]
ANSWERS = ["yes", "no", "i think", "well", "actually", "sure", "definitely", "probably"]
HANDOFF = ["thank you", "that's right", "exactly", "yes", "i agree", "now"]
CONTINUING = ["and", "also", "furthermore", "so", "then", "next"]


def spread_tokens(segments: DataFrame, text: str = "text") -> DataFrame:
    """Token i of n gets ``start + i/n * (end - start)``."""
    d = segments.withColumn("_n", F.size(F.split(F.trim(text), r"\s+")))
    d = d.select(*[c for c in d.columns if c != text], F.posexplode(F.split(F.trim(text), r"\s+")).alias("pos", "token"))
    step = (F.col("end") - F.col("start")) / F.col("_n")
    return d.withColumn("t0", F.col("start") + F.col("pos") * step).withColumn("t1", F.col("start") + (F.col("pos") + 1) * step).drop("_n")


def normalize_timestamps(words: DataFrame, providers: DataFrame, duration: float | None = None) -> DataFrame:
    """``max(0, (t + offset) * scale)`` by provider clock (seconds), edges swapped if reversed, clamped to the duration.

    ``providers`` is the fixed clock table: provider, offset, scale; unknown providers keep their clock.
    """
    key = F.regexp_replace(F.lower("provider"), "[- ]", "_")
    table = providers.select(key.alias("_p"), F.col("offset").alias("_o"), F.col("scale").alias("_s"))
    d = words.withColumn("_p", key).join(table, "_p", "left")  # one row per provider kind
    o, s = F.coalesce("_o", F.lit(0.0)), F.coalesce("_s", F.lit(1.0))
    fix = lambda c: F.greatest(F.lit(0.0), (F.col(c) + o) * s)
    a, z = F.least(fix("start"), fix("end")), F.greatest(fix("start"), fix("end"))
    if duration is not None:
        over = z > duration + 1.0
        a, z = F.when(over & (a > duration), F.greatest(F.lit(0.0), F.lit(duration - 0.1))).otherwise(a), F.when(over, F.lit(duration)).otherwise(z)
    d = d.withColumn("_a", a).withColumn("_z", z)
    return d.withColumn("start", F.col("_a")).withColumn("end", F.col("_z")).drop("_p", "_o", "_s", "_a", "_z")


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Mean without int(share * n) values at each end, from a histogram of values instead of a per-key sort."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    run = scan_over(hist, keys, [value], F.floor(F.col(value) * 64), upto={"cum": ("sum", F.col("c"))})
    total = attach(run, keys, n=F.sum("c")).withColumn("k", F.floor(F.lit(share) * F.col("n")))
    inside = F.greatest(F.lit(0), F.least("cum", F.col("n") - F.col("k")) - F.greatest(F.col("cum") - F.col("c"), F.col("k")))
    return total.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.sum(inside * F.col(value)) / F.sum(inside)).alias("trimmed_mean"))


def speaker_entropy(turns: DataFrame) -> DataFrame:
    """Entropy of talk time over speakers, relative to the even split."""
    per = turns.groupBy(*KEY, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("t"))
    e = per.groupBy(*KEY).agg(F.count("*").alias("k"), F.sum("t").alias("total"),
                              F.sum(F.when(F.col("t") > 0, F.col("t") * F.log2("t")).otherwise(0.0)).alias("tl"))
    raw = F.log2("total") - F.col("tl") / F.col("total")
    top = F.when(F.col("k") > 1, F.log2("k")).otherwise(1.0)
    return e.select(*KEY, "k", F.when(F.col("total") == 0, 0.0).otherwise(raw / top).alias("entropy"))


def speaker_summary(segments: DataFrame, unit: float) -> DataFrame:
    """Per speaker and, with speaker ``*``, per session: segments, seconds, words, mean confidence, share of talk."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    per = segments.groupBy(*KEY, "speaker").agg(
        F.count("*").alias("segments"), (F.sum(F.col("end") - F.col("start")) / unit).alias("duration"),
        F.sum(n).alias("words"), F.sum("confidence").alias("c"))
    session = per.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("segments", "duration", "words", "c")])
    both = per.unionByName(session.withColumn("speaker", F.lit("*")))
    total = session.select(*KEY, F.col("duration").alias("total"))
    return both.join(total, KEY).select(
        *KEY, "speaker", "segments", "duration", "words", (F.col("c") / F.col("segments")).alias("confidence"),
        F.when(F.col("total") > 0, F.col("duration") / F.col("total") * 100).otherwise(0.0).alias("share"))


def boundary_snap(segments: DataFrame, words: DataFrame, unit: float, width: float, reach: float = 0.12) -> DataFrame:
    """Share of adjacent segments whose shared edge lies within 120 ms of the word edges on both sides."""
    edges = words.groupBy(*KEY, "id").agg(F.min_by("start", F.struct("start", "word_id")).alias("w0"),
                                          F.max_by("end", F.struct("start", "word_id")).alias("w1"))
    d = segments.join(edges, [*KEY, "id"], "left")
    d = scan_over(d, KEY, ["start", "id"], _bucket("start", width), lead={
        "n_start": F.col("start"), "n_w0": F.col("w0"), "n_id": F.col("id")})
    both = F.col("w1").isNotNull() & F.col("n_w0").isNotNull()
    snap = both & (F.abs(F.col("end") - F.col("w1")) <= reach * unit) & (F.abs(F.col("n_start") - F.col("n_w0")) <= reach * unit)
    return d.groupBy(*KEY).agg(
        F.count("*").alias("segments"), F.count(F.when(both, 1)).alias("pairs"), F.count(F.when(snap, 1)).alias("snapped"),
    ).withColumn("snap", F.when(F.col("segments") < 2, 1.0).otherwise(F.col("snapped") / F.greatest("pairs", F.lit(1))))


def monotonicity(words: DataFrame, unit: float, width: float, slack: float = 0.05) -> DataFrame:
    """Share of neighbouring words in time order, and the looser in-segment coherence averaged over segments."""
    d = scan_over(words, KEY, ["start", "word_id"], _bucket("start", width), lead={
        "n_start": F.col("start"), "n_segment": F.col("segment")})
    inside = F.col("n_segment") == F.col("segment")
    per = d.groupBy(*KEY, "segment").agg(
        F.count("*").alias("n"), F.count("n_start").alias("p"), F.count(F.when(F.col("end") <= F.col("n_start"), 1)).alias("m"),
        F.count(F.when(inside, 1)).alias("q"), F.count(F.when(inside & (F.col("end") > F.col("n_start") + slack * unit), 1)).alias("bad"))
    coherent = 1.0 - F.col("bad") / F.greatest("q", F.lit(1))
    return per.groupBy(*KEY).agg(
        F.sum("n").alias("words"), (F.sum("m") / F.greatest(F.sum("p"), F.lit(1))).alias("m"), F.avg(coherent).alias("coherence"),
    ).select(*KEY, "words", F.when(F.col("words") < 2, 1.0).otherwise(F.col("m")).alias("monotonicity"), "coherence")


def decode_summary(words: DataFrame, width: float) -> DataFrame:
    d = scan_over(words, KEY, ["start", "word_id"], _bucket("start", width), lag={"p_end": F.col("end")})
    per = d.groupBy(*KEY, "segment").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.avg("confidence").alias("sc"),
        F.count(F.when(F.col("start") < F.col("p_end"), 1)).alias("bad"))
    return per.groupBy(*KEY).agg(
        F.sum("n").alias("words"), F.count("*").alias("segments"), (F.sum("c") / F.sum("n")).alias("word_confidence"),
        F.avg("sc").alias("segment_confidence"), (1.0 - F.sum("bad") / F.sum("n")).alias("temporal_consistency"))


def overlap_share(turns: DataFrame, unit: float, width: float) -> DataFrame:
    """Overlapping time over talk time, null where nothing overlaps."""
    shared = find_overlaps(turns, unit, width).groupBy(*KEY).agg(F.sum("shared").alias("shared"))
    talk = turns.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("talk"))
    return talk.join(shared, KEY, "left").select(*KEY, (F.col("shared") / F.col("talk")).alias("overlap_share"))


def _double_talk(good: float, none: float) -> Column:
    r = F.col("overlap_share")
    return F.when(r.isNull(), none).when(r.between(0.05, 0.15), good).when(r < 0.05, 0.7).otherwise(0.6)


def score_d(turns: DataFrame, words: DataFrame, unit: float, width: float) -> DataFrame:
    d = boundary_snap(turns, words, unit, width).select(*KEY, "snap") \
        .join(speaker_smoothness(turns, unit, width).select(*KEY, "smoothness"), KEY) \
        .join(overlap_share(turns, unit, width), KEY).join(speaker_entropy(turns).select(*KEY, "entropy"), KEY)
    d = d.withColumn("plausibility", _double_talk(0.9, 0.8))
    return d.withColumn("d", 0.30 * F.col("snap") + 0.25 * F.col("smoothness") + 0.25 * F.col("plausibility") + 0.20 * F.col("entropy"))


def score_o(segments: DataFrame, unit: float, width: float) -> DataFrame:
    words = F.split(F.lower(F.trim("text")), r"\s+")
    short = F.col("end") - F.col("start") < 2.0 * unit
    listening = short & (F.size(words) <= 2) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in W.BACKCHANNELS]))
    per = segments.groupBy(*KEY).agg(F.count(F.when(short, 1)).alias("short"), F.count(F.when(listening, 1)).alias("heard"))
    d = per.join(overlap_share(segments, unit, width), KEY)
    d = d.withColumn("backchannel", F.when(F.col("short") == 0, 0.7).otherwise(
        F.least(F.col("heard") / F.greatest("short", F.lit(1)) + 0.3, F.lit(1.0)))).withColumn("doubletalk", _double_talk(0.85, 0.7))
    return d.select(*KEY, "short", "heard", "doubletalk", "backchannel",
                    (0.65 * F.col("doubletalk") + 0.35 * F.col("backchannel")).alias("o"))


def score_a(words: DataFrame, assigned: DataFrame, turns: DataFrame, unit: float, width: float) -> DataFrame:
    """Trimmed confidence, alignment, coherence, boundary precision and coverage.

    ``assigned`` is ``assign_speakers`` output; segments are the words of one assigned turn.
    """
    w = words.select(*KEY, "word_id", "start", "end", "confidence").join(
        assigned.select(*KEY, "word_id", "turn_id", F.col("confidence").alias("fit"), "conflict", "gap"), [*KEY, "word_id"])
    seg = w.groupBy(*KEY, "turn_id").agg(
        F.count("*").alias("n"), F.min("start").alias("s0"), F.max("end").alias("s1"), F.avg("fit").alias("fit"),
        F.count(F.when(F.col("gap"), 1)).alias("gaps"), F.count(F.when(F.col("conflict"), 1)).alias("conflicts"))
    t = turns.select(*KEY, F.col("id").alias("turn_id"), F.col("start").alias("t0"), F.col("end").alias("t1"))
    edge = lambda a, b: F.greatest(F.lit(0.0), 1.0 - F.abs(F.col(a) - F.col(b)) / unit / 0.4)
    s = seg.join(t, [*KEY, "turn_id"]).withColumn("edge", (edge("s0", "t0") + edge("s1", "t1")) / 2)
    m = s.groupBy(*KEY).agg(
        F.avg(1.0 - F.col("gaps") / F.col("n")).alias("covered"), F.avg("fit").alias("fit"),
        F.avg(1.0 - F.col("conflicts") / F.col("n")).alias("clean"), F.avg("edge").alias("edge"),
        (F.sum("conflicts") / F.sum("n")).alias("conflict_rate"), (1.0 - F.sum("gaps") / F.sum("n")).alias("reach"),
        (F.count(F.when(F.col("n") < 3, 1)) / F.count("*")).alias("small"))
    lined = w.withColumn("segment", F.col("turn_id"))
    d = m.join(trimmed_mean(words, KEY, "confidence"), KEY).join(monotonicity(lined, unit, width), KEY) \
        .join(transition_consistency(turns, unit, width).select(*KEY, "consistency"), KEY)
    d = d.select(
        *KEY, F.col("trimmed_mean").alias("confidence"),
        (0.4 * F.col("covered") + 0.35 * F.col("fit") + 0.25 * F.col("clean")).alias("alignment"),
        (0.4 * F.col("monotonicity") + 0.35 * F.col("coherence") + 0.25 * F.col("consistency")).alias("temporal"),
        (0.7 * F.col("edge") + 0.3 * F.greatest(F.lit(0.0), 1.0 - F.col("conflict_rate") * 2.0)).alias("boundary"),
        (0.7 * F.col("reach") + 0.3 * F.greatest(F.lit(0.0), 1.0 - F.col("small"))).alias("coverage"))
    return d.withColumn("a", 0.25 * F.col("confidence") + 0.25 * F.col("alignment") + 0.20 * F.col("temporal")
                        + 0.20 * F.col("boundary") + 0.10 * F.col("coverage"))


def _contains_any(c: Column, pieces: list[str]) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | c.contains(p)
    return out


def _content(c: str) -> Column:
    return F.array_except(F.split(F.lower(F.trim(c)), r"\s+"), F.array(*[F.lit(w) for w in FLOW_STOP]))


def adjacent_flow(segments: DataFrame, unit: float, width: float) -> DataFrame:
    """Each segment with the next one: lexical overlap, speaker bonus, transition quality, question and answer."""
    low = F.lower("text")
    d = scan_over(segments, KEY, ["start", "id"], _bucket("start", width), lead={
        "n_text": F.col("text"), "n_speaker": F.col("speaker"), "n_start": F.col("start"), "n_end": F.col("end")})
    d = d.withColumn("c1", _content("text")).withColumn("c2", _content("n_text"))
    lexical = F.when((F.size("c1") == 0) & (F.size("c2") == 0), 1.0).otherwise(set_jaccard(F.col("c1"), F.col("c2")))
    same = F.col("speaker") == F.col("n_speaker")
    lasting = (F.col("end") - F.col("start") >= 2.0 * unit) & (F.col("n_end") - F.col("n_start") >= 2.0 * unit)
    bonus = F.when(same, 0.8).when(lasting, 0.6).otherwise(0.3)
    handoff = F.when(same, F.when(_contains_any(F.lower("n_text"), CONTINUING), 0.8).otherwise(0.7)) \
        .otherwise(F.when(_contains_any(low, HANDOFF), 0.8).otherwise(0.6))
    gap = (F.col("n_start") - F.col("end")) / unit
    time = F.when(gap.between(0.0, 3.0), 0.9).when(gap <= 5.0, 0.7).otherwise(0.4)
    d = d.withColumn("lexical", F.when(F.col("n_text").isNotNull(), lexical))
    asks = (_contains_any(low, ASKING) | F.col("text").contains("?")) & ~same
    answer = F.lit(False)
    for p in ANSWERS:
        answer = answer | F.lower("n_text").startswith(p)
    return d.select(
        *KEY, "id", "speaker", "start", "end", "text", F.col("n_text").isNotNull().alias("has_next"), "lexical",
        F.when(F.col("n_text").isNotNull(), bonus).alias("bonus"), (~same).alias("changes"),
        (0.4 * F.col("lexical") + 0.35 * handoff + 0.25 * time).alias("transition"), asks.alias("asks"), (asks & answer).alias("answered"))


def conversation_flow(segments: DataFrame, unit: float, width: float) -> DataFrame:
    """Momentum, transitions, alternation, question/answer pairs and length naturalness per session."""
    f = adjacent_flow(segments, unit, width)
    first = f.groupBy(*KEY).agg(F.min_by("id", F.struct("start", "id")).alias("first_id"))
    moved = _contains_any(F.lower("text"), MOMENTUM)
    dur = (F.col("end") - F.col("start")) / unit
    m = f.join(first, KEY).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count(F.when(moved & (F.col("id") != F.col("first_id")), 1)).alias("momentum"),
        F.avg("lexical").alias("lexical"), F.avg("bonus").alias("bonus"),
        F.count(F.when(F.round("transition", 9) >= 0.6, 1)).alias("good"), F.count(F.when(F.col("changes"), 1)).alias("changes"),
        F.count(F.when(F.col("asks"), 1)).alias("asks"), F.count(F.when(F.col("answered"), 1)).alias("answered"),
        F.avg(dur).alias("mean"), F.stddev_pop(dur).alias("std"))
    pairs = F.greatest(F.col("n") - 1, F.lit(1))
    change = F.col("changes") / pairs
    alternation = F.when(F.col("n") < 3, 0.8).when(change.between(0.3, 0.7), 0.9).when(change.between(0.2, 0.8), 0.7).otherwise(0.5)
    length = (F.when(F.col("mean").between(3.0, 8.0), 1.0).otherwise(F.greatest(F.lit(0.4), 1.0 - F.abs(F.col("mean") - 5.5) * 0.2))
              + F.greatest(F.lit(0.3), F.when(F.col("mean") > 0, F.least(F.lit(1.0), F.col("std") / F.greatest("mean", F.lit(1.0)))).otherwise(0.5))) / 2
    response = F.when(F.col("n") < 4, 0.8).when(F.col("asks") == 0, 0.7).otherwise(F.col("answered") / F.greatest("asks", F.lit(1)))
    return m.select(
        *KEY, "n", "lexical", "bonus", (F.col("momentum") / pairs).alias("momentum"),
        F.when(F.col("n") < 2, 0.8).otherwise(F.col("good") / pairs).alias("transitions"), alternation.alias("alternation"),
        length.alias("length"), response.alias("response"),
        (0.40 * alternation + 0.30 * length + 0.30 * response).alias("naturalness"))


def topic_development(segments: DataFrame, width: float) -> DataFrame:
    """Keyword continuity over the first, middle and last third of a session.

    A section's keywords are its ten most frequent content words seen at least twice, earliest first on ties.
    """
    d = scan_over(segments, KEY, ["start", "id"], _bucket("start", width), upto={"at": ("sum", F.lit(1).cast("bigint"))})
    d = attach(d, KEY, n=F.count("*")).withColumn("third", F.floor(F.col("n") / 3))
    d = d.withColumn("section", F.when(F.col("at") <= F.col("third"), 1).when(F.col("at") <= 2 * F.col("third"), 2).otherwise(3))
    w = d.select(*KEY, "n", "section", "at", F.posexplode(F.split(F.lower(F.trim("text")), r"\s+")).alias("pos", "raw")) \
        .where((F.length("raw") > 3) & ~F.col("raw").isin(FLOW_STOP)).withColumn("word", bare(F.col("raw")))
    counts = w.groupBy(*KEY, "section", "word").agg(F.count("*").alias("c"), F.min(F.struct("at", "pos")).alias("first"))
    top = top_n(counts, [*KEY, "section"], [F.desc("c"), F.asc("first")], 10).where("c >= 2")
    sets = top.groupBy(*KEY).agg(*[F.collect_set(F.when(F.col("section") == i, F.col("word"))).alias(f"k{i}") for i in (1, 2, 3)])
    out = attach(segments.select(*KEY), KEY, n=F.count("*")).distinct().join(sets, KEY, "left")
    for i in (1, 2, 3):
        out = out.withColumn(f"k{i}", F.coalesce(f"k{i}", F.array().cast("array<string>")))
    cont = (set_jaccard(F.col("k1"), F.col("k2")) + set_jaccard(F.col("k2"), F.col("k3"))) / 2
    return out.select(*KEY, "n", *[F.size(f"k{i}").alias(f"keywords{i}") for i in (1, 2, 3)], cont.alias("continuity")).withColumn(
        "development", F.when(F.col("n") < 4, 0.7).when(F.col("continuity").between(0.2, 0.6), 0.9)
        .when(F.col("continuity").between(0.1, 0.7), 0.7).otherwise(0.5))


# fixed values
FORMAL = [
    "agenda", "minutes", "meeting", "discussion", "presentation", "proposal", "decision", "motion", "second",
    "vote", "approved", "rejected", "tabled", "quarterly", "revenue", "budget", "forecast", "strategy", "metrics",
    "kpi", "roi", "deliverable", "milestone", "deadline", "timeline", "ceo", "cfo", "cto", "vp", "director",
    "manager", "lead", "coordinator", "analyst", "specialist", "consultant", "advisor",
]
# fixed values
INFORMAL = [
    "yeah", "yep", "nope", "okay", "ok", "sure", "alright", "gonna", "wanna", "kinda", "sorta", "dunno", "anyway",
    "basically", "actually", "obviously", "definitely", "totally", "absolutely", "exactly", "right", "like",
]


def formality(df: DataFrame, text: str = "text") -> DataFrame:
    d = df.withColumn("_w", F.split(F.trim(F.lower(text)), r"\s+")).withColumn("_n", F.size("_w"))
    share = lambda ws: F.size(F.filter("_w", lambda w: w.isin(ws))) / F.col("_n")
    d = d.withColumn("formal", share(FORMAL)).withColumn("informal", share(INFORMAL))
    f, i = F.col("formal"), F.col("informal")
    is_f, is_i = (f > i * 2) & (f > 0.05), (i > f * 2) & (i > 0.05)
    mixed = F.abs(f - i) < 0.02
    return d.withColumn("level", F.when(is_f, "formal").when(is_i, "informal").when(mixed, "mixed").otherwise("neutral")) \
        .withColumn("level_confidence", F.when(is_f, F.least(f * 10, F.lit(1.0))).when(is_i, F.least(i * 10, F.lit(1.0)))
                    .when(mixed, 0.8).otherwise(0.6)).drop("_w", "_n")


def token_context(texts: DataFrame, text: str = "text", reach: int = 3) -> DataFrame:
    """Tokens with their +-reach neighbours, cut from the row's own token array: no shuffle, no window."""
    d = texts.withColumn("_w", F.split(F.trim(text), r"\s+"))
    near = F.transform("_w", lambda x, i: F.struct(
        i.cast("bigint").alias("pos"), x.alias("token"),
        F.slice("_w", F.greatest(i - reach + 1, F.lit(1)), F.lit(reach + 1) + F.least(i, F.lit(reach))).alias("context")))
    keep = [c for c in texts.columns if c != text]
    return d.select(*keep, F.inline(near))


ACRONYM = rf"{NOT_WORD}([A-Z]{{2,6}}){NOT_WORD}"
COMPOUND = rf"{NOT_WORD}([a-z]+(?:[A-Z][a-z]*)+){NOT_WORD}"
DIGIT_MIX = rf"{NOT_WORD}([a-zA-Z]+[0-9]+[a-zA-Z]*|[0-9]+[a-zA-Z]+){NOT_WORD}"


def session_vocabulary(segments: DataFrame, text: str = "text", common: list[str] | None = None) -> DataFrame:
    """Terms of a session by kind: frequent words, acronyms, camel case, digit mixes, proper nouns and phrases.

    A word and the two after it are counted as one run; words and phrases are summed from the counts of the runs.
    """
    low, grams = F.lower(text), "[a-zA-Z]+"

    def bag(kind: str, source: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    d = segments.withColumn("_g", F.regexp_extract_all(low, F.lit(grams), F.lit(0))).withColumn("_s", spaced(text))
    runs = F.transform("_g", lambda w, i: F.struct(F.lit("run").alias("kind"), F.concat_ws(" ", w, F.get("_g", i + 1)).alias("term"), F.get("_g", i + 2).alias("third")))
    bags = F.transform(F.concat(bag("acronym", F.col("_s"), ACRONYM), bag("compound", F.col("_s"), COMPOUND), bag("digits", F.col("_s"), DIGIT_MIX)),
                       lambda x: F.struct(x["kind"], x["term"], F.lit(None).cast("string").alias("third")))
    counted = d.select(*KEY, F.inline(F.concat(runs, bags))).groupBy(*KEY, "kind", "term", "third").agg(F.count("*").alias("freq"))
    first = F.substring_index("term", " ", 1)
    part = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))
    parts = F.when(F.col("kind") == "run", F.array(
        part("word", first), part("phrase2", F.when(first != F.col("term"), F.col("term"))),
        part("phrase3", F.when(F.col("third").isNotNull() & (F.col("freq") > 1), F.concat_ws(" ", "term", "third"))))).otherwise(F.array(F.struct("kind", "term")))
    n = F.length("term")
    word = (n > 4) & ~F.col("term").isin(common or FLOW_STOP)
    # the outer form, because the inner one makes the parts once more to see that there are some
    rows = counted.select(*KEY, "freq", parts.alias("parts")).select(*KEY, "freq", F.inline_outer("parts")).where(F.col("term").isNotNull() & ((F.col("kind") != "word") | word))
    freq = rows.groupBy(*KEY, "kind", "term").agg(F.sum("freq").alias("freq"))
    total = segments.groupBy(*KEY).agg(F.sum(F.regexp_count(low, F.lit(grams))).alias("total"))
    keep = F.col("kind").isin("acronym", "compound", "digits") | (F.col("kind").isin("word", "phrase2") & (F.col("freq") > 2)) \
        | ((F.col("kind") == "phrase3") & (F.col("freq") > 1))
    score = F.least(F.col("freq") / F.col("total") * 100, F.lit(1.0)) * 0.7 + F.least(n / 10.0, F.lit(1.0)) * 0.3
    return freq.where(keep).join(total, KEY, "left").select(
        *KEY, "kind", "term", "freq", F.when((F.col("kind") == "word") & (F.col("freq") > 1) & (n > 3), score).alias("confidence"))


def pairwise(hyps: DataFrame, keys: list[str], engine: str = "engine") -> DataFrame:
    """Each hypothesis of a unit with the later engines' hypotheses; a unit has one row per engine."""
    a = hyps.select(*keys, F.col(engine).alias("engine1"), F.col("text").alias("text1"), F.col("confidence").alias("confidence1"))
    b = hyps.select(*keys, F.col(engine).alias("engine2"), F.col("text").alias("text2"), F.col("confidence").alias("confidence2"))
    return a.join(b, keys).where("engine1 < engine2")
