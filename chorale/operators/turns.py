"""Speaker turns and word times: interval joins, neighbour rules, smoothing and repair.

Turn tables: ``session_id, id, speaker, start, end, confidence`` with integer times; ``unit`` is ticks per second.
``width`` is the time bucket of interval joins and ordered scans, about the length of a long turn.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorale.operators.skew import attach, first_by, interval_join, islands, overlap_islands, scan_over
from chorale.session import cut_lineage

KEY = ["session_id"]


def _bucket(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(width))


def _sides(turns: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    names = ["id", "start", "end", *payload]
    left = turns.select(*KEY, *[F.col(c).alias(f"{c}1") for c in names])
    right = turns.select(*KEY, *[F.col(c).alias(f"{c}2") for c in names])
    return left, right


def find_overlaps(turns: DataFrame, unit: float, width: float, min_dur: float = 0.1) -> DataFrame:
    """Pairs of one session that share at least ``min_dur`` seconds, earlier start first."""
    left, right = _sides(turns, ["speaker", "confidence"])
    pairs = interval_join(left, right, KEY, ("start1", "end1"), ("start2", "end2"), width)
    before = (F.col("start1") < F.col("start2")) | ((F.col("start1") == F.col("start2")) & (F.col("id1") < F.col("id2")))
    shared = F.least("end1", "end2") - F.greatest("start1", "start2")
    return pairs.where(before).withColumn("shared", shared).where(
        (F.col("shared") > 0) & (F.col("shared") >= min_dur * unit)).select(
        *KEY, "id1", "id2", "speaker1", "speaker2", "start1", "end1", "start2", "end2", "confidence1", "confidence2",
        F.greatest("start1", "start2").alias("start"), F.least("end1", "end2").alias("end"), "shared",
        F.least("confidence1", "confidence2").alias("confidence"),
        (F.col("shared") / (F.col("end1") - F.col("start1"))).alias("ratio1"),
        (F.col("shared") / (F.col("end2") - F.col("start2"))).alias("ratio2"))


def overlap_probability(pairs: DataFrame, unit: float, confidence_weight: float = 0.3, full_duration: float = 0.5,
                        same_speaker: float = 0.7, center_weight: float = 0.2, threshold: float = 0.25) -> DataFrame:
    mean = (F.col("confidence1") + F.col("confidence2")) / 2
    conf = 1.0 - (1.0 - mean) * confidence_weight
    dur = F.least(F.lit(1.0), F.col("shared") / unit / full_duration)
    who = F.when(F.col("speaker1") != F.col("speaker2"), 1.0).otherwise(same_speaker)
    middle = F.col("start") + F.col("shared") / 2

    def near(i: int) -> Column:
        half = (F.col(f"end{i}") - F.col(f"start{i}")) / 2
        return 1.0 - F.least(F.lit(1.0), F.abs((F.col(f"start{i}") + F.col(f"end{i}")) / 2 - middle) / half)

    center = F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1.0 - center_weight + center_weight * ((near(1) + near(2)) / 2)))
    p = F.greatest(F.col("ratio1"), F.col("ratio2")) * conf * dur * who * center
    return pairs.withColumn("probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))) \
        .withColumn("separate", F.col("probability") >= threshold)


def cross_stem_overlaps(turns: DataFrame, unit: float, width: float, min_dur: float = 0.1, merge: float = 0.2) -> DataFrame:
    """Overlaps between different stems, merged per stem pair where regions lie within ``merge`` seconds."""
    left, right = _sides(turns, ["stem", "speaker", "confidence", "quality"])
    pairs = interval_join(left, right, KEY, ("start1", "end1"), ("start2", "end2"), width).where("stem1 < stem2")
    start, end = F.greatest("start1", "start2"), F.least("end1", "end2")
    first = F.col("confidence1") > F.col("confidence2")
    score = ((F.col("confidence1") + F.col("confidence2")) / 2 * 0.4
             + F.least(F.lit(1.0), (end - start) / unit) * 0.3
             + (F.col("quality1") + F.col("quality2")) / 2 * 0.3) \
        * F.when(F.col("speaker1") != F.col("speaker2"), 1.2).otherwise(0.8)
    regions = pairs.where((end > start) & (end - start >= min_dur * unit)).select(
        *KEY, "stem1", "stem2", "id1", "id2", start.alias("start"), end.alias("end"),
        F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 9).alias("confidence"),
        F.when(first, F.col("stem1")).otherwise(F.col("stem2")).alias("dominant_stem"),
        F.when(first, F.col("speaker1")).otherwise(F.col("speaker2")).alias("dominant_speaker"))
    keys = [*KEY, "stem1", "stem2"]
    runs = overlap_islands(regions, keys, "start", "end", ["id1", "id2"], width, merge * unit)
    best = F.struct((-F.col("confidence")).alias("c"), F.col("start").alias("s"), F.col("id1").alias("i"), F.col("id2").alias("j"))
    return runs.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"),
        F.count("*").alias("regions"), F.min_by("dominant_stem", best).alias("dominant_stem"),
        F.min_by("dominant_speaker", best).alias("dominant_speaker"))


def assign_speakers(words: DataFrame, turns: DataFrame, unit: float, width: float, tol: float = 0.15) -> DataFrame:
    """Word -> turn by overlap ratio, then centre distance; words out of reach take the nearest turn edge.

    ``words``: session_id, word_id, ws, we.  Nearest turns come from two as-of scans over the unmatched words only.
    """
    t = turns.select(*KEY, F.col("id").alias("turn_id"), F.col("speaker").alias("turn_speaker"),
                     F.col("start").alias("ts"), F.col("end").alias("te"))
    pairs = interval_join(words, t, KEY, ("ws", "we"), ("ts", "te"), width, tol * unit)
    ratio = F.greatest(F.lit(0), F.least("we", "te") - F.greatest("ws", "ts")) / (F.col("we") - F.col("ws"))
    off = F.abs((F.col("ws") + F.col("we")) / 2 - (F.col("ts") + F.col("te")) / 2)
    order = F.struct((-ratio).alias("r"), off.alias("d"), F.col("turn_id").alias("id"))
    hit = pairs.groupBy(*KEY, "word_id").agg(
        F.min_by(F.struct("turn_id", F.col("turn_speaker").alias("speaker")), order).alias("best"),
        F.max(ratio).alias("ratio"), F.count("*").alias("candidates"),
        (F.count(F.when(ratio > 0.3, 1)) >= 2).alias("conflict"),
    ).select(*KEY, "word_id", "best.turn_id", "best.speaker", F.least(F.lit(1.0), F.col("ratio") * 1.2).alias("confidence"),
             "candidates", "conflict", F.lit(False).alias("gap"))
    hit = cut_lineage(hit)  # half of the result, and what tells the unmatched words
    lost = cut_lineage(words.join(hit, [*KEY, "word_id"], "left_anti"))  # few words, read by both scans and the last join

    def edge(word_time: str, turn_time: str, kind: int) -> DataFrame:
        tie = -F.col("turn_id") if kind == 0 else F.col("turn_id")
        return lost.select(*KEY, F.col(word_time).alias("t"), F.lit(1 - kind).alias("k"), F.col("word_id").alias("tie"),
                           F.lit(None).cast("bigint").alias("turn_id"), F.lit(None).cast("string").alias("speaker"),
                           "word_id", F.lit(None).cast("bigint").alias("at")).unionByName(
            t.select(*KEY, F.col(turn_time).alias("t"), F.lit(kind).alias("k"), tie.alias("tie"), "turn_id",
                     F.col("turn_speaker").alias("speaker"), F.lit(None).cast("bigint").alias("word_id"),
                     F.col(turn_time).alias("at")))

    known = F.when(F.col("turn_id").isNotNull(), F.struct("turn_id", "speaker", "at"))
    prev = scan_over(edge("ws", "te", 0), KEY, ["t", "k", "tie"], _bucket("t", width), last_upto={"near": known})
    nxt = scan_over(edge("we", "ts", 1).withColumn("k", F.col("k").cast("int")), KEY, ["t", "k", "tie"],
                    _bucket("t", width), next_from={"near": known})
    near = lost.join(prev.where("word_id is not null").select(*KEY, "word_id", F.col("near").alias("p")), [*KEY, "word_id"]) \
        .join(nxt.where("word_id is not null").select(*KEY, "word_id", F.col("near").alias("n")), [*KEY, "word_id"])
    dp, dn = F.col("ws") - F.col("p.at"), F.col("n.at") - F.col("we")
    use_prev = F.col("n").isNull() | (F.col("p").isNotNull() & (dp <= dn))
    pick = F.when(use_prev, F.col("p")).otherwise(F.col("n"))
    gap = F.when(use_prev, dp).otherwise(dn) / unit
    filled = near.where("p is not null or n is not null").select(
        *KEY, "word_id", pick["turn_id"].alias("turn_id"), pick["speaker"].alias("speaker"),
        F.greatest(F.lit(0.1), 1.0 - gap / 2.0).alias("confidence"), F.lit(0).cast("bigint").alias("candidates"),
        F.lit(False).alias("conflict"), F.lit(True).alias("gap"))
    return hit.unionByName(filled)


def elementary_intervals(segments: DataFrame, unit: float, width: float, minimum: float = 0.5) -> DataFrame:
    edges = segments.select(*KEY, F.col("start").alias("t")).union(segments.select(*KEY, F.col("end").alias("t"))).distinct()
    cut = scan_over(edges, KEY, ["t"], _bucket("t", width), lead={"until": F.col("t")})
    return cut.where(F.col("until") - F.col("t") >= minimum * unit).select(
        *KEY, F.col("t").alias("start"), F.col("until").alias("end"))


def collect_voters(intervals: DataFrame, segments: DataFrame, words: DataFrame, unit: float, width: float) -> DataFrame:
    """Text of each candidate over an interval it covers with more than 30 % of a segment.

    ``segments``: session_id, candidate_id, id, start, end, text; ``words``: session_id, candidate_id, id, ws, we,
    confidence, where id names the segment.
    """
    i = intervals.select(*KEY, F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    near = interval_join(i, segments, KEY, ("i_start", "i_end"), ("start", "end"), width)
    shared = F.least("i_end", "end") - F.greatest("i_start", "start")
    votes = near.where((shared > 0) & (shared / F.greatest(F.col("end") - F.col("start"), F.lit(0.1 * unit)) > 0.3)) \
        .select(*KEY, "i_start", "i_end", "candidate_id", "id", "start", "text")
    inside = interval_join(i, words, KEY, ("i_start", "i_end"), ("ws", "we"), width) \
        .where("ws >= i_start and we <= i_end").groupBy(*KEY, "i_start", "i_end", "candidate_id", "id") \
        .agg(F.sum("confidence").alias("s"), F.count("*").alias("c"))
    per = votes.join(inside, [*KEY, "i_start", "i_end", "candidate_id", "id"], "left")
    ordered = F.sort_array(F.collect_list(F.struct("start", "id", "text")))  # the few segments over one interval
    return per.groupBy(*KEY, "i_start", "i_end", "candidate_id").agg(
        F.array_join(ordered["text"], " ").alias("text"),
        F.coalesce(F.sum("s") / F.sum("c"), F.lit(0.5)).alias("confidence"))


def repair_candidates(issues: DataFrame, segments: DataFrame, unit: float, width: float, keep: int = 5) -> DataFrame:
    """Alternatives covering more than half of a problem segment, best ``keep`` per problem.

    ``issues``: session_id, issue_id, p_start, p_end; ``segments`` adds candidate_id, confidence and final.
    """
    near = interval_join(issues, segments, KEY, ("p_start", "p_end"), ("start", "end"), width)
    ratio = (F.least("p_end", "end") - F.greatest("p_start", "start")) / (F.col("p_end") - F.col("p_start"))
    score = F.col("confidence") + F.least(F.lit(0.2), F.col("ratio") - 0.5) \
        + F.least(F.lit(0.1), (F.col("final") - 0.5) * 0.2)
    scored = near.withColumn("ratio", ratio).where("ratio > 0.5").withColumn(
        "score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 9))
    w = Window.partitionBy(*KEY, "issue_id").orderBy(F.desc("score"), "candidate_id", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def attach_embeddings(segments: DataFrame, turns: DataFrame, unit: float, width: float, minimum: float = 0.1) -> DataFrame:
    """Embedding of the turn sharing most time (more than 100 ms) with each segment.

    Only ids travel through the aggregate; the vectors are joined to the winners.
    """
    s = segments.select(*KEY, F.col("id").alias("segment_id"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    t = turns.select(*KEY, F.col("id").alias("turn_id"), F.col("start").alias("t0"), F.col("end").alias("t1"))
    near = interval_join(s, t, KEY, ("s0", "s1"), ("t0", "t1"), width)
    near = near.withColumn("shared", F.least("s1", "t1") - F.greatest("s0", "t0")).where(F.col("shared") > minimum * unit)
    best = first_by(near, [*KEY, "segment_id"], [-F.col("shared"), F.col("t0"), F.col("turn_id")], ["turn_id", "shared"])
    return best.join(turns.select(*KEY, F.col("id").alias("turn_id"), "embedding"), [*KEY, "turn_id"])


def overlap_coverage(ref: DataFrame, hyp: DataFrame, unit: float, width: float, iou: float = 0.5) -> DataFrame:
    """Share of reference overlaps matched by a hypothesis overlap of IoU >= .5; 1 where there are none."""
    def regions(d: DataFrame, p: str) -> DataFrame:
        r = find_overlaps(d, unit, width, 0.0)
        return r.select(*KEY, F.col("id1").alias(f"{p}a"), F.col("id2").alias(f"{p}b"),
                        F.col("start").alias(f"{p}0"), F.col("end").alias(f"{p}1"))

    r, h = regions(ref, "r"), regions(hyp, "h").select(*KEY, "h0", "h1").distinct()
    met = interval_join(r, h, KEY, ("r0", "r1"), ("h0", "h1"), width)
    same = (F.least("r1", "h1") - F.greatest("r0", "h0")) / (F.greatest("r1", "h1") - F.least("r0", "h0"))
    found = met.where(same >= iou).select(*KEY, "ra", "rb").distinct().withColumn("found", F.lit(1))
    scored = r.join(found, [*KEY, "ra", "rb"], "left").groupBy(*KEY).agg(
        F.count("*").alias("overlaps"), F.count("found").alias("matched"))
    return ref.select(*KEY).distinct().join(scored, KEY, "left").select(
        *KEY, F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce("matched", F.lit(0)).alias("matched"),
        F.coalesce(F.col("matched") / F.col("overlaps"), F.lit(1.0)).alias("coverage"))


def neighbours(turns: DataFrame, width: float, second: bool = False) -> DataFrame:
    """Next (and next but one) turn in start order."""
    d = scan_over(turns, KEY, ["start", "id"], _bucket("start", width), lead={
        "n_start": F.col("start"), "n_end": F.col("end"), "n_speaker": F.col("speaker"), "n_id": F.col("id"),
        "n_confidence": F.col("confidence")})
    if not second:
        return d
    return scan_over(d, KEY, ["start", "id"], _bucket("start", width), lead={
        "nn_end": F.col("n_end"), "nn_speaker": F.col("n_speaker")})


def speaker_smoothness(turns: DataFrame, unit: float, width: float, span: float = 3.0) -> DataFrame:
    flip = (F.col("speaker") == F.col("nn_speaker")) & (F.col("speaker") != F.col("n_speaker")) \
        & (F.col("nn_end") - F.col("start") <= span * unit)
    return neighbours(turns, width, True).groupBy(*KEY).agg(
        F.count("*").alias("turns"), F.count(F.when(flip, 1)).alias("flips"),
    ).withColumn("smoothness", F.when(F.col("turns") < 3, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("flips") / (F.col("turns") - 2))))


def transition_consistency(turns: DataFrame, unit: float, width: float, low: float = -0.1, high: float = 3.0) -> DataFrame:
    gap = F.col("n_start") - F.col("end")
    return neighbours(turns, width).groupBy(*KEY).agg(
        F.count("*").alias("turns"), F.count(F.when(gap.between(low * unit, high * unit), 1)).alias("good"),
    ).withColumn("consistency", F.when(F.col("turns") < 2, 1.0).otherwise(F.col("good") / (F.col("turns") - 1)))


def rapid_transitions(turns: DataFrame, unit: float, width: float, threshold: float = 0.1) -> DataFrame:
    gap = F.col("n_start") - F.col("end")
    return neighbours(turns, width).where((gap < threshold * unit) & (F.col("speaker") != F.col("n_speaker"))).select(
        *KEY, "id", "n_id", "speaker", "n_speaker", gap.alias("gap"), (gap < 0).alias("is_overlap"))


def stability_metrics(turns: DataFrame, unit: float, width: float, smoothed: DataFrame | None = None) -> DataFrame:
    gap = F.col("n_start") - F.col("end")
    changed = F.col("speaker") != F.col("n_speaker")
    m = neighbours(turns, width).groupBy(*KEY).agg(
        F.count("*").alias("turns"), F.count(F.when(changed, 1)).alias("transitions"),
        F.count(F.when(changed & (gap < 0.1 * unit), 1)).alias("rapid"),
        F.count(F.when(gap.between(-0.1 * unit, 2.0 * unit), 1)).alias("natural"),
        F.count(F.when(F.col("end") - F.col("start") >= 0.5 * unit, 1)).alias("lasting"))
    pairs = F.col("turns") - 1
    m = m.select(
        *KEY, "turns", "transitions", "rapid",
        F.when(pairs < 1, 1.0).otherwise(F.col("natural") / pairs).alias("preservation"),
        (F.col("lasting") / F.col("turns")).alias("consistency"),
        F.when(pairs < 1, 1.0).otherwise((pairs - F.col("rapid")) / pairs).alias("smoothness"))
    if smoothed is None:
        return m
    after = stability_metrics(smoothed, unit, width).select(*KEY, F.col("transitions").alias("transitions_after"))
    return m.join(after, KEY).withColumn("eliminated", F.col("transitions") - F.col("transitions_after"))


def variant_quality(turns: DataFrame, unit: float, width: float) -> DataFrame:
    m = neighbours(turns, width).groupBy(*KEY).agg(
        F.count("*").alias("turns"), F.count(F.when(F.col("speaker") != F.col("n_speaker"), 1)).alias("changes"),
        (F.sum(F.col("end") - F.col("start")) / unit).alias("duration"), F.avg("confidence").alias("confidence"),
        (F.max_by("end", F.struct("start", "id")) / unit).alias("last_end"))
    return m.select(
        *KEY, "turns", (1.0 - F.least(F.col("changes") / F.col("turns"), F.lit(1.0))).alias("consistency"),
        (F.col("duration") / F.greatest(F.col("last_end"), F.lit(1.0))).alias("coverage"), "confidence",
        (F.col("duration") / F.col("turns")).alias("mean_length"),
    ).withColumn("quality", F.least(F.lit(1.0), F.greatest(F.lit(0.0),
        F.col("consistency") * 0.3 + F.col("coverage") * 0.2 + F.col("confidence") * 0.3
        + F.least(F.col("mean_length") / 10.0, F.lit(1.0)) * 0.2)))


def words_to_segments(words: DataFrame, unit: float, width: float, max_gap: float = 2.0) -> DataFrame:
    """Runs of words of one speaker without a pause over ``max_gap``.

    ``words``: session_id, speaker, word_id, start, end, word, confidence; order is start, word_id.
    """
    b, order = _bucket("start", width), ["start", "word_id"]
    d = scan_over(words, KEY, order, b, lag={"p_end": F.col("end"), "p_speaker": F.col("speaker")})
    fresh = F.col("p_speaker").isNull() | (F.col("speaker") != F.col("p_speaker")) \
        | (F.col("start") - F.col("p_end") > max_gap * unit)
    d = islands(d, KEY, order, b, fresh, "segment")
    text = F.sort_array(F.collect_list(F.struct("start", "word_id", "word")))
    return d.groupBy(*KEY, "segment", "speaker").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("words"),
        F.avg("confidence").alias("confidence"), F.array_join(text["word"], " ").alias("text"))


def boundary_violations(turns: DataFrame, unit: float, width: float, tolerance: float = 0.01,
                        speaker_gap: float = 1.0) -> DataFrame:
    """Every rule on neighbouring turns as one row per violation: the turn after the edge, kind, gap, severity."""
    gap = (F.col("n_start") - F.col("end")) / unit
    changed = F.col("speaker") != F.col("n_speaker")
    rules = [
        (gap < 0, "overlap", F.when(gap < -0.1, "critical").otherwise("warning")),
        (gap > 2.0, "gap", F.when(gap < 5.0, F.lit("warning")).otherwise("minor")),
        (gap < -tolerance, "reverse_order", F.lit("critical")),
        (gap < -0.05, "token_overlap", F.lit("critical")),
        (changed & (gap > speaker_gap), "speaker_transition_gap", F.lit("warning")),
    ]
    found = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"))) for c, kind, severity in rules]))
    return neighbours(turns, width).where("n_id is not null").select(
        *KEY, F.col("n_id").alias("id"), gap.alias("gap"), F.inline(found))


def boundary_report(turns: DataFrame, unit: float, width: float) -> DataFrame:
    v = boundary_violations(turns, unit, width).groupBy(*KEY).agg(
        F.count("*").alias("violations"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"))
    n = turns.groupBy(*KEY).agg(F.count("*").alias("turns"))
    return n.join(v, KEY, "left").select(
        *KEY, "turns", F.coalesce("violations", F.lit(0)).alias("violations"),
        F.coalesce("critical", F.lit(0)).alias("critical"), (F.coalesce("critical", F.lit(0)) == 0).alias("is_valid"))


def fix_boundaries(turns: DataFrame, width: float) -> DataFrame:
    """Overlapping neighbours both move to the midpoint of the original edges; reversed turns are swapped first."""
    flat = turns.withColumn("s", F.least("start", "end")).withColumn("e", F.greatest("start", "end")) \
        .withColumn("start", F.col("s")).withColumn("end", F.col("e"))
    d = scan_over(flat, KEY, ["start", "id"], _bucket("start", width), lag={"p_end": F.col("end")},
                  lead={"n_start": F.col("start")})
    left = F.when(F.col("start") < F.col("p_end"), (F.col("start") + F.col("p_end")) / 2).otherwise(F.col("start"))
    right = F.when(F.col("n_start") < F.col("end"), (F.col("n_start") + F.col("end")) / 2).otherwise(F.col("end"))
    return d.select(*KEY, "id", "speaker", left.cast("double").alias("start"), right.cast("double").alias("end"),
                    ((F.col("start") < F.col("p_end")) | (F.col("n_start") < F.col("end"))).alias("moved"))


COMMON = ["the", "a", "an", "and", "or", "but"]


def dedupe_words(words: DataFrame, unit: float, width: float, gap: float = 0.1) -> DataFrame:
    """Drop an immediate repeat of a word within 100 ms of the word it repeats, keeping the more confident one.

    ``words`` as in ``words_to_segments`` plus ``segment``; runs of equal words are cut out by islands and only the
    short runs are folded, because a repeat is measured from the kept word, not from the last one.
    """
    b, order = _bucket("start", width), ["start", "word_id"]
    low = F.lower(F.trim("word"))
    d = words.withColumn("low", low)
    d = scan_over(d, KEY, order, b, lag={"p_low": F.col("low"), "p_end": F.col("end"), "p_segment": F.col("segment")})
    fresh = F.col("p_low").isNull() | (F.col("low") != F.col("p_low")) | (F.col("segment") != F.col("p_segment")) \
        | F.col("low").isin(COMMON) | (F.col("start") - F.col("p_end") >= gap * unit)
    d = islands(d, KEY, order, b, fresh, "run")
    item = F.struct("start", "word_id", "end", "confidence", "word", "segment")
    runs = d.groupBy(*KEY, "run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = F.aggregate(
        "items", F.struct(F.lit(None).cast("bigint").alias("lead_end"), F.filter("items", lambda x: F.lit(False)).alias("out")),
        lambda acc, x: F.when(
            acc["lead_end"].isNull() | (x["start"] - acc["lead_end"] >= gap * unit),
            F.struct(x["end"].alias("lead_end"), F.concat(acc["out"], F.array(x)).alias("out")),
        ).when(x["confidence"] > F.element_at(acc["out"], -1)["confidence"],
               F.struct(acc["lead_end"].alias("lead_end"),
                        F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(x)).alias("out")),
               ).otherwise(acc))
    return runs.select(*KEY, F.inline(kept["out"]))


def edge_duplicates(segments: DataFrame, width: float) -> DataFrame:
    """Neighbouring segments whose last two words equal the first two words of the next one."""
    parts = F.split(F.lower(F.trim("text")), r"\s+")
    d = segments.select(*KEY, "id", "start", F.size(parts).alias("n"),
                        F.array_join(F.slice(parts, 1, 2), " ").alias("head"),
                        F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), " ")).alias("tail"))
    d = scan_over(d, KEY, ["start", "id"], _bucket("start", width), lead={
        "n_id": F.col("id"), "n_head": F.when(F.col("n") >= 2, F.col("head"))})
    return d.where("n_id is not null").select(
        *KEY, "id", "n_id", F.coalesce(F.col("tail") == F.col("n_head"), F.lit(False)).alias("duplicate"))


def smooth_turns(turns: DataFrame, tick: int, width: float, size: int = 5, ratio: float = 0.6,
                 per_bucket: int = 100_000) -> DataFrame:
    """Grid of ticks, most confident active speaker per tick, majority filter over ``size`` ticks, back to runs.

    No row per tick: between two turn edges the same turns are active, so such a cell has one speaker, and the filter can
    change only ticks within half a window of a cell's ends.  Those are laid out, four half windows a cell at most; the inside
    of a cell stays one row.  The cost follows the number of turns, however fine the grid.  Ticks count on over gaps without a
    turn; each bucket of ticks gets a halo of its neighbours', so no window sees a whole session.
    """
    half = size // 2
    first = turns.groupBy(*KEY).agg(F.min("start").alias("origin"))
    lo = F.ceil((F.col("start") - F.col("origin")) / tick)
    hi = F.floor((F.col("end") - F.col("origin")) / tick) + 1
    ranges = turns.join(first, KEY).select(*KEY, F.col("start").alias("at"), "id", "speaker", "confidence", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    edges = ranges.select(*KEY, F.col("lo").alias("start"), F.col("hi").alias("end"))
    cells = elementary_intervals(edges, 1, width, 0.0).where("end > start").select(*KEY, F.col("start").alias("c0"), F.col("end").alias("c1"))
    active = first_by(interval_join(cells, ranges, KEY, ("c0", "c1"), ("lo", "hi"), width).where("lo < c1 and hi > c0"), [*KEY, "c0", "c1"], [-F.col("confidence"), F.col("at"), F.col("id")], ["speaker"])
    cells = scan_over(active.withColumn("len", F.col("c1") - F.col("c0")), KEY, ["c0"], _bucket("c0", width), before={"skip": ("sum", F.col("len"))})
    cells = cut_lineage(cells.select(*KEY, "c0", "len", "speaker", (F.coalesce("skip", F.lit(0)) + 1).alias("n0")))

    last = F.col("len") - 1
    near = F.when(F.col("len") <= 4 * half, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(
        F.concat(F.sequence(F.lit(0).cast("bigint"), F.lit(2 * half - 1).cast("bigint")), F.sequence(F.col("len") - 2 * half, last)))
    points = cells.select("*", F.explode(near).alias("o")).select(
        *KEY, (F.col("n0") + F.col("o")).alias("n"), (F.col("c0") + F.col("o")).alias("tick"), "speaker", ((F.col("o") < half) | (F.col("o") >= F.col("len") - half)).alias("open"))
    own = F.floor(F.col("n") / per_bucket)
    halo = points.withColumn("own", own).withColumn("b", F.explode(F.array_distinct(F.array(
        F.floor((F.col("n") - half) / per_bucket), own, F.floor((F.col("n") + half) / per_bucket)))))
    w = Window.partitionBy(*KEY, "b").orderBy("n").rowsBetween(-half, half)
    votes = F.collect_list("speaker").over(w)
    d = halo.withColumn("votes", votes).where("b = own and open")
    major = F.filter(F.array_distinct("votes"), lambda s: F.size(F.filter("votes", lambda v: v == s)) / F.size("votes") >= ratio)
    ends = d.select(*KEY, "n", "tick", F.lit(1).cast("bigint").alias("ticks"), F.coalesce(F.try_element_at(major, F.lit(1)), F.col("speaker")).alias("speaker"))
    inside = cells.where(F.col("len") > 2 * half).select(*KEY, (F.col("n0") + half).alias("n"), (F.col("c0") + half).alias("tick"), (F.col("len") - 2 * half).alias("ticks"), "speaker")
    d = cut_lineage(ends.unionByName(inside))
    b = _bucket("n", per_bucket)
    d = scan_over(d, KEY, ["n"], b, lag={"p": F.col("speaker")}, lead={"next_tick": F.col("tick")})
    d = islands(d, KEY, ["n"], b, F.col("p").isNull() | (F.col("p") != F.col("speaker")), "run")
    runs = d.groupBy(*KEY, "run", "speaker").agg(
        F.min("tick").alias("t0"), F.max_by(F.coalesce("next_tick", F.col("tick") + F.col("ticks") - 1), "n").alias("t1"), F.sum("ticks").alias("ticks"))
    return runs.join(first, KEY).select(
        *KEY, F.col("run").alias("id"), "speaker", (F.col("origin") + F.col("t0") * tick).alias("start"),
        (F.col("origin") + F.col("t1") * tick).alias("end"), "ticks")


def enforce_min_duration(turns: DataFrame, unit: float, width: float, minimum: float = 0.5) -> DataFrame:
    """Merge turns below ``minimum`` into a neighbour, same speaker first, else the more confident one.

    A turn merged forward swallows its successor.  Within a run of turns that all want to merge forward the
    swallowed ones are exactly the odd offsets, so the sequential rule becomes a parity over islands.
    """
    order, b = ["start", "id"], _bucket("start", width)
    cols = {c: F.struct("start", "end", "speaker", "confidence") for c in ("p", "n")}
    d = scan_over(turns, KEY, order, b, lag={"p": cols["p"]}, lead={"n": cols["n"]})
    short = F.col("end") - F.col("start") < minimum * unit
    has_p, has_n = F.col("p").isNotNull(), F.col("n").isNotNull()
    same_p, same_n = F.col("p.speaker") == F.col("speaker"), F.col("n.speaker") == F.col("speaker")
    forward = has_n & F.when(has_p & same_p, False).when(same_n, True).when(~has_p, True) \
        .otherwise(F.col("n.confidence") > F.col("p.confidence"))
    d = d.withColumn("target", F.when(short & forward, "next").when(short & has_p, "previous"))
    d = d.withColumn("m", F.coalesce(F.col("target") == "next", F.lit(False)))
    # position inside a run of forward mergers, and whether the previous turn merged forward
    d = scan_over(d, KEY, order, b, lag={"pm": F.col("m")}, upto={"at": ("sum", F.lit(1).cast("bigint"))})
    d = d.withColumn("pm", F.coalesce("pm", F.lit(False)))
    d = scan_over(d, KEY, order, b, upto={"run_from": ("max", F.when(~F.col("pm"), F.col("at")))})
    d = d.where((F.col("at") - F.col("run_from")) % 2 == 0)  # the others were swallowed
    t = F.when(F.col("target") == "next", F.col("n")).when(F.col("target") == "previous", F.col("p"))
    merged = F.col("target").isNotNull()
    return d.select(
        *KEY, "id", F.when(merged, F.least("start", t["start"])).otherwise(F.col("start")).alias("start"),
        F.when(merged, F.greatest("end", t["end"])).otherwise(F.col("end")).alias("end"),
        F.when(merged, t["speaker"]).otherwise(F.col("speaker")).alias("speaker"),
        F.when(merged, (F.col("confidence") + t["confidence"]) / 2).otherwise(F.col("confidence")).alias("confidence"),
        merged.alias("merged"))


def variant_agreement(segments: DataFrame, unit: float, width: float) -> DataFrame:
    """Shared time over union of durations for each pair of variants of a session, averaged per variant."""
    left, right = _sides(segments, ["variant"])
    near = interval_join(left, right, KEY, ("start1", "end1"), ("start2", "end2"), width).where("variant1 <> variant2")
    shared = near.groupBy(*KEY, "variant1", "variant2").agg(
        F.sum(F.least("end1", "end2") - F.greatest("start1", "start2")).alias("shared"))
    total = segments.groupBy(*KEY, "variant").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    a = total.select(*KEY, F.col("variant").alias("variant1"), F.col("total").alias("total1"))
    o = total.select(*KEY, F.col("variant").alias("variant2"), F.col("total").alias("total2"))
    pairs = a.join(o, KEY).where("variant1 <> variant2").join(shared, [*KEY, "variant1", "variant2"], "left")
    s = F.coalesce("shared", F.lit(0))
    union = F.greatest((F.col("total1") + F.col("total2") - s) / unit, F.lit(1e-6))
    per = pairs.groupBy(*KEY, "variant1").agg(F.avg(s / unit / union).alias("agreement"), F.count("*").alias("others"))
    return a.join(per, [*KEY, "variant1"], "left").select(
        *KEY, F.col("variant1").alias("variant"), F.coalesce("others", F.lit(0)).alias("others"),
        F.coalesce("agreement", F.lit(1.0)).alias("agreement"))


def patch_timeline(segments: DataFrame, frames: DataFrame, unit: float, width: float) -> DataFrame:
    """Remove what lies inside a frame, trim or split what reaches into one; frames of a session do not overlap.

    A segment minus all frames touching it is the list of gaps between them, so several frames need no loop.
    """
    f = frames.select(*KEY, F.col("start").alias("f0"), F.col("end").alias("f1"))
    near = interval_join(segments.select(*KEY, "id", "start", "end"), f, KEY, ("start", "end"), ("f0", "f1"), width) \
        .where("f0 < end and f1 > start")
    cuts = near.groupBy(*KEY, "id").agg(F.sort_array(F.collect_list(F.struct("f0", "f1"))).alias("cuts"))
    d = segments.join(cuts, [*KEY, "id"], "left")
    starts = F.concat(F.array("start"), F.col("cuts.f1"))
    ends = F.concat(F.col("cuts.f0"), F.array("end"))
    pieces = F.when(F.col("cuts").isNull(), F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))) \
        .otherwise(F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), z.alias("end"))))
    keep = F.filter(pieces, lambda x: x["end"] - x["start"] >= 0.05 * unit)
    return d.select(*KEY, "id", "speaker", "confidence", F.col("cuts").isNotNull().alias("trimmed"), F.inline(keep))


def clean_patches(patches: DataFrame, unit: float, width: float, minimum: float = 0.05, merge: float = 0.1) -> DataFrame:
    """Patches clipped to their frame, short or blank ones dropped, near ones of a speaker merged by duration.

    ``patches``: session_id, frame_id, f0, f1, id, speaker, start, end, text, confidence.
    """
    d = patches.withColumn("start", F.greatest("start", "f0")).withColumn("end", F.least("end", "f1")).where(
        (F.col("end") - F.col("start") >= minimum * unit) & (F.trim("text") != ""))
    keys = [*KEY, "frame_id", "speaker"]
    d = overlap_islands(d, keys, "start", "end", ["id"], width, merge * unit)
    dur = F.col("end") - F.col("start")
    text = F.sort_array(F.collect_list(F.struct("start", "id", "text")))
    m = d.groupBy(*keys, "island").agg(
        F.min("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.sum(F.col("confidence") * dur) / F.sum(dur)).alias("confidence"), F.count("*").alias("parts"),
        F.array_join(text["text"], " ").alias("text"))
    fixed = fix_boundaries(m, width).select(*KEY, "id", F.col("start").alias("x0"), F.col("end").alias("x1"))
    return m.join(fixed, [*KEY, "id"]).where("x1 > x0").select(
        *KEY, "frame_id", "speaker", "id", F.col("x0").alias("start"), F.col("x1").alias("end"), "confidence", "parts", "text")


def boundary_candidates(words: DataFrame, frames: DataFrame, unit: float, width: float, radius: float = 0.1,
                        keep: int | None = 5) -> DataFrame:
    """Energy frames around a word end, scored by edge strength and proximity; best five per word.

    ``words``: session_id, word_id, boundary (+ payload); ``frames``: session_id, ts, level, voiced.  The first and
    last frame inside the search range have no neighbour in range and are no candidates.
    """
    b = _bucket("ts", width)
    side = {"level": F.col("level"), "voiced": F.col("voiced"), "t": F.col("ts")}
    f = scan_over(frames, KEY, ["ts"], b, lag={f"p_{n}": c for n, c in side.items()},
                  lead={f"n_{n}": c for n, c in side.items()}).withColumnRenamed("ts", "ft").withColumn("ft2", F.col("ft"))
    w = words.withColumn("b0", F.col("boundary")).withColumn("b1", F.col("boundary"))
    near = interval_join(w, f, KEY, ("b0", "b1"), ("ft", "ft2"), width, radius * unit).drop("b0", "b1", "ft2")
    lo, hi = F.col("boundary") - radius * unit, F.col("boundary") + radius * unit
    near = near.where((F.col("p_t") >= lo) & (F.col("n_t") <= hi))
    edge = F.abs(F.col("n_level") - F.col("p_level")) + F.when(F.col("p_voiced") != F.col("n_voiced"), 0.5).otherwise(0.0)
    close = 1.0 - F.abs(F.col("ft") - F.col("boundary")) / (radius * unit)
    near = near.withColumn("score", F.round(edge * 0.7 + close * 0.3, 9))
    if keep is None:
        return near
    rank = Window.partitionBy(*KEY, "word_id").orderBy(F.desc("score"), "ft")
    return near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= keep)


def realign_boundaries(words: DataFrame, frames: DataFrame, unit: float, width: float) -> DataFrame:
    """Cheapest frame within 80 ms that leaves both words 50 ms; shifts unlike their neighbours are dropped.

    ``words``: session_id, word_id, start, end.  Columns: word_id, shift, score, confidence, applied.
    """
    b = _bucket("start", width)
    w = scan_over(words, KEY, ["start", "word_id"], b, lead={"n_end": F.col("end")}).where("n_end is not null") \
        .withColumn("boundary", F.col("end"))
    c = boundary_candidates(w, frames, unit, width)
    shift = F.abs(F.col("ft") - F.col("boundary")) / unit * 1000.0
    cost = F.round((1.0 - F.col("score")) * 0.6 + shift / 80.0 * 0.4, 9)
    ok = (shift <= 80.0) & (F.col("ft") - F.col("start") >= 0.05 * unit) & (F.col("n_end") - F.col("ft") >= 0.05 * unit)
    best = first_by(c.where(ok).withColumn("shift", shift).withColumn("cost", cost), [*KEY, "word_id"],
                    [F.col("cost"), F.col("rank")], ["start", "boundary", "ft", "shift", "score", "cost"])
    order, bb = ["start", "word_id"], b
    d = scan_over(best, KEY, order, bb, lag={"p1": F.col("shift")}, lead={"n1": F.col("shift")})
    d = scan_over(d, KEY, order, bb, lag={"p2": F.col("p1")}, lead={"n2": F.col("n1")})
    penalty = reduce(lambda x, y: x + y, [
        F.coalesce(F.abs(F.col("shift") - F.col(c)) * (1.0 / (k + 1)) * 0.1, F.lit(0.0))
        for c, k in (("p2", 2), ("p1", 1), ("n1", 1), ("n2", 2))])
    total = F.count("*")
    many = attach(d, KEY, shifts=total)
    conf = F.greatest(F.lit(0.1), 1.0 - F.col("cost") / 10.0 - penalty)
    conf = F.when(F.col("shifts") <= 1, 1.0 - F.col("cost") / 10.0).otherwise(conf)
    return many.select(*KEY, "word_id", F.col("boundary").alias("original"), F.col("ft").alias("adjusted"), "shift",
                       "score", conf.alias("confidence"), (F.round(conf, 9) >= 0.3).alias("applied"))


def snap_to_boundaries(turns: DataFrame, boundaries: DataFrame, unit: float, width: float, reach: float = 0.3,
                       minimum: float = 0.7) -> DataFrame:
    """Edges within 0.3 s of a trusted consensus boundary move to it; the latest boundary wins.

    ``boundaries``: session_id, t, confidence.
    """
    good = boundaries.where(F.col("confidence") >= minimum).select(*KEY, F.col("t").alias("t0"), F.col("t").alias("t1"))
    edges = turns.select(*KEY, "id", F.inline(F.array(
        F.struct(F.lit("start").alias("side"), F.col("start").alias("e0"), F.col("start").alias("e1")),
        F.struct(F.lit("end").alias("side"), F.col("end").alias("e0"), F.col("end").alias("e1")))))
    hit = interval_join(edges, good, KEY, ("e0", "e1"), ("t0", "t1"), width, reach * unit)
    moved = hit.groupBy(*KEY, "id").agg(
        F.max(F.when(F.col("side") == "start", F.col("t0"))).alias("m0"),
        F.max(F.when(F.col("side") == "end", F.col("t0"))).alias("m1"))
    return turns.join(moved, [*KEY, "id"], "left").select(
        *KEY, "id", "speaker", F.coalesce("m0", "start").alias("start"), F.coalesce("m1", "end").alias("end"),
        (F.when(F.col("m0").isNotNull(), 1).otherwise(0) + F.when(F.col("m1").isNotNull(), 1).otherwise(0)).alias("corrections"))
