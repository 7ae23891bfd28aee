"""Quality issues, disagreement, work lists, clips for review, repairs and human edits."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.strings import seq_ratio, set_jaccard
from chorale.operators.fold import fold_sorted
from chorale.operators.skew import attach, first_by, interval_join, overlap_islands, scan_over, top_n
from chorale.operators.turns import KEY, _bucket
from chorale.session import cut_lineage

# fixed values: level -> minimum final, d, a, l, r, o, segment confidence, outlier width in standard deviations
LEVELS = {
    "draft": (0.45, 0.35, 0.40, 0.30, 0.25, 0.25, 0.30, 1.5),
    "review": (0.60, 0.50, 0.55, 0.45, 0.40, 0.40, 0.45, 1.25),
    "final": (0.75, 0.65, 0.70, 0.60, 0.55, 0.55, 0.60, 1.0),
    "premium": (0.85, 0.75, 0.80, 0.70, 0.65, 0.65, 0.70, 0.8),
}
DIMENSION_ISSUES = {"d": "speaker_confusion", "a": "alignment_issue", "l": "linguistic_issue", "r": "transcription_error", "o": "overlap_issue"}


def severity(score: Column, minimum: float) -> Column:
    ratio = score / minimum
    return F.when(ratio < 0.5, "critical").when(ratio < 0.7, "high").when(ratio < 0.85, "medium").otherwise("low")


def quality_issues(segments: DataFrame, scores: DataFrame, level: str = "review") -> DataFrame:
    """One row per issue: segment id (-1 for the session), kind, severity, score.

    ``segments``: session_id, id, confidence, alignment, conflicts; ``scores``: session_id, final, d, a, l, r, o.
    """
    final, d, a, l, r, o, seg, width = LEVELS[level]
    s = attach(segments, KEY, mean=F.avg("confidence"), std=F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)))
    low = F.col("confidence") < seg
    rules = [
        (low, "low_confidence", severity(F.col("confidence"), seg), F.col("confidence")),
        (F.col("conflicts") > 0, "speaker_confusion", F.lit("high"), F.col("confidence")),
        (F.col("alignment") < 0.6, "alignment_issue", F.lit("medium"), F.col("alignment")),
        (~low & (F.round(F.col("confidence") - (F.col("mean") - width * F.col("std")), 9) < 0), "transcription_error", F.lit("medium"), F.col("confidence")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), v.alias("severity"), x.alias("score"))) for c, k, v, x in rules]))
    per_segment = s.select(*KEY, "id", F.inline(found))
    mins = dict(zip("dalro", (d, a, l, r, o)))
    dims = F.array_compact(F.array(*[F.when(F.col(x) < m, F.struct(
        F.lit(DIMENSION_ISSUES[x]).alias("kind"), severity(F.col(x), m).alias("severity"), F.col(x).alias("score"))) for x, m in mins.items()]))
    return per_segment.unionByName(scores.select(*KEY, F.lit(-1).cast("bigint").alias("id"), F.inline(dims)))


def assess_quality(segments: DataFrame, scores: DataFrame, level: str = "review") -> DataFrame:
    final, d, a, l, r, o, seg, _ = LEVELS[level]
    m = segments.groupBy(*KEY).agg(F.count("*").alias("segments"), F.avg("confidence").alias("mean"),
                                   F.count(F.when(F.col("confidence") < seg, 1)).alias("flagged"))
    i = quality_issues(segments, scores, level).groupBy(*KEY).agg(
        F.count("*").alias("issues"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")])
    q = m.join(scores, KEY).join(i, KEY, "left")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * F.col("final") + 0.3 * F.col("mean")))
    q = q.withColumn("quality", score)
    g = F.round("quality", 9)
    passes = (F.col("final") >= final) & (F.col("mean") >= seg) & (F.col("d") >= d) & (F.col("a") >= a) & (F.col("l") >= l)
    grade = F.when(g >= 0.85, "premium").when(g >= 0.75, "final").when(g >= 0.60, "review").otherwise("draft")
    return q.select(*KEY, "segments", "flagged", "mean", "quality", passes.alias("passes"), grade.alias("grade"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("issues", "critical", "high", "medium", "low")])


REPAIR_TYPES = {"low_confidence": "alternative_candidate", "speaker_confusion": "speaker_reassignment",
                "alignment_issue": "boundary_adjustment", "transcription_error": "text_correction"}


def repair_plan(issues: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Actions for critical and high issues, and for medium ones with a strong alternative, in order of worth.

    ``alternatives``: session_id, id, confidence, score, rank.
    """
    best = alternatives.groupBy(*KEY, "id").agg(F.max("confidence").alias("best_confidence"), F.max("score").alias("best_score"))
    d = issues.join(best, [*KEY, "id"], "left")
    kind, out = F.col("kind"), F
    for k, v in REPAIR_TYPES.items():
        out = out.when(kind == k, v)
    priority = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2) \
        .when((F.col("severity") == "medium") & (F.col("best_score") > 0.7), 1)
    gain = F.when(F.col("best_confidence").isNull(), 0.1).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best_confidence") - F.col("score"))))
    d = d.select(*KEY, "id", "kind", "severity", out.otherwise("manual_review").alias("repair_type"), priority.alias("priority"),
                 F.round(gain, 9).alias("improvement")).where("priority is not null")
    # rank without a per-session task: rows counted per (priority, improvement) and summed in order
    d = d.withColumn("po", -F.col("priority")).withColumn("io", -F.col("improvement"))
    ranked = scan_over(d, KEY, ["po", "io", "id", "kind"], F.col("po").cast("bigint"), upto={"place": ("sum", F.lit(1).cast("bigint"))})
    return ranked.drop("po", "io")


def apply_repairs(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Replace text and confidence of repaired segments; ``chosen``: session_id, id, new_text, new_confidence."""
    d = segments.join(chosen, [*KEY, "id"], "left")
    return d.select(*KEY, "id", F.coalesce("new_text", "text").alias("text"), F.col("confidence").alias("old_confidence"),
                    F.coalesce("new_confidence", "confidence").alias("confidence"), F.col("new_confidence").isNotNull().alias("repaired"))


def repair_report(repaired: DataFrame, threshold: float = 0.05) -> DataFrame:
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") - F.col("old_confidence")))
    good = F.col("repaired") & (F.round(gain, 9) > threshold)
    m = repaired.groupBy(*KEY).agg(
        F.count("*").alias("segments"), F.count(F.when(F.col("repaired"), 1)).alias("repaired"), F.count(F.when(good, 1)).alias("successful"),
        F.avg(F.when(good, gain)).alias("g"), F.avg("confidence").alias("mean_confidence"))
    return m.select(*KEY, "segments", "repaired", "successful", F.coalesce("g", F.lit(0.0)).alias("average_improvement"),
                    (F.col("successful") / F.greatest("repaired", F.lit(1))).alias("success_rate"), "mean_confidence")


def uncertain_spans(segments: DataFrame, unit: float, width: float, entropy_min: float = 2.5, gap_min: float = 0.3,
                    span: tuple[float, float] = (2.0, 30.0), score_min: float = 0.6) -> DataFrame:
    """Spans where engines disagree: time groups, three detectors, merged and filtered.

    ``segments``: session_id, id, start, end, text, confidence.
    """
    d = overlap_islands(segments, KEY, "start", "end", ["id"], width, 0.5 * unit, ).withColumnRenamed("island", "grp")
    d = cut_lineage(d.select(*KEY, "grp", "id", "start", "end", "text", "confidence"))  # read by three aggregations
    g = [*KEY, "grp"]
    base = d.groupBy(*g).agg(
        F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("text").alias("texts"),
        (F.max("confidence") - F.min("confidence")).alias("gap")).where("n > 1")
    words = d.select(*g, "id", F.posexplode(F.split(F.trim(F.lower("text")), r"\s+")).alias("p", "w"))
    placed = words.groupBy(*g, "p", "w").agg(F.count("*").alias("c"))
    counts = placed.groupBy(*g, "w").agg(F.sum("c").alias("c"))
    ent = counts.groupBy(*g).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))
    per_pos = placed.groupBy(*g, "p").agg(F.count("*").alias("k"), F.sum("c").alias("held")).join(base.select(*g, "n"), g)
    dis = per_pos.groupBy(*g).agg(F.avg(F.when((F.col("k") > 1) | (F.col("held") < F.col("n")), 1.0).otherwise(0.0)).alias("disagreement"))
    s = base.join(ent, g).join(dis, g).withColumn("gap", F.round("gap", 9))
    cross = F.round(F.least(F.lit(1.0), (F.col("texts") - 1) * 0.3 + F.col("gap") * 0.4 + F.col("disagreement") * 0.3), 9)
    long_enough = F.col("end") - F.col("start") >= span[0] * unit
    found = F.array_compact(F.array(
        F.when((F.col("texts") > 1) & (cross >= score_min) & (F.col("gap") >= gap_min), F.struct(F.lit("disagreement").alias("method"), cross.alias("score"), F.lit(0.0).alias("e"))),
        F.when(F.col("entropy") >= entropy_min, F.struct(F.lit("entropy").alias("method"), F.least(F.lit(1.0), F.col("entropy") / 5.0).alias("score"), F.col("entropy").alias("e"))),
        F.when(F.col("gap") >= gap_min, F.struct(F.lit("confidence_gap").alias("method"), F.least(F.lit(1.0), F.col("gap") / 0.5).alias("score"), F.lit(0.0).alias("e")))))
    spans = cut_lineage(s.where(long_enough).select(*KEY, "grp", "start", "end", "gap", F.inline(found)))  # few rows, scanned four times
    merged = overlap_islands(spans, KEY, "start", "end", ["method"], width, 0.5 * unit, ).groupBy(*KEY, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.max("e").alias("entropy"),
        F.max("gap").alias("gap"), F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"))
    dur = F.col("end") - F.col("start")
    by = (F.col("methods").contains("entropy") & (F.col("entropy") >= entropy_min)) | (F.col("methods").contains("confidence_gap") & (F.col("gap") >= gap_min)) \
        | F.col("methods").contains("disagreement")
    return merged.where((dur >= span[0] * unit) & (dur <= span[1] * unit) & (F.round("score", 9) >= score_min) & by).drop("island")


def rank_spans(spans: DataFrame, unit: float, keep: int = 10) -> DataFrame:
    p = F.col("score") * 0.4 + F.col("gap") * 0.3 + F.col("entropy") / 5.0 * 0.2 + F.least((F.col("end") - F.col("start")) / unit / 10.0, F.lit(1.0)) * 0.1
    return top_n(spans.withColumn("priority", F.round(p, 9)), KEY, [F.desc("priority"), F.asc("start")], keep)


def segment_agreement(voters: DataFrame, unit: float, threshold: float = 0.65) -> DataFrame:
    """Agreement of the candidates' texts over each interval.

    ``voters``: ``collect_voters`` output, one row per interval and candidate, so pairs are candidate pairs.
    """
    k = [*KEY, "i_start", "i_end"]
    v = voters.withColumn("words", F.array_distinct(F.split(F.lower(F.trim("text")), r"\s+"))).withColumn("n", F.size(F.split(F.trim("text"), r"\s+")))
    side = lambda i: v.select(*k, *[F.col(c).alias(f"{c}{i}") for c in ("candidate_id", "words", "text")])
    pairs = side(1).join(side(2), k).where("candidate_id1 < candidate_id2")
    sim = pairs.withColumn("edit", seq_ratio("text1", "text2")).groupBy(*k).agg(
        F.avg(set_jaccard(F.col("words1"), F.col("words2"))).alias("lexical"), F.avg("edit").alias("edit"))
    m = v.groupBy(*k).agg(F.count("*").alias("voters"), F.stddev_pop("n").alias("ls"), F.avg("n").alias("lm"),
                          F.stddev_pop("confidence").alias("cs"), F.var_pop("confidence").alias("cv"))
    t = v.groupBy(*k, "text").agg(F.count("*").alias("c"), F.min("candidate_id").alias("first"))
    agreed = t.groupBy(*k).agg(
        F.max("c").alias("top"), F.min_by("text", F.struct((-F.col("c")).alias("c"), "first")).alias("most"),
        F.min_by("text", F.struct((-F.length("text")).alias("l"), "first")).alias("longest"))
    d = m.where("voters >= 2").join(sim, k).join(agreed, k)
    length = F.greatest(F.lit(0.0), 1.0 - F.col("ls") / F.greatest("lm", F.lit(1.0)))
    conf = 1.0 - F.col("cs")
    overall = 0.3 * F.col("lexical") + 0.2 * length + 0.2 * conf + 0.3 * F.col("edit")
    d = d.withColumn("length", length).withColumn("conf", conf).withColumn("agreement", F.round(overall, 9))
    rank = F.floor((1.0 - F.col("agreement")) * 10) + F.least((F.col("i_end") - F.col("i_start")) / unit / 10.0, F.lit(1.0)) * 2 \
        + F.least(F.col("cv") * 5, F.lit(1.0)) * 2
    return d.select(*k, "voters", "lexical", "length", "conf", "edit", "agreement",
                    F.when(F.col("top") > 1, F.col("most")).otherwise(F.col("longest")).alias("consensus"),
                    (F.col("agreement") < threshold).alias("needs_work"),
                    F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.round(rank, 9)))).alias("priority"))


ENTITY_PRIORITY = {"phone_number": 1, "email": 1, "currency": 2, "percentage": 2, "date": 2, "time": 3, "alphanumeric_code": 1, "number": 3}


def entity_agreement(entities: DataFrame, tolerance: int = 10, agree: float = 0.7, sure: float = 0.8) -> DataFrame:
    """Entities of one type that several providers place within 10 characters.

    ``entities``: session_id, segment, provider, entity_type, entity, start_char, end_char, confidence.  Spans are
    grouped by exact islands over their widened extent, in order of position.
    """
    k = [*KEY, "segment", "entity_type"]
    d = overlap_islands(entities, k, "start_char", "end_char", ["provider", "entity"], 10_000, tolerance)
    g = [*k, "island"]
    t = d.groupBy(*g, "entity").agg(F.count("*").alias("c"), F.sum("confidence").alias("s"), F.collect_set("provider").alias("ps"), F.min("start_char").alias("at"))
    m = t.groupBy(*g).agg(
        F.sum("c").alias("n"), F.count("*").alias("variations"), F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("providers"),
        (F.sum("s") / F.sum("c")).alias("confidence"), F.max("c").alias("top"), F.min("at").alias("start_char"),
        F.min_by("entity", F.struct((-F.col("c")).alias("c"), "at", "entity")).alias("dominant")).where("providers > 1")
    a = F.col("top") / F.col("n")
    base, kind = F, F.col("entity_type")
    for name, p in ENTITY_PRIORITY.items():
        base = base.when(kind == name, p)
    base = base.otherwise(5)
    c = F.round("confidence", 9)
    priority = F.when((a < 0.3) | (c < 0.5), F.greatest(F.lit(1), base - 2)).when((a > 0.8) & (c > 0.9), F.least(F.lit(5), base + 1)).otherwise(base)
    return m.select(*KEY, "segment", "entity_type", "start_char", "n", "providers", "variations", "dominant", a.alias("agreement"),
                    "confidence", ((a < agree) | (c < sure)).alias("requires_reask"), priority.alias("priority"))


def build_worklist(segments: DataFrame, unit: float, threshold: float = 0.65, manual: DataFrame | None = None) -> DataFrame:
    """Low-confidence segments with a priority from confidence and length; manual flags are added."""
    p = F.greatest(F.lit(1), F.floor(F.round((1.0 - F.col("confidence")) * 7, 9)) + 1)
    dur = (F.col("end") - F.col("start")) / unit
    p = F.when(dur > 10.0, F.least(F.lit(10), p + 1)).when(dur < 2.0, F.greatest(F.lit(1), p - 1)).otherwise(p)
    flags = segments.where(F.round("confidence", 9) < threshold).select(*KEY, "id", "start", "end", "confidence", p.alias("priority"), F.lit("automatic").alias("source"))
    return flags if manual is None else flags.unionByName(manual)


def next_work(flags: DataFrame, n: int) -> DataFrame:
    return top_n(flags, KEY, [F.desc("priority"), F.asc("confidence"), F.asc("id"), F.asc("source")], n, "place")


def worklist_summary(flags: DataFrame) -> DataFrame:
    """``flags``: session_id, confidence, new_confidence (null while pending)."""
    gain = F.col("new_confidence") - F.col("confidence")
    done = F.col("new_confidence").isNotNull()
    return flags.groupBy(*KEY).agg(
        F.count("*").alias("flagged"), F.count(F.when(done, 1)).alias("processed"), F.count(F.when(done & (F.round(gain, 9) > 0.05), 1)).alias("improved"),
        (F.coalesce(F.sum(gain), F.lit(0.0)) / F.greatest(F.count(F.when(done, 1)), F.lit(1))).alias("average_improvement"),
        F.count(F.when(~done, 1)).alias("pending"))


def apply_budget(segments: DataFrame, order: list[str], bucket: Column, max_cost: float, n: int = 20) -> DataFrame:
    """The longest prefix in order within the cost limit and the count limit; costs are not negative."""
    d = scan_over(segments, KEY, order, bucket, upto={"spent": ("sum", F.col("cost")), "place": ("sum", F.lit(1).cast("bigint"))})
    return d.withColumn("taken", (F.round("spent", 9) <= max_cost) & (F.col("place") <= n))


def stem_gates(stems: DataFrame, keys: list[str], min_snr: float = 12.0, max_leakage: float = 0.12, max_artifact: float = 0.5) -> DataFrame:
    """Mean SNR, upper median leakage and mean artefact per group with the first failed gate.

    The upper median comes from a histogram of values, not from a list of the group.
    """
    m = stems.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("snr").alias("snr"), F.avg("artifact").alias("artifact"))
    h = stems.groupBy(*keys, "leakage").agg(F.count("*").alias("c"))
    run = scan_over(h, keys, ["leakage"], F.floor(F.col("leakage") * 1000), upto={"cum": ("sum", F.col("c"))})
    med = run.join(m.select(*keys, "n"), keys).where(F.col("cum") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min("leakage").alias("leakage"))
    d = m.join(med, keys)
    reason = F.when(F.round("snr", 9) < min_snr, "avg_snr_too_low").when(F.col("leakage") > max_leakage, "median_leakage_too_high") \
        .when(F.round("artifact", 9) > max_artifact, "avg_artifacts_too_high").otherwise("quality_gates_passed")
    return d.withColumn("reason", reason).withColumn("passed", F.col("reason") == "quality_gates_passed")


def uncertainty_windows(segments: DataFrame, unit: float, size: float = 8.0, step: float = 4.0) -> DataFrame:
    """8 s windows every 4 s; speaker changes are counted between segments of the same window less than 2 s apart."""
    w0 = F.greatest(F.floor((F.col("start") / unit - size) / step) + 1, F.lit(0))
    w1 = F.ceil(F.col("end") / unit / step) - 1
    words = F.split(F.trim("text"), r"\s+")
    complex_word = lambda w: (F.length(w) > 8) | ((w == F.upper(w)) & w.rlike(r"\p{Lu}")) | w.rlike(r"\p{Nd}")
    d = segments.withColumn("complexity", F.least(F.size(F.filter(words, complex_word)) / F.greatest(F.size(words), F.lit(1)) * 0.3, F.lit(0.2)))
    d = d.where(w1 >= w0).select(*KEY, "id", "speaker", "start", "end", "confidence", "complexity", F.explode(F.sequence(w0, w1)).alias("window"))
    k = [*KEY, "window"]
    ends = d.select(*k, "id", "speaker", "end").withColumn("bin", F.floor(F.col("end") / unit / 2.0)).withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    starts = d.select(*k, F.col("speaker").alias("other"), F.col("start").alias("other_start")).withColumn("near", F.floor(F.col("other_start") / unit / 2.0))
    # only segments starting within 2 s of an end can count, so the pair join is keyed on a 2 s bin
    ch = ends.join(starts, [*k, "near"]).where((F.col("speaker") != F.col("other")) & (F.abs(F.col("other_start") - F.col("end")) < 2.0 * unit)) \
        .groupBy(*k, "id").agg(F.count("*").alias("changes"))
    d = d.join(ch, [*k, "id"], "left")
    part = (1.0 - F.col("confidence")) * 0.4 + F.least(F.coalesce("changes", F.lit(0)) * 0.2, F.lit(0.3)) + F.col("complexity")
    return d.groupBy(*k).agg(F.count("*").alias("segments"), F.least(F.sum(part), F.lit(1.0)).alias("uncertainty"),
                             F.min("start").alias("s0"), F.max("end").alias("s1"))


def select_hotspots(segments: DataFrame, unit: float, budget_min: float = 5.0, review_rate: float = 1.5, clip: tuple[float, float] = (15.0, 30.0),
                    radius: float = 2.0, buckets: int = 3) -> DataFrame:
    """Review clips: windows in order of uncertainty, neighbours suppressed, within the listening budget, then the best
    clip of each third of the recording.  The fold keeps only the chosen clips, a handful by the budget."""
    w = uncertainty_windows(segments, unit)
    total = segments.groupBy(*KEY).agg((F.max("end") / unit).alias("total"))
    d = w.join(total, KEY).select(*KEY, "window", "total", (-F.round("uncertainty", 9)).alias("rank"),
                                  (F.col("s0") / unit).alias("a"), (F.col("s1") / unit).alias("z"))
    budget = budget_min * 60 / review_rate

    def step(state, pdf):
        used, regions = state or (0.0, [])
        out = []
        for sid, win, total_s, rank, a, z in zip(*[pdf[c].tolist() for c in ("session_id", "window", "total", "rank", "a", "z")]):
            if used >= budget:
                break
            lo, hi = win * 4.0, win * 4.0 + 8.0
            if any(lo < e and hi > s for s, e in regions):
                continue
            if z - a < clip[0]:
                a = max(0.0, a - (clip[0] - (z - a)) / 2)
                z = a + clip[0]
            elif z - a > clip[1]:
                z = a + clip[1]
            used += z - a
            regions = regions + [(max(0.0, a - (z - a) * radius), z + (z - a) * radius)]
            out.append((sid, a, z, -rank, min(int(a // (total_s / buckets)), buckets - 1)))
        return (used, regions), pd.DataFrame(out, columns=["session_id", "clip_start", "clip_end", "uncertainty", "bucket"])

    clips = fold_sorted(d, KEY, ["rank", "window"], "session_id bigint, clip_start double, clip_end double, uncertainty double, bucket int", step)
    return first_by(clips, [*KEY, "bucket"], [-F.col("uncertainty"), F.col("clip_start")], ["clip_start", "clip_end", "uncertainty"])


def apply_edits(segments: DataFrame, edits: DataFrame, speaker_map: DataFrame | None = None) -> DataFrame:
    """Human edits reach the segments sharing enough words with the edited text; later edits win; names are mapped last.

    ``segments``: session_id, id, speaker, text; ``edits``: session_id, edit_id, original_text, new_speaker, new_text.
    Candidates come from an equi-join on shared words, so no edit meets an unrelated segment.
    """
    toks = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    e = edits.withColumn("need", F.least(F.lit(3), F.floor(F.size(toks("original_text")) / 2)))
    ew = e.select(*KEY, "edit_id", "need", F.explode(toks("original_text")).alias("w"))
    sw = segments.select(*KEY, "id", F.explode(toks("text")).alias("w"))
    hit = ew.join(sw, [*KEY, "w"]).groupBy(*KEY, "id", "edit_id", "need").agg(F.count("*").alias("shared")).where("shared >= need")
    trivial = e.where("need = 0").select(*KEY, "edit_id").join(segments.select(*KEY, "id"), KEY)
    hit = hit.select(*KEY, "id", "edit_id").unionByName(trivial.select(*KEY, "id", "edit_id")).distinct()
    last = hit.join(edits, [*KEY, "edit_id"]).groupBy(*KEY, "id").agg(
        F.max_by("new_speaker", F.when(F.col("new_speaker").isNotNull(), F.col("edit_id"))).alias("new_speaker"),
        F.max_by("new_text", F.when(F.trim("new_text") != "", F.col("edit_id"))).alias("new_text"), F.count("*").alias("edits"))
    d = segments.join(last, [*KEY, "id"], "left").withColumn("speaker", F.coalesce("new_speaker", "speaker")).withColumn("text", F.coalesce("new_text", "text"))
    if speaker_map is not None:
        d = d.join(speaker_map.select(F.col("speaker"), F.col("name").alias("_name")), "speaker", "left").withColumn("speaker", F.coalesce("_name", "speaker"))
    return d.select(*KEY, "id", "speaker", "text", F.coalesce("edits", F.lit(0)).alias("edits"))
