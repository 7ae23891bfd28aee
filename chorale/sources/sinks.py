"""Sinks: speaker annotations, captions, master transcripts, run reports and term-base snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.strings import fmt_ass, fmt_clock, fmt_srt, fmt_vtt
from chorale.operators.skew import scan_over
from chorale.operators.turns import KEY, _bucket

# fixed values: colours of speakers and the head of a caption file with styles
SPEAKER_COLOURS = ["FF6B6B", "4ECDC4", "45B7D1", "96CEB4", "FFEAA7", "DDA0DD", "98D8C8", "F7DC6F", "BB8FCE", "85C1E9"]
ASS_HEAD = """[Script Info]
Title: Ensemble Transcription
ScriptType: v4.00+
Collisions: Normal
PlayDepth: 0

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"""
ASS_EVENTS = """
[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"""


def rttm_lines(segments: DataFrame, unit: float) -> DataFrame:
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("session_id").cast("string"), F.col("start") / unit, (F.col("end") - F.col("start")) / unit, F.col("speaker"))
    return segments.select(*KEY, "start", "id", line.alias("line"))


def write_rttm(segments: DataFrame, path: str, unit: float, buckets: int = 64) -> None:
    write_by_session(rttm_lines(segments, unit), path, ["start", "id"], buckets)


def caption_lines(segments: DataFrame, fmt: str, width: float) -> DataFrame:
    """One caption cue per spoken segment.  SRT counts only spoken segments, WebVTT keeps the raw ordinal.

    ``segments``: session_id, id, speaker, start, end (ms), text.  Speaker slots follow first appearance.
    """
    b = _bucket("start", width)
    said = F.trim("text") != ""
    d = scan_over(segments, KEY, ["start", "id"], b, upto={
        "ordinal": ("sum", F.lit(1).cast("bigint")), "cue": ("sum", F.when(said, 1).otherwise(0).cast("bigint"))}).where(said)
    first = segments.groupBy(*KEY, "speaker").agg(F.min(F.struct("start", "id")).alias("first"))
    slot = scan_over(first.select(*KEY, "speaker", "first.start", "first.id"), KEY, ["start", "id"], b, upto={"slot": ("sum", F.lit(1).cast("bigint"))}).select(*KEY, "speaker", "slot")
    d = d.join(slot, [*KEY, "speaker"])
    text = F.trim("text")
    cue = {
        "srt": F.format_string("%d\n%s --> %s\n%s: %s\n", F.col("cue"), fmt_srt("start"), fmt_srt("end"), F.col("speaker"), text),
        "vtt": F.format_string("%d\n%s --> %s\n<v %s>%s\n", F.col("ordinal"), fmt_vtt("start"), fmt_vtt("end"), F.col("speaker"), text),
        "ass": F.format_string("Dialogue: 0,%s,%s,Speaker%d,%s,0,0,0,,%s", fmt_ass("start"), fmt_ass("end"), F.col("slot"), F.col("speaker"), text),
        "txt": F.format_string("[%s] %s: %s", fmt_clock("start"), F.col("speaker"), text),
    }[fmt]
    return d.select(*KEY, "start", "id", "cue", "slot", cue.alias("line"))


def caption_document(segments: DataFrame, fmt: str, width: float) -> DataFrame:
    """Every line of each session's caption file; (part, start, id) orders them: head, styles, event head, cues."""
    cues = caption_lines(segments, fmt, width)
    kinds = dict(cues.dtypes)

    def lines(df: DataFrame, part: int, line: Column, order: Column) -> DataFrame:
        return df.select(*KEY, F.lit(part).alias("part"), order.cast(kinds["start"]).alias("start"), F.lit(0).cast(kinds["id"]).alias("id"), line.alias("line"))

    out = cues.select(*KEY, F.lit(3).alias("part"), "start", "id", "line")
    sessions = segments.select(*KEY).distinct()
    if fmt == "vtt":
        out = out.unionByName(lines(sessions, 0, F.lit("WEBVTT\n"), F.lit(0)))
    if fmt == "ass":
        colour = F.element_at(F.array(*[F.lit(c[4:] + c[2:4] + c[:2]) for c in SPEAKER_COLOURS]), ((F.col("slot") - 1) % len(SPEAKER_COLOURS) + 1).cast("int"))  # blue first
        style = F.format_string("Style: Speaker%d,Arial,20,&H%s,&H000000,&H000000,&H80000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1", F.col("slot"), colour)
        out = out.unionByName(lines(sessions, 0, F.lit(ASS_HEAD), F.lit(0))).unionByName(lines(cues.select(*KEY, "slot").distinct(), 1, style, F.col("slot"))) \
            .unionByName(lines(sessions, 2, F.lit(ASS_EVENTS), F.lit(0)))
    return out


def write_by_session(lines: DataFrame, path: str, order: list[str], buckets: int) -> None:
    """Parquet in ``buckets`` folders by session hash: few large files, each session's lines sorted and together."""
    d = lines.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    keys = ["bucket", "session_id", *order]
    d.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_captions(segments: DataFrame, fmt: str, path: str, width: float, buckets: int = 64) -> None:
    write_by_session(caption_document(segments, fmt, width), path, ["part", "start", "id"], buckets)


def master_transcript(segments: DataFrame, unit: float) -> DataFrame:
    """Per-session metadata; the ordered segments themselves stay rows (see ``master_segments``)."""
    return segments.groupBy(*KEY).agg((F.max("end") / unit).alias("duration"), F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"),
                                      F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speaker_map"))


def master_segments(segments: DataFrame, winners: DataFrame, width: float) -> DataFrame:
    """Segments of the winning candidate numbered in time order, with their provenance, as JSON lines."""
    d = segments.join(winners.select(*KEY, "candidate_id"), [*KEY, "candidate_id"])
    d = scan_over(d, KEY, ["start", "id"], _bucket("start", width), upto={"ordinal": ("sum", F.lit(1).cast("bigint"))})
    return d.withColumn("json", F.to_json(F.struct("ordinal", "start", "end", "speaker", "text", F.struct("candidate_id").alias("provenance"))))


def write_master(segments: DataFrame, winners: DataFrame, path: str, width: float, buckets: int = 64) -> None:
    write_by_session(master_segments(segments, winners, width).select("session_id", "ordinal", "json"), path, ["ordinal"], buckets)


def write_reports(reports: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, df in reports.items():
        out = df.write.mode("overwrite")
        (out.option("header", True).csv if fmt == "csv" else out.parquet)(f"{path}/{name}")


def combine_reports(runs: dict[str, DataFrame]) -> DataFrame:
    out = None
    for run, df in runs.items():
        d = df.withColumn("run_id", F.lit(run))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def write_term_base(base: DataFrame, path: str, version: int) -> str:
    """Versioned snapshot by project; a rerun of the same version replaces itself."""
    target = f"{path}/version={int(version)}"
    base.write.mode("overwrite").partitionBy("project_id").parquet(target)
    return target
