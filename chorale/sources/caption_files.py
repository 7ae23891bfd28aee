"""Whole caption, annotation and master files of every session: the lines of each file in order, and writers that put them into text files.

``segments`` has session_id, id, speaker, start, end (milliseconds) and text.  ``part``, ``at`` and ``id`` order the lines of a file; a line may
hold line breaks.  White space around line breaks of a text is dropped, so no blank line ends a cue early.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.strings import fmt_ass, fmt_clock, fmt_duration, fmt_srt, fmt_vtt
from chorale.operators.skew import scan_over
from chorale.operators.turns import KEY, _bucket
from chorale.sources.session_files import TXT_END, write_session_files
from chorale.sources.sinks import ASS_EVENTS, SPEAKER_COLOURS, rttm_lines

ORDER = ["part", "at", "id"]
HEAD, STYLES, EVENTS, CUES, FOOT = range(5)
#: Default values of a styled file; the format asks for none of them.
FONT, TITLE = "Sans,18", "Transcript"
STYLE_FORMAT = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
#: Slots of a WebVTT page from the top, in tenths of its height; later speakers share the middle.
VTT_SLOTS = 9


def clean_text() -> Column:
    return F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s*\n\s*", "\n")


def spoken(segments: DataFrame, width: float) -> DataFrame:
    """Segments with a text, with ordinal (all segments count), cue (spoken ones count), slot (speakers by first segment) and the speaker before."""
    b = _bucket("start", width)
    d = segments.withColumn("text", F.coalesce(clean_text(), F.lit("")))
    d = scan_over(d, KEY, ["start", "id"], b, upto={"ordinal": ("sum", F.lit(1).cast("bigint")), "cue": ("sum", F.when(F.col("text") != "", 1).otherwise(0).cast("bigint"))}).where("text <> ''")
    slots = speaker_slots(segments, width)
    return scan_over(d.join(slots, [*KEY, "speaker"]), KEY, ["start", "id"], b, lag={"before": F.col("speaker")})


def speaker_slots(segments: DataFrame, width: float) -> DataFrame:
    first = segments.groupBy(*KEY, "speaker").agg(F.min(F.struct("start", "id")).alias("first")).select(*KEY, "speaker", "first.start", "first.id")
    return scan_over(first, KEY, ["start", "id"], _bucket("start", width), upto={"slot": ("sum", F.lit(1).cast("bigint"))}).select(*KEY, "speaker", "slot")


def cue_text(fmt: str) -> Column:
    text, speaker = F.col("text"), F.col("speaker")
    if fmt == "srt":
        return F.format_string("%d\n%s --> %s\n%s: %s\n", F.col("cue"), fmt_srt("start"), fmt_srt("end"), speaker, text)
    if fmt == "vtt":
        place = F.when(F.col("slot") <= VTT_SLOTS, F.col("slot") * 10).otherwise(F.lit(50))
        return F.format_string("cue-%d\n%s --> %s line:%d%%\n<v %s>%s\n", F.col("ordinal"), fmt_vtt("start"), fmt_vtt("end"), place, speaker, text)
    if fmt == "ass":
        escaped = F.regexp_replace(F.regexp_replace(text, r"([\\{}])", r"\\$1"), "\n", r"\\N")
        return F.format_string("Dialogue: 0,%s,%s,%s,,0,0,0,,%s", fmt_ass("start"), fmt_ass("end"), F.translate(speaker, ",", ";"), escaped)
    line = F.format_string("[%s] %s: %s", fmt_clock("start"), speaker, F.translate(text, "\n", " "))
    return F.when(F.col("before") != speaker, F.concat(F.lit("\n"), line)).otherwise(line)


def caption_files(segments: DataFrame, fmt: str, width: float, title: str = TITLE, font: str = FONT) -> DataFrame:
    """session_id, part, at, id, line: every line of each session's ``srt``, ``vtt``, ``ass`` or ``txt`` file."""
    kinds = dict(segments.dtypes)

    def lines(df: DataFrame, part: int, line: Column, at: Column = F.lit(0)) -> DataFrame:
        return df.select(*KEY, F.lit(part).alias("part"), at.cast(kinds["start"]).alias("at"), F.lit(0).cast(kinds["id"]).alias("id"), line.alias("line"))

    cues = spoken(segments, width)
    out = cues.select(*KEY, F.lit(CUES).alias("part"), F.col("start").alias("at"), "id", cue_text(fmt).alias("line"))
    sessions = segments.select(*KEY).distinct()
    if fmt == "vtt":
        out = out.unionByName(lines(sessions, HEAD, F.lit("WEBVTT\n")))
    if fmt == "ass":
        slots = speaker_slots(segments, width)
        colour = F.element_at(F.array(*[F.lit(c[4:] + c[2:4] + c[:2]) for c in SPEAKER_COLOURS]), ((F.col("slot") - 1) % len(SPEAKER_COLOURS) + 1).cast("int"))  # blue first
        style = F.format_string(f"Style: %s,{font},&H%s,&H000000,&H000000,&H80000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1", F.translate("speaker", ",", ";"), colour)
        head = f"[Script Info]\nTitle: {title}\nScriptType: v4.00+\nCollisions: Normal\nPlayDepth: 0\n\n[V4+ Styles]\n{STYLE_FORMAT}"
        out = out.unionByName(lines(sessions, HEAD, F.lit(head))).unionByName(lines(slots, STYLES, style, F.col("slot"))).unionByName(lines(sessions, EVENTS, F.lit(ASS_EVENTS)))
    if fmt == "txt":
        totals = segments.groupBy(*KEY).agg(F.max("end").alias("end"), F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"))
        head = F.format_string(f"{title}\n\nDuration: %s\nSegments: %d\nSpeakers: %d\n\nParticipants:", fmt_duration("end"), F.col("segments"), F.col("speakers"))
        out = out.unionByName(lines(totals, HEAD, head)).unionByName(lines(speaker_slots(segments, width), STYLES, F.concat(F.lit("  • "), "speaker"), F.col("slot")))
        out = out.unionByName(lines(sessions, EVENTS, F.lit(f"\n{TXT_END}\n"))).unionByName(lines(sessions, FOOT, F.lit(f"\n{TXT_END}\nEnd")))
    return out


def write_caption_files(segments: DataFrame, fmt: str, path: str, width: float, buckets: int = 64, **look: str) -> None:
    write_session_files(caption_files(segments, fmt, width, **look), path, fmt, ORDER, buckets)


def write_rttm_files(segments: DataFrame, path: str, unit: float, buckets: int = 64) -> None:
    write_session_files(rttm_lines(segments, unit), path, "rttm", ["start", "id"], buckets)


def master_files(segments: DataFrame, winners: DataFrame, width: float, unit: float) -> DataFrame:
    """session_id, part, at, id, line: a JSON document a session with metadata, speaker names, provenance and the winner's segments in order."""
    d = segments.join(winners.select(*KEY, "candidate_id"), [*KEY, "candidate_id"])
    d = scan_over(d, KEY, ["start", "id"], _bucket("start", width), upto={"ordinal": ("sum", F.lit(1).cast("bigint"))})
    name = F.concat(F.lit("Speaker "), F.col("speaker").cast("string"))
    body = F.to_json(F.struct("ordinal", (F.col("start") / unit).alias("start"), (F.col("end") / unit).alias("end"), name.alias("speaker"), F.col("speaker").alias("speaker_id"), "text", "confidence"))
    rows = d.select(*KEY, F.lit(CUES).alias("part"), F.col("ordinal").alias("at"), F.concat(F.when(F.col("ordinal") > 1, ",").otherwise(""), body).alias("line"))
    heads = d.groupBy(*KEY, "candidate_id").agg(F.max("end").alias("end"), F.count("*").alias("n"), F.collect_set("speaker").alias("names"))
    names = F.map_from_arrays(F.sort_array("names"), F.transform(F.sort_array("names"), lambda x: F.concat(F.lit("Speaker "), x.cast("string"))))
    head = F.to_json(F.struct(
        F.col("session_id").cast("string").alias("session_id"),
        F.struct(F.lit("1.0").alias("version"), (F.col("end") / unit).alias("total_duration"), F.col("n").alias("total_segments"), F.size("names").alias("speaker_count")).alias("metadata"),
        names.alias("speaker_map"), F.struct(F.col("candidate_id").cast("string").alias("candidate_id")).alias("provenance")))
    opening = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"segments":['))
    edge = lambda part, line: heads.select(*KEY, F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("at"), line.alias("line"))
    return rows.unionByName(edge(HEAD, opening)).unionByName(edge(FOOT, F.lit("]}")))


def write_master_files(segments: DataFrame, winners: DataFrame, path: str, width: float, unit: float, buckets: int = 64) -> None:
    write_session_files(master_files(segments, winners, width, unit), path, "json", ["part", "at"], buckets)
