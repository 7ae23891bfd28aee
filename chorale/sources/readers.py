"""Readers: nested JSON documents to flat tables, history reports and append-only event logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chorale import schemas as S


def candidate_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Flat candidate, segment and word tables; words come from the recogniser, else from the segments.

    Blank words and negative starts are dropped, missing confidence is 0.
    """
    k = ["session_id", "candidate_id"]
    cand = docs.select(*k, F.coalesce("asr_data.provider", F.lit("unknown")).alias("provider"), F.col("asr_data.model_name").alias("model"), F.col("asr_data.decode_mode").alias("decode_mode"),
                       F.coalesce("asr_data.processing_time", F.lit(0.0)).alias("processing_time"),
                       *[F.col(f"confidence_scores.{c}").alias(n) for c, n in (("D_diarization", "d"), ("A_asr_alignment", "a"), ("L_linguistic", "l"), ("R_agreement", "r"), ("O_overlap", "o"), ("final_score", "final"))])
    seg = docs.select(*k, F.posexplode("aligned_segments").alias("ordinal", "s")).select(
        *k, "ordinal", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.speaker_id").alias("speaker"), F.col("s.text").alias("text"), F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"))
    own = F.coalesce("asr_data.words", F.array().cast(f"array<{S.WORD}>"))
    nested = F.flatten(F.transform(F.coalesce("aligned_segments", F.array().cast(f"array<{S.SEGMENT}>")), lambda s: F.coalesce(s["words"], F.array().cast(f"array<{S.WORD}>"))))
    words = docs.select(*k, F.posexplode(F.when(F.size(own) > 0, own).otherwise(nested)).alias("pos", "w")).select(
        *k, "pos", F.trim("w.word").alias("word"), F.coalesce("w.start", F.lit(0.0)).alias("start"), F.coalesce("w.end", F.lit(0.0)).alias("end"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"))
    return {"candidate": cand, "segment": seg, "word": words.where("word <> '' and start >= 0")}


CORRUPT = "_corrupt_record"
#: Time stamps of JSON files keep microseconds.
STAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of the declared schema, and (file, record) of those that are not JSON of that schema."""
    lines = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    options = {"columnNameOfCorruptRecord": CORRUPT, "timestampFormat": STAMP}
    parsed = lines.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("doc"))
    good, bad = parsed.where(F.col(f"doc.{CORRUPT}").isNull()), parsed.where(F.col(f"doc.{CORRUPT}").isNotNull())
    return good.select("doc.*").drop(CORRUPT), bad.select("file", F.col(f"doc.{CORRUPT}").alias("record"))


def read_candidates(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``candidate_tables`` over JSON lines, and ``corrupt`` (file, record)."""
    docs, corrupt = read_json(spark, path, S.CANDIDATE)
    return candidate_tables(docs) | {"corrupt": corrupt}


def gold_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Gold segments, and one case per test with its reference text in start order."""
    seg = docs.select("test_id", F.posexplode("segments").alias("ordinal", "s")).select("test_id", "ordinal", "s.*")
    text = F.array_join(F.transform(F.array_sort("segments", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)), lambda s: s["text"]), " ")
    case = docs.select("test_id", F.col("audio_duration").alias("duration"), F.size("segments").alias("segments"), text.alias("reference_text"), "quality_targets.*")
    return {"gold_segment": seg, "gold_case": case}


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``gold_tables`` over one JSON document a file, and ``corrupt`` (file, record)."""
    docs, corrupt = read_json(spark, path, S.GOLD, multi_line=True)
    return gold_tables(docs) | {"corrupt": corrupt}


def read_master(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Master transcripts, one JSON document a file, and what is not one."""
    return read_json(spark, path, S.MASTER, multi_line=True)


def recent_gates(reports: DataFrame, now, days: int = 30) -> DataFrame:
    """Gate values of reports newer than ``days`` before ``now``, keyed by test and gate."""
    fresh = reports.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return fresh.select("timestamp", F.explode("gate_results").alias("g")).select("timestamp", F.col("g.test_id").alias("test_id"), F.col("g.gate_type").alias("gate"), F.col("g.measured_value").alias("value"))


def read_history(spark: SparkSession, glob: str, now, days: int = 30) -> DataFrame:
    return recent_gates(spark.read.schema(S.HISTORY).json(glob), now, days)


def write_history(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines in a folder per day, added to those that are there."""
    reports.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").option("timestampFormat", STAMP).json(path)


def read_history_by_date(spark: SparkSession, path: str, now, days: int = 30) -> DataFrame:
    """As ``read_history`` for folders per day: folders that are too old are not listed among the scanned files."""
    reports = spark.read.schema(f"{S.HISTORY}, date date").option("timestampFormat", STAMP).json(path)
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return recent_gates(reports.where(F.col("date") >= F.to_date(since)), now, days)


def read_retry_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(S.CALL_EVENT).option("timestampFormat", STAMP).json(path)


def read_metric_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(S.METRIC_EVENT).json(path)
