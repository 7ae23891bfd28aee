"""Each stream against its batch twin, replayed with availableNow; sinks and readers round trip."""
import pytest
from pyspark.sql import functions as F

from chorale.operators.calibration import CONTEXT
from chorale.sources import readers, sinks
from chorale.streaming import metrics as st

EVENTS = [(i, f"2024-01-01 00:{i // 2:02d}:{(i % 2) * 30:02d}", "svc" + str(i % 2), "failure" if 4 <= i < 24 else "success", 1, float(i)) for i in range(60)]


@pytest.fixture
def log(spark, tmp_path):
    d = spark.createDataFrame(EVENTS, "event_id long, ts string, service string, event string, attempt long, duration_ms double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):
        d.where(F.floor(F.col("event_id") / 20) == k).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    return str(tmp_path / "log"), d


def drain(df, mode, path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_retry_stream_equals_batch(spark, log, tmp_path):
    path, batch = log
    stream = readers.read_retry_events(spark, path, streaming=True)
    drain(st.retry_stream(stream, "10 minutes"), "complete", str(tmp_path / "c1"), "retry_out")
    cols = ["service", "start", "attempts", "success", "failure"]
    assert sorted(spark.table("retry_out").select(*cols).collect()) == sorted(st.retry_stream(batch, "10 minutes").select(*cols).collect())


def test_service_states_stream_equals_batch(spark, log, tmp_path):
    path, batch = log
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).json(path)
    drain(st.service_states(stream), "append", str(tmp_path / "c2"), "state_out")
    want = sorted(st.service_states(batch).collect())
    assert want and [r.phase for r in want if r.service == "svc0"][:2] == ["open", "half_open"]
    assert {r.service for r in spark.table("state_out").collect()} == {r.service for r in want}


def test_alert_stream_and_observers(spark, tmp_path):
    d = spark.createDataFrame([(i, f"2024-01-01 00:00:{i // 2:02d}", "error_rate", "c", float(i)) for i in range(20)], "event_id long, ts string, name string, component string, value double") \
        .withColumn("ts", F.to_timestamp("ts"))
    d.coalesce(1).write.json(str(tmp_path / "m"))
    seen = []
    notify = st.foreach_batch_observers([lambda b, i: seen.extend(r.alert_id for r in b.collect())])
    stream = st.alerts(readers.read_metric_events(spark, str(tmp_path / "m"), True), st.definitions(spark))
    q = stream.writeStream.foreachBatch(notify).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(seen) == sorted(r.alert_id for r in st.alerts(d, st.definitions(spark)).collect())


def test_late_events_are_dropped(spark, tmp_path):
    mk = lambda i, t: spark.createDataFrame([(i, t, "x", "c", 1.0)], "event_id long, ts string, name string, component string, value double").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "late")
    out = []
    for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 02:00:00", "2024-01-01 00:00:10", "2024-01-01 05:00:00"]):
        mk(i, t).coalesce(1).write.mode("append").json(path)
        windows = st.metric_windows(readers.read_metric_events(spark, path, True), "300 seconds", "300 seconds")
        q = windows.writeStream.outputMode("append").foreachBatch(lambda d, _: out.extend(d.select(F.hour("start").alias("h"), "n").collect())) \
            .option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r.n for r in out if r.h == 0] == [1]  # the event ten seconds in came after the watermark had passed


def test_registry_batches_merge_like_one(spark, tmp_path):
    s = spark.createDataFrame([("x", "2-5", "low", *[float(i % 7) / 7] * 5) for i in range(40)], "domain string, speaker_range string, noise string, d double, a double, l double, r double, o double")
    s = s.withColumn("i", F.monotonically_increasing_id())
    path = str(tmp_path / "reg")
    write = st.foreach_batch_registry(path)
    half = F.col("d") < 0.5
    write(s.where(half), 0)
    write(s.where(~half), 1)
    write(s.where(~half), 1)  # a replay of the batch changes nothing
    got = spark.read.parquet(f"{path}/batch=1").where("domain = 'x' and dim = 'd'").collect()[0]
    want = s.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v")).collect()[0]
    assert got.n == want.n and abs(got.mean - want.m) < 1e-12 and abs(got.m2 - want.v * want.n) < 1e-9 and CONTEXT


def test_candidate_reader_prefers_recogniser_words(spark, tmp_path):
    doc = ('{"session_id":"s","candidate_id":"c","asr_data":{"provider":"p","words":[{"word":" a ","start":0.0,"end":0.1},{"word":"","start":1.0,"end":1.1},{"word":"b","start":-1.0,"end":0.2}]},'
           '"aligned_segments":[{"start":0.0,"end":1.0,"speaker_id":"x","text":"zz","words":[{"word":"zz","start":0.0,"end":0.5,"confidence":0.9}]}],"confidence_scores":{"final_score":0.7}}\n')
    (tmp_path / "c.json").write_text(doc + doc.replace('"words":[{"word":" a "', '"ignored":[{"word":" a "').replace('"candidate_id":"c"', '"candidate_id":"d"'))
    t = readers.read_candidates(spark, str(tmp_path / "c.json"))
    assert sorted((r.candidate_id, r.word, r.confidence) for r in t["word"].collect()) == [("c", "a", 0.0), ("d", "zz", 0.9)]
    assert t["segment"].count() == 2 and {r.final for r in t["candidate"].collect()} == {0.7}


def test_sinks_write_what_they_show(spark, tmp_path):
    s = spark.createDataFrame([(1, 1, "x", 0, 1500, "hello"), (1, 2, "y", 1500, 2000, " "), (1, 3, "x", 2000, 3250, "again")], "session_id long, id long, speaker string, start long, end long, text string")
    sinks.write_captions(s, "srt", str(tmp_path / "srt"), 60_000)
    text = "\n".join(r.line for r in spark.read.parquet(str(tmp_path / "srt")).orderBy("session_id", "part", "start", "id").collect())
    assert "00:00:02,000 --> 00:00:03,250" in text and "hello" in text
    sinks.write_rttm(s, str(tmp_path / "rttm"), 1000.0)
    assert "SPEAKER 1 1 0.000 1.500 <NA> <NA> x <NA> <NA>" in [r.line for r in spark.read.parquet(str(tmp_path / "rttm")).collect()]
    sinks.write_reports({"r": s}, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep" / "r")).count() == 3
    base = spark.createDataFrame([("p", "t")], "project_id string, term string")
    assert spark.read.parquet(sinks.write_term_base(base, str(tmp_path / "tb"), 3)).collect()[0].term == "t"


def test_caption_documents_have_heads(spark):
    s = spark.createDataFrame([(1, 1, "x", 0, 1500, "hello"), (1, 2, "y", 1500, 2000, "you"), (2, 1, "x", 0, 10, " ")], "session_id long, id long, speaker string, start long, end long, text string")

    def document(fmt, session):
        return [r.line for r in sinks.caption_document(s, fmt, 60_000).where(F.col("session_id") == session).orderBy("part", "start", "id").collect()]

    assert document("vtt", 1)[0] == "WEBVTT\n" and len(document("vtt", 1)) == 3 and document("vtt", 2) == ["WEBVTT\n"]
    ass = "\n".join(document("ass", 1)).split("\n")
    assert ass[0] == "[Script Info]" and ass.index("[V4+ Styles]") < ass.index("[Events]") < ass.index(next(x for x in ass if x.startswith("Dialogue:")))
    assert [x.split(",")[0] + x.split(",")[3] for x in ass if x.startswith("Style:")] == ["Style: Speaker1&H6B6BFF", "Style: Speaker2&HC4CD4E"]
    assert len(document("srt", 1)) == 2 and document("srt", 2) == []
