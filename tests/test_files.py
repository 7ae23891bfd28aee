"""Session files: bytes of every format, reading back, commit and abort; JSON readers with corrupt records and pruned folders."""
import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorale.sources import caption_files as cf, readers, session_files as sf

SEGMENTS = [
    (1, 1, "ann", 0, 1500, " hello, {you} \\ there "), (1, 2, "bob", 1500, 2000, " \n "), (1, 3, "bob", 2000, 3255, "one\n \n two"), (1, 4, "ann", 3_700_004, 3_700_999, "late: yes"),
    (2, 1, "ann", 10, 20, ""), (3, 7, "éva, m", 0, 999, "a --> b"), (3, 8, "éva, m", 1000, 1001, "<i>x</i> & y"),
]


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "session_id long, id long, speaker string, start long, end long, text string")


def files(path):
    return {p.name: p.read_bytes().decode() for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith(("_", "."))}


SRT = "1\n00:00:00,000 --> 00:00:01,500\nann: hello, {you} \\ there\n\n2\n00:00:02,000 --> 00:00:03,255\nbob: one\ntwo\n\n3\n01:01:40,004 --> 01:01:40,999\nann: late: yes\n\n"
VTT = "WEBVTT\n\ncue-1\n00:00:00.000 --> 00:00:01.500 line:10%\n<v ann>hello, {you} \\ there\n\ncue-3\n00:00:02.000 --> 00:00:03.255 line:20%\n<v bob>one\ntwo\n\ncue-4\n01:01:40.004 --> 01:01:40.999 line:10%\n<v ann>late: yes\n\n"
ASS = """Dialogue: 0,0:00:00.00,0:00:01.50,ann,,0,0,0,,hello, \\{you\\} \\\\ there
Dialogue: 0,0:00:02.00,0:00:03.26,bob,,0,0,0,,one\\Ntwo
Dialogue: 0,1:01:40.00,1:01:41.00,ann,,0,0,0,,late: yes
"""
TXT = f"""Transcript

Duration: 1h 1m 40s
Segments: 4
Speakers: 2

Participants:
  • ann
  • bob

{'-' * 60}

[00:00:00] ann: hello, {{you}} \\ there

[00:00:02] bob: one two

[01:01:40] ann: late: yes

{'-' * 60}
End
"""
RTTM = "SPEAKER 1 1 0.000 1.500 <NA> <NA> ann <NA> <NA>\nSPEAKER 1 1 1.500 0.500 <NA> <NA> bob <NA> <NA>\nSPEAKER 1 1 2.000 1.255 <NA> <NA> bob <NA> <NA>\nSPEAKER 1 1 3700.004 0.995 <NA> <NA> ann <NA> <NA>\n"


@pytest.mark.parametrize("fmt", ["srt", "vtt", "ass", "txt"])
def test_captions_byte_for_byte(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    cf.write_caption_files(segments(spark), fmt, path, 60_000)
    got = files(path)
    first = got[f"1.{fmt}"]
    if fmt == "ass":
        head, _, cues = first.partition("Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n")
        assert cues == ASS and head.startswith("[Script Info]\nTitle: Transcript\n") and "Style: ann,Sans,18,&H6B6BFF," in head and "Style: bob,Sans,18,&HC4CD4E," in head
    else:
        assert first == {"srt": SRT, "vtt": VTT, "txt": TXT}[fmt]
    assert sorted(got) == [f"{n}.{fmt}" for n in ((1, 3) if fmt == "srt" else (1, 2, 3))]  # a session without cues has a file only if the format has a head
    back = sorted((r.session_id, r.ordinal, r.speaker, r.text) for r in sf.read_session_files(spark, path, fmt).collect())
    third = "éva; m" if fmt == "ass" else "éva, m"
    two = "one two" if fmt == "txt" else "one\ntwo"
    assert back == [("1", 1, "ann", "hello, {you} \\ there"), ("1", 2, "bob", two), ("1", 3, "ann", "late: yes"), ("3", 1, third, "a --> b"), ("3", 2, third, "<i>x</i> & y")]


def test_rttm_and_names(spark, tmp_path):
    path = str(tmp_path / "out")
    cf.write_rttm_files(segments(spark), path, 1000.0)
    assert files(path)["1.rttm"] == RTTM and os.path.exists(f"{path}/_SUCCESS")
    back = sf.read_session_files(spark, path, "rttm")
    assert sorted((r.session_id, r.start, r.end, r.speaker) for r in back.collect()) == sorted((str(s), a, b, who) for s, _, who, a, b, _ in SEGMENTS)
    odd = spark.createDataFrame([("a/b ü.%", "l1"), ("", "l2")], "session_id string, line string")
    sf.write_session_files(odd, path, "txt", [])  # overwrites
    assert files(path) == {"a%2Fb %C3%BC.%25.txt": "l1\n", ".txt": "l2\n"} or set(files(path)) == {"a%2Fb %C3%BC.%25.txt"}
    sf.write_session_files(odd.where("line = 'l1'").withColumn("line", F.lit("new")), path, "txt", [], mode="append")
    assert files(path)["a%2Fb %C3%BC.%25.txt"] == "new\n" and len(list(Path(path).rglob("*.txt"))) == 2
    sf.write_session_files(odd.limit(0), path, "txt", [])
    assert files(path) == {} and sf.read_session_files(spark, path, "txt").count() == 0


def test_broken_files_come_as_corrupt_rows(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nann: x\n\nnonsense\n\n2\n00:00:xx,000 --> 00:00:02,000\ny\n\n3\n00:00:03,5 --> 00:00:04\nno speaker")
    rows = sf.read_session_files(spark, str(tmp_path), "srt").orderBy("ordinal").collect()
    assert [(r.start, r.speaker, r.text, r.corrupt is not None) for r in rows] == [(0, "ann", "x", False), (None, None, None, True), (None, None, None, True), (3500, None, "no speaker", False)]
    (tmp_path / "b.rttm").write_text(";; note\nSPEAKER b 1 0.1 2.25 <NA> <NA> two words <NA> <NA>\nSPEAKER b 1 x\nLEXEME z\n")
    rows = sf.read_session_files(spark, str(tmp_path), "rttm").orderBy("ordinal").collect()
    assert [(r.start, r.end, r.speaker, r.corrupt) for r in rows] == [(100, 2350, "two words", None), (None, None, None, "SPEAKER b 1 x"), (None, None, None, "LEXEME z")]
    (tmp_path / "c.ass").write_text("Dialogue: 0,0:00:01.00,0:00:02.00,s,,0,0,0,,a,\\Nb\nDialogue: broken\n")
    rows = sf.read_session_files(spark, str(tmp_path), "ass").orderBy("ordinal").collect()
    assert [(r.start, r.text, r.corrupt) for r in rows] == [(1000, "a,\nb", None), (None, None, "Dialogue: broken")]
    with pytest.raises(Exception, match="kind must be"):
        sf.read_session_files(spark, str(tmp_path), "pdf").collect()


def test_partitions_are_folders_and_groups_of_loose_files(tmp_path, monkeypatch):
    monkeypatch.setattr(sf, "LOOSE_FILES", 2)
    for n in range(5):
        (tmp_path / f"{n}.srt").write_text("")
    for n in ("bucket=1", "bucket=2", "_temporary"):
        (tmp_path / n).mkdir()
    found = sf.SessionReader({"path": str(tmp_path), "kind": "srt"}).partitions()
    assert [os.path.basename(p.folder) for p in found if p.folder] == ["bucket=1", "bucket=2"] and [len(p.files) for p in found if p.files] == [2, 2, 1]


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"bucket": b, "session_id": s, "line": x} for b, s, x in rows])


def test_a_killed_attempt_leaves_no_file(tmp_path):
    """An attempt dies in the middle, its successor commits: only the successor's files are there."""
    path = str(tmp_path / "out")
    writer = sf.SessionWriter({"path": path, "kind": "srt"}, True)

    def dying():
        yield batch((0, "a", "half"), (1, "z", "stray"))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write_attempt(dying(), "0-1")
    done = writer.write_attempt(iter([batch((0, "a", "one"), (0, "a", "two")), batch((0, "a", "three"), (0, "b", "x"))]), "0-2")
    assert files(path + "/bucket=0") == {}
    other = sf.SessionWriter({"path": path, "kind": "srt"}, True)
    late = other.write_attempt(iter([batch((3, "c", "other job"))]), "0-1")
    writer.commit([done, None])
    assert files(path + "/bucket=0") == {"a.srt": "one\ntwo\nthree\n", "b.srt": "x\n"} and not os.path.exists(path + "/bucket=1")
    other.commit([late])  # overwrites what the first job wrote
    assert {str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file()} == {"_SUCCESS", "bucket=3/c.srt"} and not os.path.exists(path + "/_temporary")
    again = sf.SessionWriter({"path": path, "kind": "srt"}, True)
    again.write_attempt(iter([batch((0, "q", "never"))]), "0-1")
    again.abort([None])
    assert files(path) == {"c.srt": "other job\n"} and not os.path.exists(path + "/_temporary")
    for bad in ([batch((1, "a", "x"), (0, "a", "y"))], [batch((0, None, "x"))]):
        with pytest.raises(ValueError):
            again.write_attempt(iter(bad), "0-9")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(200).select(F.col("id").cast("string").alias("session_id"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("line"))
    with pytest.raises(Exception, match="lost"):
        sf.write_session_files(lines, path, "txt", [])
    assert not os.path.exists(path) or not [p for p in Path(path).rglob("*") if p.is_file()]


def test_master_files(spark, tmp_path):
    path = str(tmp_path / "out")
    seg = segments(spark).withColumn("candidate_id", F.col("id") % 2).withColumn("confidence", F.lit(0.5))
    winners = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "session_id long, candidate_id long")
    cf.write_master_files(seg, winners, path, 60_000, 1000.0)
    docs, corrupt = readers.read_master(spark, path)
    got = {r.session_id: r for r in docs.collect()}
    assert corrupt.count() == 0 and sorted(got) == ["1", "2", "3"]
    assert got["1"].metadata.total_duration == 2.0 + 1.255 and got["1"].speaker_map == {"ann": "Speaker ann", "bob": "Speaker bob"}
    assert [(s.ordinal, s.start, s.text) for s in got["1"].segments] == [(1, 0.0, " hello, {you} \\ there "), (2, 2.0, "one\n \n two")]
    assert got["2"].provenance.candidate_id == "1" and [s.text for s in got["2"].segments] == [""]


def test_json_readers_keep_corrupt_records(spark, tmp_path):
    good = '{"session_id":"s","candidate_id":"c","asr_data":{"words":[{"word":"a","start":0.5}]}}\n'
    (tmp_path / "c.json").write_text(good + '{"session_id": \n' + '{"session_id":"t","candidate_id":"d","asr_data":[]}\n')
    t = readers.read_candidates(spark, str(tmp_path / "c.json"))
    assert [r.word for r in t["word"].collect()] == ["a"] and {r.session_id for r in t["candidate"].collect()} == {"s"}
    assert sorted(r.record for r in t["corrupt"].collect()) == ['{"session_id": ', '{"session_id":"t","candidate_id":"d","asr_data":[]}']
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "1.json").write_text('{"test_id":"t1",\n "segments":[{"start":1.0,"text":"b"},{"start":0.0,"text":"a"}]}')
    (tmp_path / "gold" / "2.json").write_text("{broken")
    g = readers.read_gold(spark, str(tmp_path / "gold"))
    assert [(r.test_id, r.reference_text) for r in g["gold_case"].collect()] == [("t1", "a b")] and g["corrupt"].first().file.endswith("2.json")


def test_history_reads_only_fresh_folders(spark, tmp_path):
    path = str(tmp_path / "h")
    days = spark.range(60).select(F.timestamp_seconds(F.col("id") * 86400 + 1_700_000_000.25).alias("timestamp"), F.array(F.struct(F.lit("t").alias("test_id"), F.lit("wer").alias("gate_type"), F.col("id").cast("double").alias("measured_value"))).alias("gate_results"))
    readers.write_history(days, path)
    now = days.agg(F.max("timestamp")).first()[0]
    fresh = readers.read_history_by_date(spark, path, now, 10)
    assert sorted(r.value for r in fresh.collect()) == [float(x) for x in range(49, 60)]
    assert len({r.file for r in fresh.select(F.input_file_name().alias("file")).collect()}) <= 11
    assert "PartitionFilters: [isnotnull(date" in fresh._jdf.queryExecution().executedPlan().toString()
