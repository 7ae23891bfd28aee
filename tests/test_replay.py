"""Deliveries and snapshots: repeated batches change nothing, versions without a marker do not count."""
import os

import pytest
from pyspark.sql import functions as F

from chorale.streaming import metrics as st, replay as rp


def events(spark, rows):
    return spark.createDataFrame([(i, t, "x", "c", float(v), k) for i, t, v, k in rows], "event_id long, ts string, name string, component string, value double, slot int").withColumn("ts", F.to_timestamp("ts"))


def test_late_and_repeated_deliveries(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, 0), (2, "2024-01-01 00:01:00", 2, 1), (3, "2024-01-01 03:00:00", 3, 1), (4, "2024-01-01 06:00:00", 4, 2), (5, "2024-01-01 00:02:00", 5, 3), (6, "2024-01-01 05:59:00", 6, 3)]
    path = str(tmp_path)
    d = events(spark, rows)
    for k in range(4):  # run by run, as a job that is started again
        rp.deliver(d, F.col("slot"), [k], path, lambda s: st.metric_windows(s, "1 hour", "1 hour", "1 hour"), rp.twice(rp.window_batches(f"{path}/out")), "update")
    got = {r.start.hour: (r.n, r.sum) for r in rp.latest_windows(spark, f"{path}/out", ["name", "start"]).collect()}
    assert got == {0: (2, 3.0), 3: (1, 3.0), 6: (1, 4.0), 5: (1, 6.0)}  # the value of 00:02 came after its window was closed
    before = sorted(os.listdir(f"{path}/out"))
    rp.deliver(d.where("slot = 0"), F.lit(1), [0], path, lambda s: st.metric_windows(s, "1 hour", "1 hour", "1 hour"), rp.window_batches(f"{path}/out"), "update")  # nothing new: no rows of slot 0 are added
    assert [x for x in sorted(os.listdir(f"{path}/out")) if x in before] == before


def test_snapshots_need_their_marker(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rp.versions(spark, path) == []
    with pytest.raises(ValueError):
        rp.read_snapshot(spark, path)
    for k in (1, 2, 10):
        rp.write_snapshot(spark.createDataFrame([("p", k), ("q", -k)], "project_id string, n int"), path, k, "project_id")
    os.remove(f"{path}/version=10/_SUCCESS")
    assert rp.versions(spark, path) == [1, 2] and {r.n for r in rp.read_snapshot(spark, path).collect()} == {2, -2} and {r.n for r in rp.read_snapshot(spark, path, 1).collect()} == {1, -1}
    with pytest.raises(ValueError):
        rp.read_snapshot(spark, path, 10)
    rp.write_snapshot(spark.createDataFrame([("p", 7)], "project_id string, n int"), path, 2, "project_id")  # a rerun replaces its version
    assert [r.n for r in rp.read_snapshot(spark, path).collect()] == [7]
