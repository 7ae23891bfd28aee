"""Replays: deliveries of rows as files, each read by a stream that takes what is there and stops, and committed snapshots by version."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Write = Callable[[DataFrame, int], None]


def twice(write: Write) -> Write:
    """Every batch is written, and written again under its id, as after a driver that died before it could commit."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    return run


def deliver(rows: DataFrame, slot: Column, slots: Iterable[int], folder: str, build: Callable[[DataFrame], DataFrame], write: Write, mode: str = "append") -> None:
    """Add the rows of one slot after the other to a folder of files; after each, run the stream ``build`` over the folder on what is new.

    All runs share a checkpoint, so offsets, watermark and state go on from run to run.
    """
    spark = rows.sparkSession
    for k in slots:
        rows.where(slot == k).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        running = build(source).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()


def window_batches(path: str) -> Write:
    """Each batch of changed windows in a folder of its id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_windows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of every window over all batches."""
    d = spark.read.option("recursiveFileLookup", True).parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("w")).select(*keys, "w.*")


# ---- snapshots -------------------------------------------------------------------------------------------------------


def write_snapshot(df: DataFrame, path: str, version: int, by: str) -> str:
    """One version of a table, partitioned by ``by``; the marker of the job's commit is what makes it a version."""
    target = f"{path}/version={int(version)}"
    df.write.mode("overwrite").partitionBy(by).parquet(target)
    return target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions in order; a version whose writer died has no marker and does not count."""
    jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version, the latest if none is named."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no committed version {'' if version is None else version} in {path}")
    return spark.read.parquet(f"{path}/version={known[-1] if version is None else version}")
