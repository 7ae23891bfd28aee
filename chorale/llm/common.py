"""Small helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.session import cut_lineage  # noqa: F401


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet").select(*columns)


def settings(spark: SparkSession) -> None:
    """Session settings of every query: small Arrow batches, because one text may be very long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def raw(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def crc_class(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids go to class 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def parts_for(df: DataFrame, least: int = 16) -> int:
    """Partitions of a shuffle of `df`'s order of size: the session's own number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def filtered(docs: DataFrame, keep, column: str = "text") -> DataFrame:
    """The rows for which `keep(list of texts)` gives true; all columns pass through as Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
