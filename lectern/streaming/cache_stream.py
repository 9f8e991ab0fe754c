"""The cache as a stream: puts go in, statistics and the latest entries come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import cache


def puts_by_window(puts: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Puts by kind and window of their creation; later ones than the watermark are left out."""
    timed = puts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window), "entity_type").agg(F.count("*").alias("puts"), F.approx_count_distinct("key").alias("keys"))


def distinct_puts(puts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First put of each key within the watermark: state is dropped once it can't repeat."""
    timed = puts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.dropDuplicatesWithinWatermark(["key"])


def upsert_into(path: str, run: str = "run"):
    """A foreachBatch writer: each batch becomes the next snapshot of the cache under ``path``.

    A snapshot is written whole, as ``path``/``run``-<batch>, so a batch that
    is run again after a failure writes the same snapshot.  A stream with a
    new checkpoint counts its batches from 0 again: give it another ``run``,
    and it starts from the newest snapshot of the others instead of losing
    what they hold.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cache.latest(batch)
        before = f"{path}/{run}-{number - 1}" if number > 0 else newest(spark, path, but=run)
        if before:
            new = cache.put(spark.read.parquet(before), new)
        new.write.mode("overwrite").parquet(f"{path}/{run}-{number}")

    return write


def newest(spark: SparkSession, path: str, but: str | None = None) -> str | None:
    """The complete snapshot under ``path`` that was written last, those of one run aside."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    found = []
    for s in files.listStatus(place):
        name, whole = s.getPath().getName(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
        if (but is None or name.rpartition("-")[0] != but) and files.exists(whole):
            found.append((files.getFileStatus(whole).getModificationTime(), name))
    return f"{path}/{max(found)[1]}" if found else None
