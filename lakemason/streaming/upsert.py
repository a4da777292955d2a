"""Incremental upkeep of a keyed store from a landing folder, with structured streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.operators.joins import upsert_last


def land(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def drop_repeats(stream: DataFrame, key: list[str], time: str, delay: str = "2 days") -> DataFrame:
    """First arrival of each key; state is kept no longer than late rows are waited for."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


#: Parts of a store by a hash of its keys: a batch reads and writes those that it touches.
BUCKETS = 64


def upsert_stream(stream: DataFrame, store: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS):
    """Each batch merges into a new version of the buckets it touches; a replayed batch writes the same version again.

    Versions are folders named by batch id, so a lost executor or a restart never leaves a
    half-written store: readers take each bucket's highest complete version. Of every bucket
    the two newest versions stay, so that a reader keeps what it has begun with.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        before = latest(spark, store, below=batch_id, buckets=touched)
        rows = upsert_last(batch.limit(0) if before is None else before, batch, keys, order)
        rows = rows.withColumn("_bucket", bucket)
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{store}/v={batch_id:09d}")
        _drop_old(spark, store, batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, store: str, below: int | None) -> tuple[object, dict[int, list]]:
    """(file system, bucket -> paths of its complete versions, newest first)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list] = {}
    if not fs.exists(root):
        return fs, found
    whole = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    for path in sorted(whole, key=lambda p: -int(p.getName()[2:])):
        if below is None or int(path.getName()[2:]) < below:
            for part in fs.listStatus(path):
                name = part.getPath().getName()
                if name.startswith("_bucket="):
                    found.setdefault(int(name[8:]), []).append(part.getPath())
    return fs, found


def _drop_old(spark: SparkSession, store: str, batch_id: int) -> None:
    fs, found = _versions(spark, store, batch_id + 1)
    for paths in found.values():
        for path in paths[2:]:
            fs.delete(path, True)


def latest(spark: SparkSession, store: str, below: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The newest complete version of a store (or of some of its buckets), or None."""
    _, found = _versions(spark, store, below)
    paths = [v[0].toString() for b, v in found.items() if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None
