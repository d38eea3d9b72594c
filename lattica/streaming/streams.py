"""Streams of posts: volumes, assignment to centroids, and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbors import Centroids, assign_open_set
from ..operators.relational import last_per_key


def _batch_writer(path: str, change: Callable[[DataFrame, int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its number, so that a batch that is tried again
    replaces what its first try left."""

    def batch(df: DataFrame, number: int) -> None:
        change(df, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batch


def _run(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame, int], DataFrame], mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(_batch_writer(path, change)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def drained(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream until its input is used up: the last update of every key."""
    _run(stream, path, checkpoint, lambda df, number: df, "update")
    rest = [c for c in stream.columns if c not in keys]
    last = stream.sparkSession.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def stream_volume(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("period"), key, "n")


def stream_assign(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, label: str, tau: float, delta: float, path: str, checkpoint: str) -> DataFrame:
    """Each micro-batch assigned to static centroids, which are made ready once."""
    ready = Centroids(centroids, label)
    _run(vectors, path, checkpoint, lambda df, number: assign_open_set(ready.top2(df, key, vector), tau, delta))
    return vectors.sparkSession.read.parquet(path).drop("batch")


#: Buckets of an upserted table, by a hash of the key.
BUCKETS = 64


def stream_upsert(spark: SparkSession, changes: DataFrame, key: str, sequence: str, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """Each micro-batch upserted into the table: the last change of every key, by ``sequence``; rows of one
    key and sequence are one change, any of them.

    The table is dealt into ``buckets`` by a hash of the key.  A batch reads the buckets that its keys
    fall into, as the batches before it left them, writes those anew to a folder of its number, and
    then a manifest, which names for every bucket the batch that wrote it last; other buckets are
    not read or written.  A batch that is tried again starts from the manifests before it, so
    it writes the same again, and readers see it once its manifest is whole.  The number of buckets
    is kept with the table's life: a table is read with the number it was written with.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = last_per_key(df, key, sequence).withColumn("bucket", _bucket(key, buckets))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # ``buckets`` rows at most
        manifest = _manifest(spark, path, number)
        if touched:
            old = _buckets(spark, path, changes, {b: manifest[b] for b in touched if b in manifest})
            merged = rows if old is None else last_per_key(old.unionByName(rows.drop("bucket")), key, sequence).withColumn("bucket", _bucket(key, buckets))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
        named = spark.createDataFrame([*{**manifest, **dict.fromkeys(touched, number)}.items()], "bucket int, batch long")
        named.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")

    q = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    table = read_upserted(spark, path, changes)
    return spark.createDataFrame([], changes.schema) if table is None else table


def read_upserted(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The upserted table as its newest manifest names it, with the columns of ``like``; None without one."""
    return _buckets(spark, path, like, _manifest(spark, path, None))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str, like: DataFrame, manifest: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(manifest.items())]
    return spark.read.schema(like.schema).parquet(*paths) if paths else None


def _manifest(spark: SparkSession, path: str, before: int | None) -> dict[int, int]:
    """Of the newest batch (before one) whose manifest is whole: the last batch of each bucket."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(x.getName().removeprefix("batch=")) for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    numbers = [x for x in numbers if before is None or x < before]
    if not numbers:
        return {}
    return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{path}/manifest/batch={max(numbers)}").collect()}
