"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as nb
from ..streaming import streams as st
from .base import query, table, vectors
from .ingest import _folder
from .vectors import _CENTRES


def _stream(spark, d, name):
    """The table as a stream of the files of a copy, one file at a time."""
    t = table(spark, d, name)
    path = _folder(spark)
    t.repartition(4).write.parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("stream_volume", "SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_volume(spark, d):
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    v = st.drained(st.stream_volume(e, "ts", "event_type", late="40 days"), ["period", "event_type"], _folder(spark), _folder(spark))
    return v.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "event_type", "n")


@query("stream_assign", f"WITH {_CENTRES.replace('FROM vectors, cen WHERE is_test', 'FROM vectors, cen')} SELECT key, accepted, CASE WHEN accepted THEN best_label ELSE -1 END AS label FROM open")
def stream_assign(spark, d):
    c = nb.centroids_by_label(vectors(spark, d).where("not is_test"), "template", "v")
    v = _stream(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return st.stream_assign(v, c, "key", "v", "template", 0.25, 0.02, _folder(spark), _folder(spark)).select("key", "accepted", "label")


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, d):
    e = _stream(spark, d, "events").select("user_id", "event_id", "event_type")
    return st.stream_upsert(spark, e.withColumn("seq", F.col("event_id")), "user_id", "seq", _folder(spark), _folder(spark)).select("user_id", "event_id", "event_type")
