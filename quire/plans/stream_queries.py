"""Streams run to their end over a table's files, and compared with what SQL says of the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.plans.catalog_queries import BUCKET_SQL
from quire.queries import query
from quire.session import shared_dir
from quire.sources.tables import table
from quire.streaming import ingest as sm


def _stream(spark, d, name):
    """The files of a table as a stream; a table of one file is found in its folder by its name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    r = spark.readStream.schema(table(spark, d, name).schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return r.parquet(f"{d}/{name}.parquet")
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("SELECT file_hash, book_id, title, CAST(0 AS BIGINT) AS download_count FROM conversions")
def ingest_stream(spark, d):
    """The catalogue ingested as a stream; a second run over the same files changes nothing."""
    path = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    for _ in range(2):
        sm.ingest(_stream(spark, d, "conversions").select("file_hash", "book_id", "title", "created_at"), path, f"{path}-chk", digits=1).awaitTermination()
    return sm.latest(spark, path).select("file_hash", "book_id", "title", "download_count")


@query("SELECT log_id, min(fecha) AS fecha FROM search_log GROUP BY log_id")
def dedupe_stream(spark, d):
    """Searches delivered twice, once each."""
    path = f"{shared_dir(spark)}/searches-{uuid.uuid4().hex}"
    s = sm.dedupe_stream(_stream(spark, d, "search_log").select("log_id", "fecha", F.col("recibido_en").cast("timestamp").alias("at")), ["log_id"], "at", "90 days")
    s.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-chk").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("log_id long, fecha timestamp_ntz, at timestamp").parquet(path).select("log_id", "fecha")


@query(BUCKET_SQL)
def token_bucket_stream(spark, d):
    """The token bucket as a stateful stream."""
    path = f"{shared_dir(spark)}/bucket-{uuid.uuid4().hex}"
    e = _stream(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("s"))
    b = sm.bucket_stream(e, "user_id", "event_id", "s", 4.0, 0.125, idle_ms=None)
    b.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-chk").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, event long, allowed boolean, wait_s long").parquet(path)
