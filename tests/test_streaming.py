"""Streams give what the batch gives, also after replay, late and repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators.limits import token_bucket
from quire.streaming import ingest as sm


def test_ingest_stream_equals_batch(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    t = dt.datetime(2024, 1, 1)
    schema = "file_hash string, title string, created_at timestamp_ntz"
    for part in ([("a", "A", t), ("b", "B", t)], [("b", "B2", t + dt.timedelta(days=1)), ("b", "B2", t + dt.timedelta(days=1)), ("c", None, t - dt.timedelta(days=9))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # a second run finds nothing new
        sm.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), out, chk).awaitTermination()
    got = {r["file_hash"]: r["title"] for r in sm.latest(spark, out).collect()}
    assert got.keys() == {"a", "b", "c"} and got["a"] == "A" and got["c"] is None


def test_ingest_rewrites_touched_parts_only(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    t = dt.datetime(2024, 1, 1)
    schema = "file_hash string, title string, created_at timestamp_ntz"
    first = [(f"k{i}", "old", t) for i in range(60)] + [(None, "lost", t)]
    for part in (first, [("k1", "new", t)], [("k2", "new", t)], [("k1", "newer", t)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        sm.ingest(spark.readStream.schema(schema).parquet(src), out, chk).awaitTermination()
    got = {r["file_hash"]: r["title"] for r in sm.latest(spark, out).collect()}
    assert len(got) == 60 and got["k1"] == "newer" and got["k2"] == "new" and got["k3"] == "old"
    files = lambda v: {p.parent.name for p in (tmp_path / "out").glob(f"v{v}/*/*.parquet")}
    assert len(files(3)) == 1 and len(list((tmp_path / "out").glob("manifest-[0-9]*"))) == 2
    # the version of k1 that the last manifest but one names is kept, the one before is gone
    assert files(1) == files(3) and not files(0) & files(1)
    assert sm.latest(spark, str(tmp_path / "none"), schema).count() == 0


def test_bucket_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, float(i // 3)) for i in range(12)] + [("b", 100 + i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, e long, s double")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    st = sm.bucket_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "src")), "k", "e", "s", 3, 0.5, idle_ms=None)
    st.writeStream.format("memory").queryName("bucket_out").outputMode("append").option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start().awaitTermination()
    got = {r["event"]: r["allowed"] for r in spark.table("bucket_out").collect()}
    assert got == {r["event"]: r["allowed"] for r in token_bucket(df, "k", "e", "s", 3, 0.5).collect()}


def test_dedupe_stream_drops_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (1, t), (2, t + dt.timedelta(hours=5))], "log_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    s = sm.dedupe_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "src")), ["log_id"], "ts")
    s.writeStream.format("memory").queryName("dedupe_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "chk")).start().awaitTermination()
    assert sorted(r["log_id"] for r in spark.table("dedupe_out").select("log_id").collect()) == [1, 2]
