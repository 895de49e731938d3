"""Streams: incremental ingest into the catalogue and a token bucket, with the step functions of the batch operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.catalog import upsert
from quire.operators.limits import bucket_step


def dedupe_stream(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """Rows once per key within the watermark; state is dropped when the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *x]))


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the written manifests, in order."""
    fs, at = _fs(spark, path)
    if not fs.exists(at()):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at())]
    return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())


def _manifest(spark: SparkSession, path: str, n: int | None) -> dict[str, int]:
    if n is None:
        return {}
    return json.loads(spark.sparkContext.wholeTextFiles(f"{path}/manifest-{n}").first()[1])


def _leaf(path: str, bucket: str, version: int) -> str:
    return f"{path}/v{version}/_bucket={bucket}"


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "file_hash", digits: int = 2, trigger: dict | None = None) -> StreamingQuery:
    """Upsert each micro-batch into a Parquet catalogue that is parted by `digits` hexadecimal digits of the key's digest.

    A batch reads and writes only the parts its keys fall into; the manifest that names the version of every part is
    written last, so a lost executor or a replayed batch changes nothing twice. Parts that the manifest before the last
    one alone names are deleted: whoever reads the last one is not disturbed.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fs, at = _fs(spark, path)
        known = _manifests(spark, path)
        if n in known:
            return
        before = [m for m in known if m < n]
        prev = _manifest(spark, path, before[-1] if before else None)
        new = batch.where(F.col(key).isNotNull())
        if "download_count" not in new.columns:
            new = new.withColumn("download_count", F.lit(0).cast("long"))
        part = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits)
        touched = sorted(r[0] for r in new.select(part).distinct().collect())  # at most 16 ** digits
        if touched:
            have = [_leaf(path, b, prev[b]) for b in touched if b in prev]
            old = spark.read.parquet(*have) if have else new.limit(0)
            upsert(old, new, key).withColumn("_bucket", part).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{n}")
        now = {**prev, **dict.fromkeys(touched, n)}
        out = fs.create(at(f"manifest-{n}"), True)
        out.write(bytearray(json.dumps(now, sort_keys=True), "utf-8"))
        out.close()
        for m in before[:-1]:
            gone = _manifest(spark, path, m)
            for b, v in gone.items():
                if prev.get(b) != v and now.get(b) != v:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(_leaf(path, b, v)), True)
            fs.delete(at(f"manifest-{m}"), False)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The catalogue as the newest manifest names it; an empty one needs a schema."""
    known = _manifests(spark, path)
    parts = _manifest(spark, path, known[-1] if known else None)
    if not parts:
        return spark.createDataFrame([], schema or "file_hash string")
    return spark.read.parquet(*[_leaf(path, b, v) for b, v in sorted(parts.items())])


def bucket_stream(stream: DataFrame, key: str, event: str, seconds: str, capacity: float = 30.0, rate: float = 0.5, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The token bucket over a stream: (tokens, last) per key in the state store, dropped after idle_ms without requests.

    A global least-recently-used bound over all keys has no counterpart in keyed state; the idle time bounds it instead.
    With an idle time Spark keeps running batches without data, so such a query never ends by itself; a run that should
    end (availableNow) takes idle_ms None and keeps its state. Within a micro-batch the requests of a key are taken in the order of (seconds, event).
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # a key's rows of one micro-batch, which the source's rate bounds: two numbers each
        rows = pd.concat([f[["s", "event"]] for f in frames]).sort_values(["s", "event"])
        tokens, last = state.get if state.exists else (capacity, float(rows["s"].iloc[0]))
        out = []
        for e, s in zip(rows["event"], rows["s"]):
            tokens, ok, wait = bucket_step(tokens, last, s, capacity, rate)
            last = s
            out.append((k[0], int(e), bool(ok), int(wait)))
        state.update((float(tokens), float(last)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "event", "allowed", "wait_s"])

    src = stream.select(F.col(key).cast("string").alias("key"), F.col(event).cast("long").alias("event"), F.col(seconds).cast("double").alias("s"))
    return src.groupBy("key").applyInPandasWithState(step, "key string, event long, allowed boolean, wait_s long", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def daily_counts_stream(stream: DataFrame, time: str, delay: str = "3 days") -> DataFrame:
    """Requests per calendar day, each emitted once the watermark has passed it."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")
