"""Rate limits and quotas: ordered folds per key, the same step in batch and in streams.

A stretch of requests changes the tokens of a bucket by a step function of the tokens before it, and such functions compose:
they are told by the few levels at which a request turns from refused to allowed. So a hot key is folded in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.session import materialize, ship


def bucket_step(tokens: float, last: float, now: float, capacity: float, rate: float) -> tuple[float, bool, int]:
    """One request against a token bucket: (tokens after, allowed, seconds to wait)."""
    tokens = min(capacity, tokens + max(0.0, now - last) * rate)
    if tokens >= 1:
        return tokens - 1, True, 0
    return tokens, False, int((1 - tokens) / rate) + 1


def _step_levels(times: list[float], capacity: float, rate: float) -> list[tuple[float, float, float]]:
    """What a stretch of requests does to the tokens t before its first one (at that one's time): pieces (from, low, high),
    ascending; for t in the piece the tokens after are min(t - low, high).

    Each request first refills (t + d, at most the capacity), then takes one if there is one: x - 1 for x >= 1, else x.
    """
    pieces = [(0.0, 0.0, capacity)]
    last = times[0] if times else 0.0
    for now in times:
        d = max(0.0, now - last) * rate
        last = now
        new: list[tuple[float, float, float]] = []
        for i, (start, low, high) in enumerate(pieces):
            end = pieces[i + 1][0] if i + 1 < len(pieces) else float("inf")
            low, high = low - d, min(capacity, high + d)
            turn = low + 1  # from this t on the request is allowed
            if high < 1 or turn >= end:
                new.append((start, low, high))
            elif turn <= start:
                new.append((start, low + 1, high - 1))
            else:
                new += [(start, low, high), (turn, low + 1, high - 1)]
        pieces = new
    return pieces


def _apply(pieces: list[tuple[float, float, float]], t: float) -> float:
    """The tokens after a stretch that had t before it."""
    i = 0
    while i + 1 < len(pieces) and pieces[i + 1][0] <= t:
        i += 1
    return min(t - pieces[i][1], pieces[i][2])


def _levels(batches: Iterator[pa.RecordBatch], capacity: float, rate: float) -> Iterator[pa.RecordBatch]:
    """One row per stretch (key, part), whose rows come together and in order: first and last time, and its pieces."""
    held: tuple | None = None
    times: list[float] = []

    def out() -> pa.RecordBatch:
        flat = [x for p in _step_levels(times, capacity, rate) for x in p]
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int64()), pa.array([times[0]]), pa.array([times[-1]]), pa.array([flat], pa.list_(pa.float64()))], ["key", "part", "first", "last", "pieces"])

    for b in batches:
        for k, part, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if held != (k, part):
                if held is not None:
                    yield out()
                held, times = (k, part), []
            times.append(s)
    if held is not None:
        yield out()


def _chain(batches: Iterator[pa.RecordBatch], capacity: float, rate: float) -> Iterator[pa.RecordBatch]:
    """The tokens at the first request of each stretch, over the stretches of a key in order."""
    key, tokens, last = None, capacity, 0.0
    seen = False
    for b in batches:
        rows = []
        for k, part, first, end, flat in zip(*(b.column(i).to_pylist() for i in range(5))):
            if not seen or k != key:
                key, tokens, last, seen = k, capacity, first, True
            tokens = min(capacity, tokens + max(0.0, first - last) * rate)
            rows.append((k, part, tokens))
            tokens = _apply([tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)], tokens)
            last = end
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["key", "part", "tokens"])


def _fold(batches: Iterator[pa.RecordBatch], capacity: float, rate: float) -> Iterator[pa.RecordBatch]:
    at, tokens, last = None, capacity, 0.0
    for b in batches:
        out, wait = [], []
        for k, part, ts, start in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if (k, part) != at:
                at, tokens, last = (k, part), start, ts
            tokens, ok, w = bucket_step(tokens, last, ts, capacity, rate)
            last = ts
            out.append(ok)
            wait.append(w)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.bool_()), pa.array(wait, pa.int64())], ["key", "event", "allowed", "wait_s"])


def token_bucket(df: DataFrame, key: str, event: str, seconds: str, capacity: float = 30.0, rate: float = 0.5) -> DataFrame:
    """(key, event, allowed, wait_s) of each request, in the order of (seconds, event) per key.

    Rows are range-partitioned by (key, seconds, event), so a hot key spans many partitions. What each stretch does to the
    tokens is told by a few levels (at most one a request that could turn, in practice the capacity), which are chained per
    key; then all stretches are folded at once from the tokens they start with. Null keys are one key; null times are dropped.
    """
    ship(df.sparkSession)
    src = df.select(F.col(key).cast("string").alias("key"), F.col(event).cast("long").alias("event"), F.col(seconds).cast("double").alias("s")).where("s is not null")
    order = ["key", "s", "event"]
    parts = materialize(src.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")), "bucket")
    runs = parts.repartition("key", "part").sortWithinPartitions("key", "part", "s", "event").select("key", "part", "s").mapInArrow(lambda it: _levels(it, capacity, rate), "key string, part long, first double, last double, pieces array<double>")
    starts = runs.repartition("key").sortWithinPartitions("key", "part").mapInArrow(lambda it: _chain(it, capacity, rate), "key string, part long, tokens double")
    same = F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.part") == F.col("r.part"))
    begun = parts.alias("l").join(starts.alias("r"), same).select("l.key", "l.part", "l.event", "l.s", "r.tokens")
    return begun.repartition("key", "part").sortWithinPartitions("key", "part", "s", "event").mapInArrow(lambda it: _fold(it, capacity, rate), "key string, event long, allowed boolean, wait_s long")


def prefix_sum(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "prefix") -> DataFrame:
    """Running sum per key in an order that breaks all ties, without one task holding a whole key.

    Rows are range-partitioned by (key, order), so a hot key spans many partitions; sums run inside each part and are
    shifted by the totals of the key's earlier parts, of which there is one row per key and part.
    """
    parted = materialize(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    inside = parted.withColumn("_in", F.sum(value).over(W.partitionBy("_part", *key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    parts = parted.groupBy(*key, "_part").agg(F.sum(value).alias("_sum"))
    shift = parts.withColumn("_before", F.sum("_sum").over(W.partitionBy(*key).orderBy("_part")) - F.col("_sum")).drop("_sum")
    on = None
    left, right = inside.alias("l"), shift.alias("r")
    for k in [*key, "_part"]:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = c if on is None else on & c
    return left.join(right, on).select("l.*", F.col("r._before")).withColumn(name, F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_part", "_in", "_before")


def quota(df: DataFrame, key: list[str], order: list[str], asked: str, limit) -> DataFrame:
    """`granted` per request: what is left of the limit per key, by a clamped running sum; `order` must break all ties.

    `limit` is a number or a column of df. Null keys are one key; a null request asks for nothing, a null limit allows nothing.
    """
    top = F.coalesce(limit if isinstance(limit, Column) else F.lit(limit), F.lit(0)).cast("long")
    p = prefix_sum(df.withColumn("_top", top), key, order, asked, "_cum")
    return p.withColumn("granted", (F.least("_top", F.col("_cum")) - F.least("_top", F.col("_cum") - F.coalesce(asked, F.lit(0)))).cast("long")).drop("_cum", "_top")


#: Conversions a day by plan, and in all for those without a plan of this list.
DAILY, LIFETIME = {"basic": 50, "pro": 200}, 5


def plan_quota(requests: DataFrame, users: DataFrame, uid: str, time: str, event: str, asked: str) -> DataFrame:
    """requests with `plan` and `granted`: users of a paid plan have so many a calendar day (UTC), all others so many in all.

    requests: (uid, time, event, asked); users: (uid, plan), the plan in any case. Requests of unknown or null users count
    as those of one user without a plan each uid.
    """
    plans = users.where(F.col(uid).isNotNull()).groupBy(uid).agg(F.min(F.lower(F.trim("plan"))).alias("plan"))
    r = requests.join(plans, uid, "left")
    paid = F.col("plan").isin(*DAILY)
    r = r.withColumn("_day", F.when(paid, F.to_date(time)))
    top = F.coalesce(*[F.when(F.col("plan") == k, F.lit(v)) for k, v in DAILY.items()], F.lit(LIFETIME))
    return quota(r, [uid, "_day"], [time, event], asked, top).drop("_day")
