"""Corpus statistics over characters, words, lines and groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

MATH = "ΑΒΓΔΘΛΞΠΣΦΨΩαβγδεζηθικλμνξπρστυφχψω∑∏∫∂∇√∞≤≥≠≈±×÷∈∉⊂⊆∪∩∀∃→⇒↔"


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def zipf_coverage(df: DataFrame, key: str, count: str, shares: list[float]) -> DataFrame:
    """(share, groups): how many of the largest groups reach each share of the total.

    The running sum needs an order over groups; the groups are first counted by size (a histogram far smaller than the
    groups), and only that histogram is ordered in one place.
    """
    g = df.groupBy(key).agg(F.sum(count).alias("n")).where("n > 0")
    h = g.groupBy("n").agg(F.count("*").alias("k"))
    w = W.orderBy(F.desc("n"))
    run = h.select("n", "k", (F.sum(F.col("n") * F.col("k")).over(w) - F.col("n") * F.col("k")).alias("before"), (F.sum("k").over(w) - F.col("k")).alias("rank"), F.sum(F.col("n") * F.col("k")).over(W.partitionBy()).alias("total"))
    out = None
    for s in shares:
        need = F.lit(s) * F.col("total")
        hit = run.where((F.col("before") < need) & (F.col("before") + F.col("n") * F.col("k") >= need))
        one = hit.select(F.lit(s).alias("share"), (F.col("rank") + F.ceil((need - F.col("before")) / F.col("n"))).cast("long").alias("groups"))
        out = one if out is None else out.union(one)
    return out


def latency(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Count, exact interpolated percentiles and maximum per stage."""
    p = lambda q: F.percentile(F.col(value), F.lit(q))
    return df.groupBy(stage).agg(F.count(value).alias("n"), F.round(p(0.5), 6).alias("p50"), F.round(p(0.95), 6).alias("p95"), F.round(p(0.99), 6).alias("p99"), F.max(value).alias("max"))


def p95_by_index(df: DataFrame, stage: str, value: str) -> DataFrame:
    """The value at the truncated index of 95 % per stage, by counting values instead of collecting a group."""
    v = df.where(F.col(value).isNotNull()).groupBy(stage, value).agg(F.count("*").alias("k"))
    w = W.partitionBy(stage).orderBy(value)
    c = v.select(stage, value, F.sum("k").over(w).alias("cum"), F.sum("k").over(W.partitionBy(stage)).alias("n"))
    return c.where(F.col("cum") > F.floor(F.col("n") * 0.95)).groupBy(stage).agg(F.min(value).alias("p95"))


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _char_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.column(0).dictionary_encode() if b.num_rows else None
        total: dict[tuple[int, int], list[int]] = {}
        for k, t in zip(keys.indices.to_pylist() if keys is not None else [], b.column(1).to_pylist()):
            if t:
                u, n = np.unique(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                for c, m in zip(u.tolist(), n.tolist()):
                    x = total.setdefault((-1 if k is None else k, c), [0, 0])
                    x[0] += m
                    x[1] += 1
        names = keys.dictionary.to_pylist() if keys is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([names[k] if k >= 0 else None for k, _ in total], pa.string()), pa.array([chr(c) for _, c in total], pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["family", "ch", "n", "docs"])


def char_profile(df: DataFrame, family: Column, text: str) -> DataFrame:
    """(family, ch, n, docs): how often each character stands in the texts of a family, and in how many of them.

    Characters are counted within their batch first, so a row is shuffled per family and character of a batch, not per
    character of the text. Null and empty texts count nothing; a null family is one family.
    """
    from quire.session import arrow_rows, ship

    ship(df.sparkSession)
    arrow_rows(df.sparkSession, 2000)
    part = df.select(family.cast("string").alias("family"), F.col(text).cast("string").alias("t")).mapInArrow(_char_rows, "family string, ch string, n long, docs long")
    return part.groupBy("family", "ch").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def load_stats(df: DataFrame, stage: str, value: str, status: str, seconds: str) -> DataFrame:
    """Per stage: requests, requests a second, share of errors (500 and above, or no status), percentiles, and the number of
    requests of each status as 'status=n' in order. `seconds` holds the stage's length on every row."""
    p = lambda q: F.percentile(F.col(value), F.lit(q))
    bad = F.col(status).isNull() | (F.col(status) >= 500)
    # counted by status first, so that the list of a stage is as long as its statuses
    by = df.groupBy(stage, status).agg(F.count("*").alias("_n")).where(F.col(status).isNotNull())
    one = by.groupBy(stage).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(status, "_n"))), lambda x: F.concat_ws("=", x[status].cast("string"), x["_n"].cast("string"))), ",").alias("by_status"))
    g = df.groupBy(stage).agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"), F.max(seconds).alias("_s"), F.round(p(0.5), 6).alias("p50"), F.round(p(0.95), 6).alias("p95"), F.round(p(0.99), 6).alias("p99"), F.max(value).alias("max"))
    rate = F.when(F.col("_s") > 0, F.round(F.col("total") / F.col("_s"), 6)).otherwise(0.0)
    return g.join(one, stage, "left").select(stage, "total", rate.alias("rps"), F.round(F.col("errors") / F.col("total"), 6).alias("error_rate"), "p50", "p95", "p99", "max", F.coalesce("by_status", F.lit("")).alias("by_status"))


#: Control, format, surrogate, private and unassigned characters, but for tab, line feed and return.
SUSPICIOUS = r"[\p{C}&&[^\t\n\r]]"


def charset_audit(df: DataFrame, key: str, text: str) -> DataFrame:
    """(code, n, files): the suspicious characters of all texts as U+XXXX, how often and in how many rows they stand. They are
    counted per row before they are shuffled."""
    c = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(SUSPICIOUS), F.lit(0))).alias("ch")).groupBy(key, "ch").agg(F.count("*").alias("n"))
    o = F.ascii("ch")
    code = F.concat(F.lit("U+"), F.when(o > 0xFFFF, F.hex(o)).otherwise(F.lpad(F.hex(o), 4, "0")))
    return c.groupBy(code.alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def charset_clean(text: Column) -> Column:
    """Whether a text has no suspicious character; null is clean."""
    return ~F.coalesce(text.rlike(SUSPICIOUS), F.lit(False))


def weighted_pick(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement, each in proportion to its weight, the same for the same seed and keys: the rows of
    least -log(u) / weight, where u is a hash of the key. Rows without a positive weight are never drawn."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return df.where(F.col(weight) > 0).withColumn("_o", -F.log(u) / F.col(weight)).orderBy("_o", key).limit(n).drop("_o")
