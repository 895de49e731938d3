"""A range join as an equi-join on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Points with each span that holds them (start <= point < end), by buckets of `width` instead of a nested loop.

    A span is listed once per bucket it touches and a point lies in one, so no pair comes twice; wide spans cost their
    number of buckets, and points of a hot key part over its buckets. Null ends and empty spans match nothing. `how` is
    inner, or left to keep the points without a span (null ones too). The two sides must not share column names beyond `keys`.
    """
    keys = keys or []
    b = lambda c: F.floor(c / width)
    s = spans.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(end) - 1))))
    p = (points if how == "left" else points.where(F.col(point).isNotNull())).withColumn("_b", b(F.col(point)))
    on = F.lit(True)
    for k in [*keys, "_b"]:
        on = on & (F.col(f"_p.{k}") == F.col(f"_s.{k}"))
    on = on & (F.col(f"_p.{point}") >= F.col(f"_s.{start}")) & (F.col(f"_p.{point}") < F.col(f"_s.{end}"))
    return p.alias("_p").join(s.alias("_s"), on, how).select(*[F.col(f"_p.{c}") for c in points.columns], *[F.col(f"_s.{c}") for c in spans.columns if c not in keys])
