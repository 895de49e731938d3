"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.session import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component, by minimum-label propagation with pointer jumping.

    Every round halves long chains, so the number of rounds is logarithmic in a component's diameter. A hot node's
    neighbours are pre-aggregated map-side (min), never collected. Lineage is cut by a written table each round.
    Null ends and self-loops are dropped; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")), "cc-l0")
    for _ in range(max_rounds):
        seen = e.join(labels.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        step = labels.join(seen, "u").select("u", F.col("l").alias("old"), F.least("l", "nl").alias("l"))
        up = labels.select(F.col("u").alias("l"), F.col("l").alias("ul"))
        nxt = materialize(step.join(up, "l", "left").select("u", "old", F.least("l", F.coalesce("ul", "l")).alias("l")), "cc-l")
        discard(labels)
        changed = nxt.where("l <> old").limit(1).count()
        labels = nxt
        if not changed:
            discard(e)
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"the labels of the components still change after {max_rounds} rounds")
