"""Mixing of sources to target shares of all tokens by entropy balancing.

Every document starts from one rate; the rates that meet the sources' token budgets at the least relative entropy are an
exponential tilt of it, rate = m * sigmoid(log(1 / m) + lambda_source * tokens / mean), which the cap of m copies bounds.
The tilts solve the convex dual by Newton steps, whose sums run distributed over counts of (source, tokens). The rates
are rounded into copies by a hash, with a threshold per source that meets the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.session import materialize, small_rows

BINS = 4096


def feasible(targets: list[dict], have: dict[str, float]) -> dict[str, float]:
    """profile -> the most tokens in all at which every source can give its whole share."""
    out: dict[str, float] = {}
    for t in targets:
        share = max(0.0, t["target_share"] or 0.0)
        if share:
            out[t["profile"]] = min(out.get(t["profile"], math.inf), max(0, t["max_repeats"] or 0) * have.get(t["source"], 0.0) / share)
    return out


def budgets(targets: list[dict], have: dict[str, float], totals: dict[str, float] | None = None) -> dict[tuple[str, str], tuple[float, float]]:
    """(profile, source) -> (tokens wanted, most tokens possible): shares of the profile's total, by default all tokens of
    its sources.

    What a capped source cannot give goes to the others in proportion to their shares, so the total stays.
    """
    out: dict[tuple[str, str], tuple[float, float]] = {}
    for profile in sorted({t["profile"] for t in targets}):
        rows = [t for t in targets if t["profile"] == profile]
        share = {t["source"]: max(0.0, t["target_share"] or 0.0) for t in rows}
        most = {t["source"]: max(0, t["max_repeats"] or 0) * have.get(t["source"], 0.0) for t in rows}
        total = (totals or {}).get(profile, sum(have.get(s, 0.0) for s in share))
        want = dict.fromkeys(share, 0.0)
        open_, left = {s for s in share if share[s] > 0}, total
        while open_ and left > 1e-9:
            w = sum(share[s] for s in open_)
            capped = {s for s in open_ if left * share[s] / w >= most[s]}
            if not capped:
                for s in open_:
                    want[s] = left * share[s] / w
                break
            for s in capped:
                want[s] = most[s]
                left -= most[s]
            open_ -= capped
        for s in share:
            out[profile, s] = (want[s], most[s])
    return out


def mix(df: DataFrame, targets: DataFrame, id_col: str, source_col: str, tokens_col: str, steps: int = 60, tolerance: float = 1e-4, max_targets: int = 100_000, totals: dict[str, float] | str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (profile, id, source, tokens, copies >= 1) and the shares reached per (profile, source).

    targets: (profile, source, target_share, max_repeats), at most max_targets rows, which come to the driver (more are an
    error). totals: tokens of each profile's mix; "feasible" for the most at which every share can be met, which the shares
    report as feasible_total in any case; by default all tokens of its sources. Documents
    of null source, null or no tokens are not chosen; sources named by a profile but absent get nothing, and their share
    goes to the others. Repeated ids are separate records. Empty tables give empty results.
    """
    spark = df.sparkSession
    rows = [r.asDict() for r in small_rows(targets.select("profile", "source", "target_share", "max_repeats"), max_targets) if r["profile"] is not None and r["source"] is not None]
    docs = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(tokens_col).cast("long").alias("tokens")).where("source is not null and tokens > 0"), "mx-docs")
    # pre-aggregated: one row per source and length, so a source with a third of the rows costs no more than its lengths
    hist = materialize(docs.groupBy("source", "tokens").agg(F.count("*").alias("n")), "mx-hist")
    stat = {r["source"]: (float(r["t"]), float(r["t"]) / r["n"]) for r in hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).join(F.broadcast(spark.createDataFrame([(r["source"],) for r in rows] or [("",)], "source string").distinct()), "source", "left_semi").collect()}
    have = {s: t for s, (t, _) in stat.items()}
    whole = feasible(rows, have)
    want = budgets(rows, have, whole if totals == "feasible" else totals)
    state = {}
    for r in rows:
        k = (r["profile"], r["source"])
        goal, most = want[k]
        if k[1] in stat and goal > 0:
            state[k] = {"goal": goal, "m": int(r["max_repeats"]), "mean": stat[k[1]][1], "lam": 0.0, "lo": -1e3, "hi": 1e3, "full": goal >= most * (1 - 1e-9), "done": False}
    schema = "profile string, source string, m int, mean double, lam double, full boolean"
    table = lambda: spark.createDataFrame([(p, s, v["m"], v["mean"], v["lam"], v["full"]) for (p, s), v in state.items()], schema)

    def rate():
        x = -F.log(F.col("m").cast("double")) + F.col("lam") * F.col("tokens") / F.col("mean")
        return F.when(F.col("full"), F.col("m").cast("double")).otherwise(F.col("m") / (1 + F.exp(-x)))

    for _ in range(steps):
        todo = {k for k, v in state.items() if not v["full"] and not v["done"]}
        if not todo:
            break
        j = hist.join(table().where(~F.col("full")), "source").withColumn("r", rate())
        t, u = F.col("tokens") * F.col("n"), F.col("tokens") / F.col("mean")
        for g in j.groupBy("profile", "source").agg(F.sum(t * F.col("r")).alias("g"), F.sum(t * u * F.col("r") * (1 - F.col("r") / F.col("m"))).alias("h")).collect():
            v = state[g["profile"], g["source"]]
            gap = g["g"] - v["goal"]
            v["done"] = abs(gap) <= tolerance * v["goal"]
            if v["done"]:
                continue
            v["hi" if gap > 0 else "lo"] = v["lam"]
            step = v["lam"] - gap / g["h"] if g["h"] > 1e-12 else math.inf
            # a Newton step outside the bracket is replaced by its middle
            v["lam"] = step if v["lo"] < step < v["hi"] and abs(step - v["lam"]) < 8 else (v["lo"] + v["hi"]) / 2 if v["lo"] > -1e3 or v["hi"] < 1e3 else v["lam"] - math.copysign(4, gap)
    else:
        if any(not v["full"] and not v["done"] for v in state.values()):
            raise RuntimeError(f"the tilts of the sources have not converged after {steps} steps")
    chosen = docs.join(table(), "source").withColumn("r", rate())
    frac = F.col("r") - F.floor("r")
    u = (F.pmod(F.xxhash64("profile", "id"), F.lit(1 << 30)) + 0.5) / F.lit(1 << 30)
    # a document's place in its source's order of extra copies: the smaller its hash against its fraction, the earlier
    place = F.when(frac > 1e-9, F.least(F.lit(BINS - 1), F.floor(F.lit(BINS / 8.0) * u / frac))).cast("int")
    chosen = materialize(chosen.select("profile", "source", "id", "tokens", F.floor("r").cast("int").alias("base"), place.alias("bin")), "mx-rates")
    # the cut of each source where the running sum of its bins comes nearest to what it should give; nothing comes to the driver
    grid = chosen.groupBy("profile", "source", "bin").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("base")).alias("b"))
    aims = spark.createDataFrame([(p, s, float(v["goal"])) for (p, s), v in state.items()], "profile string, source string, goal double")
    own = W.partitionBy("profile", "source")
    run = grid.withColumn("b", F.sum("b").over(own)).withColumn("at", F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("t"))).over(own.orderBy(F.col("bin").asc_nulls_first())), F.lit(0)) + F.col("b"))
    none = run.groupBy("profile", "source").agg(F.first("b").alias("at")).withColumn("bin", F.lit(-1))
    run = run.where("bin is not null").select("profile", "source", "at", "bin").unionByName(none)
    cuts = run.join(aims, ["profile", "source"]).groupBy("profile", "source").agg(F.min_by("bin", F.struct(F.abs(F.col("at") - F.col("goal")), "bin")).alias("cut"))
    picked = chosen.join(cuts, ["profile", "source"]).select("profile", "id", "source", "tokens", (F.col("base") + F.when(F.col("bin") <= F.col("cut"), 1).otherwise(0)).cast("int").alias("copies")).where("copies > 0")
    got = picked.groupBy("profile", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    goals = spark.createDataFrame([(r["profile"], r["source"], r["target_share"], r["max_repeats"], float(want[r["profile"], r["source"]][0]), (r["profile"], r["source"]) in state and state[r["profile"], r["source"]]["full"], whole.get(r["profile"])) for r in rows], "profile string, source string, target_share double, max_repeats int, budget double, capped boolean, feasible_total double")
    all_ = got.groupBy("profile").agg(F.sum("mixed").alias("whole"))
    shares = goals.join(got, ["profile", "source"], "left").join(F.broadcast(all_), "profile", "left").select("profile", "source", "target_share", "max_repeats", "budget", "capped", "feasible_total", F.coalesce("mixed", F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col("mixed") / F.col("whole"), F.lit(0.0)).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    return picked, shares
