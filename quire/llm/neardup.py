"""Near-duplicate records by a chosen-path similarity join.

Every text becomes the set of its distinct runs of `shingle` words; the set is embedded as `T` min-hash tokens
(position, value), whose overlap equals the Jaccard similarity in expectation. A run is a tree: at each node every set
samples, by a hash of the node, each of its tokens with probability 1 / (split * T) and descends into the child named by
that token. Two sets of similarity s share s / split children on average, so similar pairs survive and unlike ones part.
Buckets of at most `small` sets are compared by brute force, larger ones are split again; the runs repeat until the
capture rate measured over the runs says that the target recall is reached. Candidates are then checked exactly.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.operators.graph import connected_components
from quire.session import arrow_rows, discard, materialize, ship

T = 64  # min-hash tokens of one set
WORD = re.compile(r"[^\W_]+")
_A = (np.random.default_rng(7).integers(1, 2**63, T, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.default_rng(8).integers(0, 2**63, T, dtype=np.uint64)
_POS = np.random.default_rng(9).integers(0, 2**63, T, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Codes(dict):
    def __missing__(self, w: str) -> int:
        b = w.encode("utf-8", "surrogatepass")
        v = (zlib.crc32(b) << 32) | zlib.crc32(b[::-1], 77)
        if len(self) < 400_000:
            self[w] = v
        return v


def shingle_set(text: str | None, k: int, codes: dict) -> np.ndarray:
    """Sorted distinct 64-bit codes of the runs of k words; a text of fewer words is one run of all its words."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    c = np.fromiter((codes[w] for w in words), np.uint64, len(words))
    n = max(1, len(c) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(c))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n] + np.uint64(i + 1))
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """T min-hash values of a set, 32 bits each."""
    out = np.full(T, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (s[i : i + 4096, None] * _A + _B).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _children(node: np.ndarray, sig: np.ndarray, split: float) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(node[:, None] ^ _mix(sig.astype(np.uint64) + _POS))
    row, pos = np.nonzero(h < np.uint64(int(2**64 / (split * T))))
    return row, _mix(h[row, pos] + np.uint64(1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for b in batches:
        sets = [shingle_set(t, shingle, codes) for t in b.column(1).to_pylist()]
        keep = [i for i, s in enumerate(sets) if len(s)]
        if keep:
            whole = [int(_mix(sets[i] * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) ^ np.uint64(len(sets[i]))) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)).cast(pa.string()), _signed(np.array(whole, np.uint64)), pa.array([len(sets[i]) for i in keep], pa.int32()), pa.array([signature(sets[i]).tobytes() for i in keep], pa.binary())],
                ["id", "whole", "n", "sig"],
            )


def _sigs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, T)


def _roots(batches: Iterator[pa.RecordBatch], runs: list[int], split: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig, k = _sigs(b.column(1)), b.column(0).to_numpy()
            for r in runs:
                row, child = _children(np.full(len(k), (r + 1) * 0xD6E8FEB86659FD93 % 2**64, np.uint64), sig, split)
                yield pa.RecordBatch.from_arrays([pa.array(k[row]), _signed(child), pa.array(np.full(len(row), r, np.int32))], ["k", "node", "run"])


def _descend(batches: Iterator[pa.RecordBatch], split: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            k, node, run = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            row, child = _children(node.view(np.uint64), _sigs(b.column(3)), split)
            yield pa.RecordBatch.from_arrays([pa.array(k[row]), _signed(child), pa.array(run[row])], ["k", "node", "run"])


def _brute(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, run, k, sig) come sorted by node; a bucket cut by a batch's end is carried over."""
    held: pa.Table | None = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        node, run, k = (t.column(i).to_numpy() for i in range(3))
        sig = _sigs(t.column(3).combine_chunks() if t.num_rows else t.column(3))
        cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, int)
        a, b, r = [], [], []
        for i, j in zip(cut, np.r_[cut[1:], len(node)]):
            if j - i > 1:
                s = sig[i:j]
                x, y = np.nonzero(np.triu((s[:, None, :] == s[None, :, :]).mean(2) >= least, 1))
                p, q = k[i + x], k[i + y]
                ok = p != q
                a.append(np.minimum(p, q)[ok]), b.append(np.maximum(p, q)[ok]), r.append(run[i + x][ok])
        cat = lambda v, t: pa.array(np.concatenate(v) if v else np.empty(0, t))
        return pa.RecordBatch.from_arrays([cat(a, np.int64), cat(b, np.int64), cat(r, np.int32)], ["a", "b", "run"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        node = held.column(0).to_numpy()
        last = int(np.searchsorted(node, node[-1]))
        if last:
            yield pairs(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield pairs(held.combine_chunks())


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(t, shingle, codes).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["k", "id", "s"])


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(same >= threshold * (len(p) + len(q) - same) - 1e-9)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _block(t: pa.Table, threshold: float) -> pa.Table:
    """All pairs between two parts (or within one part) of a large bucket, compared exactly."""
    lo, hi, part = (t.column(c).to_numpy() for c in ("lo", "hi", "part"))
    ids = t.column("id").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()]
    size = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count > 1  # a run of one set alone adds to no intersection
    col, row = (np.cumsum(shared) - 1)[col][shared[col]], row[shared[col]]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    same = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, int(shared.sum()), 4096):
        x, y = np.searchsorted(col, [i, i + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[x:y], col[x:y] - i] = 1
        same += m[left] @ m[right].T
    ok = same >= threshold * (size[left][:, None] + size[right][None, :] - same) - 1e-9
    u, v = np.nonzero(np.triu(ok, 1) if len(lo) and lo[0] == hi[0] else ok)
    return pa.table({"a": pa.array([ids[i] for i in left[u]], pa.string()), "b": pa.array([ids[i] for i in right[v]], pa.string())})


def _all_pairs(hot: DataFrame, sets: DataFrame, threshold: float, part: int = 512) -> DataFrame:
    """Links (a, b) of the groups in hot (k, group): every pair of a group is compared exactly, in blocks of two parts."""
    n = hot.groupBy("group").agg(F.ceil(F.count("*") / part).alias("parts"))
    rows = hot.join(n, "group").join(sets, "k").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
    rows = rows.select("group", "part", "id", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.select("group", "part", "id", "s", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return rows.groupBy("group", "lo", "hi").applyInArrow(lambda t: _block(t, threshold), "a string, b string")


def capture_rate(mean: float, runs: int) -> float:
    """The chance that one run captures a pair, from the mean captures of the pairs that were captured at all: those never
    captured are missing from the mean, which is that of a binomial without its zero."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if runs * p / max(1e-300, 1 - (1 - p) ** runs) < mean:
            lo = p
        else:
            hi = p
    return lo


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, recall: float = 0.995, split: float | None = None, small: int = 48, runs: int = 8, max_depth: int = 8, max_runs: int = 32
) -> DataFrame:
    """(id, class_id, links): one row per record with the least id of its class and its number of verified links.

    Records of equal shingle sets are collapsed to one representative first, so a group of copies however large costs
    one row; `links` counts the linked representatives plus the record's copies. Buckets that max_depth splits leave
    large (near copies of one text, texts of one template) are merged where they share sets, and all pairs of such a
    group are compared exactly. A warning tells when max_runs ends the runs before the recall is reached.
    Null or wordless texts are classes of their own with no links. Null ids are dropped; repeated ids count once. An
    empty table gives an empty result. Other columns of df are not read.
    """
    spark = df.sparkSession
    ship(spark)
    arrow_rows(spark, 2000)
    split = split or max(0.1, threshold)
    least = max(0.05, threshold - 3 * math.sqrt(threshold * (1 - threshold) / T))
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    sk = materialize(src.mapInArrow(lambda it: _sketches(it, shingle), "id string, whole long, n int, sig binary"), "nd-sketch")
    member = sk.groupBy("whole", "n").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    reps = materialize(sk.join(member.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", F.xxhash64("id").alias("k"), "sig"), "nd-reps")
    found: DataFrame | None = None
    stars: DataFrame | None = None
    hot: DataFrame | None = None
    done = 0
    while done < max_runs:
        batch = list(range(done, min(done + runs, max_runs)))
        done += len(batch)
        parts, written, frontier = [], [], reps.select("k", "sig").mapInArrow(lambda it, rs=batch: _roots(it, rs, split), "k long, node long, run int")
        for depth in range(max_depth):
            frontier = materialize(frontier, "nd-frontier")
            size = frontier.groupBy("node", "run").count().where("count > 1")
            sized = materialize(frontier.join(size, ["node", "run"]), "nd-sized")
            discard(frontier)
            written.append(sized)
            parts.append(sized.where(F.col("count") <= small).select("k", "node", "run"))
            large = sized.where(F.col("count") > small).select("k", "node", "run")
            if not large.limit(1).count():
                large = None
                break
            frontier = large.join(reps.select("k", "sig"), "k").select("k", "node", "run", "sig").mapInArrow(lambda it: _descend(it, split), "k long, node long, run int")
        if large is not None and large.limit(1).count():
            # each bucket as links to its least set; buckets that share a set make one group
            least_set = large.groupBy("node", "run").agg(F.min("k").alias("p"))
            new = large.join(least_set, ["node", "run"]).select(F.col("p").alias("a"), F.col("k").alias("b")).where("a <> b").distinct()
            stars = materialize(new if stars is None else stars.union(new).distinct(), "nd-stars")
            hot = connected_components(stars).select(F.col("node").alias("k"), F.col("component").alias("group"))
        buckets = parts[0]
        for p in parts[1:]:
            buckets = buckets.union(p)
        pairs = buckets.join(reps.select("k", "sig"), "k").select("node", "run", "k", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(lambda it: _brute(it, least), "a long, b long, run int")
        found = pairs if found is None else found.union(pairs)
        if hot is not None:  # pairs within a group are compared without sampling, so they don't count for the capture rate
            ga, gb = hot.select(F.col("k").alias("a"), F.col("group").alias("ga")), hot.select(F.col("k").alias("b"), F.col("group").alias("gb"))
            found = found.join(ga, "a", "left").join(gb, "b", "left").where("not coalesce(ga = gb, false)").select("a", "b", "run")
        found = materialize(found.distinct(), "nd-found")
        discard(*written)
        n, hits = found.groupBy("a", "b").count().agg(F.count("*"), F.sum("count")).first()
        rate = capture_rate(hits / n, done) if n else 1.0
        if not n or 1 - (1 - rate) ** done >= recall:
            break
    else:
        warnings.warn(f"near_duplicates: {done} runs capture an estimated {1 - (1 - rate) ** done:.4f} of the pairs, less than the recall of {recall}", stacklevel=2)
    cand = found.select("a", "b").distinct()
    who = cand.select(F.col("a").alias("k")).union(cand.select(F.col("b").alias("k")))
    who = materialize((who if hot is None else who.union(hot.select("k"))).distinct(), "nd-who")
    ids = reps.join(who, "k", "left_semi").select("k", "id")
    sets = materialize(src.join(ids, "id").dropDuplicates(["id"]).select("k", "id", "t").mapInArrow(lambda it: _sets(it, shingle), "k long, id string, s binary"), "nd-sets")
    left, right = (sets.select(F.col("k").alias(c), F.col("id").alias(f"{c}id"), F.col("s").alias(f"{c}s")) for c in "ab")
    edges = cand.join(left, "a").join(right, "b").select("aid", "bid", "as", "bs").mapInArrow(lambda it: _exact(it, threshold), "a string, b string")
    edges = materialize(edges if hot is None else edges.union(_all_pairs(hot, sets, threshold)), "nd-edges")
    comp = connected_components(edges).withColumnRenamed("node", "rep")
    degree = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").count().withColumnRenamed("a", "rep")
    classes = member.join(comp, "rep", "left").join(degree, "rep", "left").select("whole", "n", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("count", F.lit(0))).alias("links"))
    known = sk.select("id", "whole", "n").join(classes, ["whole", "n"]).groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    return src.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def pairs_of_classes(classes: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of one class, for results that ask for all of them; classes of one record are dropped before the join."""
    c = materialize(classes.select("id", "class_id").join(classes.groupBy("class_id").count().where("count > 1"), "class_id"), "nd-classes")
    left, right = c.select("class_id", F.col("id").alias(a)), c.select("class_id", F.col("id").alias(b))
    return left.join(right, "class_id").where(F.col(a) < F.col(b)).select(a, b)
