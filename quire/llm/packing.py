"""Filling of fixed-capacity containers with texts by lexical retrieval.

The texts' words make an inverted index with BM25 weights, whose document frequencies and mean length are those of all
texts. The index is sharded by content: each text is led by the rarer words that it has in common with others, the texts
are ordered by them, and about `shard` neighbours in that order make a shard, so texts that share rare words lie
together however far apart they came in, and a word of a third of all texts parts by the next one. In a shard the
first unused item seeds a container; the index scores all unused items for it, and the window takes the most related
item after which the room can still be closed. Containers left too empty are opened and packed again. A text longer than
the capacity is cut into full containers and a rest that is packed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm import tokens
from quire.llm.words import words
from quire.session import arrow_rows, materialize, ship

K1, B = 1.2, 0.75
#: Document frequencies are counted in so many hashed places, which bounds the table that is broadcast.
PLACES = 1 << 20


class _Codes(dict):
    def __missing__(self, w: bytes) -> int:
        v = zlib.crc32(w)
        if len(self) < 300_000:
            self[w] = v
        return v


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values over one buffer; value i holds the elements from starts[i] to starts[i + 1]."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _terms(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """Words of each text and how often it has them; with a vocabulary, its tokens too."""
    code = _Codes()
    for b in batches:
        texts = b.column(1).to_pylist()
        each = [words(t) if t else [] for t in texts]
        size = np.array([len(w) for w in each], np.int64)
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(each)), np.uint64, int(size.sum()))
        u, n = np.unique((np.repeat(np.arange(len(each), dtype=np.uint64), size) << np.uint64(32)) | codes, return_counts=True)
        starts = np.searchsorted(u, np.arange(len(each) + 1, dtype=np.uint64) << np.uint64(32))
        out = {"id": b.column(0), "terms": _binary(u.astype(np.uint32), starts), "tf": _binary(np.minimum(n, 65535).astype(np.uint16), starts)}
        if vocabulary:
            out["tokens"] = pa.array(map(vocabulary.value.counts.tokens, texts), pa.int64())
        yield pa.RecordBatch.from_pydict(out)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per place the texts that have a word of it; places -1 and -2: all texts and all their words."""
    n, texts, length = np.zeros(PLACES, np.int64), 0, 0
    for b in batches:
        t = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
        n += np.bincount(t & np.uint32(PLACES - 1), minlength=PLACES)
        texts += b.num_rows
        length += int(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).sum(dtype=np.int64))
    at = n.nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, at]), pa.array(np.r_[texts, length, n[at]])], ["place", "n"])


@dataclass
class Index:
    """What all texts say about a word: its document frequency by place, and the mean length of a text."""

    texts: int
    length: float
    df: np.ndarray

    def weights(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weight of each (term, count, words of its text)."""
        d = self.df[terms & np.uint32(PLACES - 1)].astype(np.float32)
        f = tf.astype(np.float32)
        return np.log1p(np.maximum(self.texts - d + 0.5, 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / max(1.0, self.length)))


def index_of(base: DataFrame) -> Index:
    """Count (terms, tf) of all texts; at most PLACES + 2 numbers come to the driver."""
    got = base.select("terms", "tf").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    at, n = got["place"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    df = np.zeros(PLACES, np.int32)
    df[at[at >= 0]] = np.minimum(n[at >= 0], 2**31 - 1)
    texts, length = (int(n[at == k].sum()) for k in (-1, -2))
    return Index(texts, length / max(1, texts), df)


def _leads(batches: Iterator[pa.RecordBatch], index: Index, level: int, shard: int, most: int = 3) -> Iterator[pa.RecordBatch]:
    """Two words that lead each text to its shard: of its `most` weightiest words that few other texts share, the first by a
    hash, so that texts which share some of them are likely to be led by the same one."""
    for b in batches:
        n = b.num_rows
        x, y = b.column(1).to_pylist(), b.column(2).to_pylist()
        doc = np.repeat(np.arange(n), [len(t) // 4 for t in x])
        t, f = np.frombuffer(b"".join(x), np.uint32), np.frombuffer(b"".join(y), np.uint16)
        length = np.maximum(1, np.bincount(doc, f, n)).astype(np.float32)
        d = index.df[t & np.uint32(PLACES - 1)]
        few = (d > 1) & (d <= shard)
        lone = np.bincount(doc, few, n) == 0  # these are led by words that more texts share
        at = np.flatnonzero(few | (lone[doc] & (d > 1)))
        w = index.weights(t[at], f[at], length[doc[at]])
        at = at[np.lexsort((-w, doc[at]))]
        first = np.searchsorted(doc[at], np.arange(n + 1))
        at = at[np.arange(len(at)) - first[doc[at]] < most]
        h = (((t[at].astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)
        o = np.lexsort((h, doc[at]))
        first = np.searchsorted(doc[at], np.arange(n + 1))
        h, some = np.append(h[o], 0), first[1:] > first[:-1]
        lead = np.where(some, h[first[:-1]], 0)
        second = np.where(some, h[np.minimum(first[:-1] + 1, np.maximum(first[1:] - 1, 0))], 0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lead), pa.array(second)], [*b.schema.names, "lead", "second"])


class Postings:
    """The inverted index of one shard: per word its items and weights; the scores of a seed are summed over its words."""

    def __init__(self, terms: list[bytes], tf: list[bytes], index: Index) -> None:
        self.n = len(terms)
        size = np.array([len(t) // 4 for t in terms], np.int64)
        t = np.frombuffer(b"".join(terms), np.uint32)
        f = np.frombuffer(b"".join(tf), np.uint16)
        item = np.repeat(np.arange(self.n, dtype=np.int32), size)
        length = np.bincount(item, f, minlength=self.n).astype(np.float32)
        order = np.argsort(t, kind="stable")
        t, item = t[order], item[order]
        first = np.r_[True, t[1:] != t[:-1]] if len(t) else np.empty(0, bool)
        start = np.flatnonzero(first)
        count = np.diff(np.r_[start, len(t)])
        word = np.repeat(np.arange(len(start)), count)
        keep = (count > 1)[word]  # a word of one item relates it to none
        w = index.weights(t[keep], f[order][keep], length[item[keep]])
        self.item, self.weight = item[keep], w
        count = count * (count > 1)
        self.start, self.count = np.cumsum(count) - count, count
        by = np.argsort(self.item, kind="stable")
        self.words = word[keep][by]
        self.at = np.searchsorted(self.item[by], np.arange(self.n + 1))
        self.known: dict[int, np.ndarray] = {}

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every item of the shard for a seed's words."""
        if seed not in self.known:
            u = self.words[self.at[seed] : self.at[seed + 1]]
            c = self.count[u]
            end = np.cumsum(c)
            rows = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[u] - end + c, c)
            self.known[seed] = np.bincount(self.item[rows], self.weight[rows], self.n)
        return self.known[seed]


def pack(size: np.ndarray, capacity: int, scores: Callable[[int], np.ndarray], seeds: list[int] | None = None, slack: float = 0.005) -> np.ndarray:
    """The container number of each item; no container exceeds the capacity.

    `scores(i)` rates all items for item i. Every placement asks it: of the items that fit, the most related one is taken
    after which another item closes the room up to `slack` of the capacity, or any item still fits; if there is none, the
    one that leaves the least.
    """
    sz = size.tolist()
    rest = sorted(sz)
    free, alive = [True] * len(sz), np.ones(len(sz), bool)
    box = [-1] * len(sz)
    number = 0

    def take(k: int) -> int:
        free[k] = alive[k] = False
        box[k] = number
        rest.pop(bisect_left(rest, sz[k]))
        return sz[k]

    # an item of more than half the capacity has a container to itself in any case; the others seed in the order of `seeds`
    for seed in [*sorted((i for i, z in enumerate(sz) if 2 * z > capacity), key=lambda i: (-sz[i], i)), *(seeds if seeds is not None else range(len(sz)))]:
        if not free[seed]:
            continue
        room = capacity - take(seed)
        ranked: list[int] = []
        while room > 0 and rest and rest[0] <= room:
            if not ranked:
                s, left = scores(seed), alive.nonzero()[0]
                ranked = left[np.argsort(-s[left], kind="stable")].tolist()
            best, least = -1, capacity + 1
            for k in ranked:
                if not free[k] or (left := room - sz[k]) < 0:
                    continue
                # what would be open after the largest item that still goes in
                gap = 0 if left >= rest[-1] else left - (rest[i - 1] if (i := bisect_right(rest, left)) else 0)
                if gap < least:
                    best, least = k, gap
                    if gap <= slack * capacity:
                        break
            room -= take(best)
        number += 1
    return np.array(box, int)


def _blocks(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.Table]:
    """Consecutive rows in tables of `shard`; the last of a partition takes up to half a shard more."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows >= shard + shard // 2:
            yield held.slice(0, shard)
            held = held.slice(shard)
    if held is not None and held.num_rows:
        yield held


def _pack_shards(batches: Iterator[pa.RecordBatch], specs: list[tuple[int, int]], level: int, loose: float, index: Index, shard: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for no, t in enumerate(_blocks(batches, shard)):
        items = t.column("items").combine_chunks()
        of = pc.list_parent_indices(items).to_numpy()
        each = {k: items.flatten().field(k).to_numpy() for k in ("spec", "part", "start", "size")}
        post = Postings(t.column("terms").to_pylist(), t.column("tf").to_pylist(), index)
        # the texts that most others share their lead with open containers first, before other seeds take their kin
        _, kin, count = np.unique(t.column("lead").to_numpy(), return_inverse=True, return_counts=True)
        first = np.argsort(np.argsort(-count[kin], kind="stable"), kind="stable")
        rows, names, caps, full = [], [], [], []
        for spec, cap in specs:
            own = np.flatnonzero(each["spec"] == spec)
            if not len(own):
                continue
            at, size = of[own], each["size"][own]
            box = pack(size, cap, lambda i, at=at: post.scores(int(at[i]))[at], np.argsort(first[at], kind="stable").tolist())
            rows.append(own)
            names += [f"{spec}-{level}-{part}-{no}-{b}" for b in box.tolist()]
            caps.append(np.full(len(own), cap, np.int32))
            full.append(np.bincount(box, size)[box] < loose * cap)
        if rows:
            own = np.concatenate(rows)
            ids = t.column("id").combine_chunks().take(pa.array(of[own]))
            yield pa.RecordBatch.from_arrays([pa.array(each["spec"][own]), pa.array(np.concatenate(caps)), pa.array(names), ids, *(pa.array(each[k][own]) for k in ("part", "start", "size")), pa.array(np.concatenate(full))], ["spec", "cap", "container", "id", "part", "start", "size", "loose"])


def _full(spec: int, cap: int) -> Column:
    """The containers that a text fills alone, as an array."""
    each = lambda p: F.struct(F.lit(spec).alias("spec"), F.lit(cap).alias("cap"), F.concat_ws("-", F.lit(str(spec)), F.lit("f"), "id", p.cast("string")).alias("container"), p.alias("part"), (p.cast("long") * cap).alias("start"), F.lit(cap).cast("long").alias("size"))
    numbers = F.when(F.col("tokens") >= cap, F.sequence(F.lit(0), (F.col("tokens") / cap).cast("int") - 1))
    return F.transform(F.coalesce(numbers, F.array().cast("array<int>")), each)


def pack_texts(df: DataFrame, sizes: DataFrame | None, specs: list[tuple[int, int]], id_col: str, text_col: str, shard: int = 384, levels: int = 3, loose: float = 0.97) -> DataFrame:
    """(spec_id, capacity, container, id, part, token_from, tokens): every text of every container size.

    `sizes` holds (id, tokens); without it the tokens are counted where the words are, in the same pass. Only texts longer
    than the capacity are split; their rows have part 0, 1, ... and the token at which each part starts. Texts of no tokens
    fit anywhere and get a row of 0 tokens. Null ids are dropped, repeated ids packed once; sizes of capacity <= 0 or null are left out. An empty table gives an empty result. The
    index of the words' frequencies has PLACES hashed places at any size; words of one place share their frequency.
    """
    spark = df.sparkSession
    ship(spark)
    arrow_rows(spark, 2000)
    specs = sorted({(int(s), int(c)) for s, c in specs if s is not None and c is not None and c > 0})
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    if sizes is None:
        voc = tokens.vocabulary(spark, tokens.VOCABULARY)
        vec = src.mapInArrow(lambda it: _terms(it, voc), "id string, terms binary, tf binary, tokens long")
        # of a repeated id the longest text, as with the most tokens of `sizes`
        vec = vec.groupBy("id").agg(F.max(F.struct("tokens", "terms", "tf")).alias("x")).select("id", "x.terms", "x.tf", "x.tokens")
    else:
        n = sizes.groupBy("id").agg(F.max("tokens").alias("tokens")).select(F.col("id").cast("string").alias("id"), "tokens").where("id is not null")
        vec = src.mapInArrow(_terms, "id string, terms binary, tf binary").dropDuplicates(["id"]).join(n, "id")
    base = materialize(vec, "pk-items")
    index = index_of(base)
    copy = spark.sparkContext.broadcast(index)
    total = index.texts
    if not specs:
        return spark.createDataFrame([], "spec_id int, capacity int, container string, id string, part int, token_from long, tokens long")
    cols = ["spec", "cap", "container", "id", "part", "start", "size"]
    parts = base.where(F.col("tokens") >= min(c for _, c in specs)).select("id", F.explode(F.flatten(F.array(*[_full(s, c) for s, c in specs]))).alias("x")).select("x.*", "id")
    rest = F.array(*[F.struct(F.lit(s).alias("spec"), F.when(F.col("tokens") >= c, (F.col("tokens") / c).cast("int")).otherwise(0).cast("int").alias("part"), (F.floor(F.col("tokens") / c) * c).cast("long").alias("start"), (F.col("tokens") % c).cast("long").alias("size"), (F.col("tokens") >= c).alias("cut")) for s, c in specs])
    items = base.select("id", "terms", "tf", F.filter(rest, lambda x: ~(x["cut"] & (x["size"] == 0))).alias("items"))
    done = parts.select(*cols)
    for level in range(levels):
        last = total <= shard or level == levels - 1
        plain = items.select("id", "terms", "tf", F.transform("items", lambda x: F.struct(x["spec"].alias("spec"), x["part"].alias("part"), x["start"].alias("start"), x["size"].alias("size"))).alias("items"))
        keyed = materialize(plain.mapInArrow(lambda it, lv=level: _leads(it, copy.value, lv, shard), "id string, terms binary, tf binary, items array<struct<spec:int,part:int,start:long,size:long>>, lead long, second long"), "pk-keyed")
        order = ["lead", "second", "id"]
        out = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it, lv=level, lo=0.0 if last else loose: _pack_shards(it, specs, lv, lo, copy.value, shard), "spec int, cap int, container string, id string, part int, start long, size long, loose boolean")
        out = materialize(out, "pk-packed")
        done = done.union(out.where("not loose").select(*cols))
        if last:
            break
        again = out.where("loose").groupBy("id").agg(F.collect_list(F.struct("spec", "part", "start", "size")).alias("items"))
        items = materialize(base.select("id", "terms", "tf").join(again, "id"), "pk-again")
        total = items.count()
        if not total:
            break
    return done.select(F.col("spec").alias("spec_id"), F.col("cap").alias("capacity"), "container", "id", "part", F.col("start").alias("token_from"), F.col("size").alias("tokens"))
