"""Token counts under a public byte-level BPE tokenizer, from prefix tries of distinct pieces.

Texts are cut into pieces by the tokenizer's own pattern in the JVM and reduced to distinct pieces. The pieces are
range-partitioned, so that every partition is a slice of one prefix trie; walking its pieces in order, the state of the
shared prefix is kept and only the new bytes are worked on. The state of a prefix is the last token of its encoding and
its number of tokens: the encoding of a longer prefix is that of a shorter one plus the one token that may follow it,
which is exact for merge-ranked BPE. The counts of the terminal pieces are then joined to the documents.

An operator that reads the texts in Python anyway counts them there instead, with the same pattern and vocabulary
(`PieceCounts`): no pieces are shuffled and no second pass over the texts is needed.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import arrow_rows, materialize, ship

#: Where the vocabulary lies by default, and its pattern in Java's notation (white space as Unicode has it).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_S = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PIECES = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class Vocabulary:
    """A merge-ranked byte-level vocabulary, and what has been learned about which token may follow which.

    Two tokens may stand side by side if no merge across their border comes before the merges that made them. The merges
    are undone from the last to the first, by the pair that each token was merged from, so no bytes are merged anew.
    """

    def __init__(self, rank: dict[bytes, int]) -> None:
        self.rank = rank
        self.bytes_of = {r: b for b, r in rank.items()}
        # the lengths of the entries that end in the same two bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for b in rank:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {e: tuple(sorted(n | {1}, reverse=True)) for e, n in ends.items()}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.pair: dict[tuple[int, int], bool] = {}
        self.counts = PieceCounts(self)

    def __getstate__(self) -> dict[bytes, int]:
        return self.rank

    def __setstate__(self, rank: dict[bytes, int]) -> None:
        self.__init__(rank)

    def merge(self, piece: bytes) -> list[bytes]:
        """The parts of a piece when one merge is left, or when no merge is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best, at = 1 << 60, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, piece: bytes) -> int:
        """The number of tokens of a piece by merging its bytes."""
        rank, no = self.rank, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        near = [rank.get(piece[i : i + 2], no) for i in range(len(piece) - 1)]
        while near and (r := min(near)) < no:
            i = near.index(r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = rank.get(parts[i - 1] + parts[i], no)
            if i < len(near):
                near[i] = rank.get(parts[i] + parts[i + 1], no)
        return len(parts)

    def parts(self, t: int) -> tuple[int, int] | None:
        """The pair a token is merged from; None for a single byte; (-1, -1) if merging its bytes never gives it."""
        if t not in self.made:
            b = self.bytes_of[t]
            two = self.merge(b) if len(b) > 1 else []
            self.made[t] = None if len(b) == 1 else (self.rank[two[0]], self.rank[two[1]]) if len(two) == 2 else (-1, -1)
        return self.made[t]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a in an encoding."""
        k = (a, b)
        got = self.pair.get(k)
        if got is None:
            got = self.pair[k] = self._apart(a, b)
        return got

    def _apart(self, x: int, y: int) -> bool:
        before = 1 << 60
        while True:
            r = self.rank.get(self.bytes_of[x] + self.bytes_of[y])
            if r is not None and r < before:
                return False
            px, py = self.parts(x), self.parts(y)
            if px is not None and (py is None or x > y):
                before, x = x, px[1]
            elif py is not None:
                # of equal ranks the left one is merged first, so the border would win a tie
                before, y = y + 1, py[0]
            else:
                return True


class Walk:
    """Counts of tokens of pieces; consecutive calls share the states of the common prefix."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.prefix = b""
        self.last: list[int] = []
        self.total: list[int] = []

    def count(self, piece: bytes) -> int:
        v, n = self.v, 0
        rank, lengths, follows = v.rank, v.lengths, v.follows
        for x, y in zip(self.prefix, piece):
            if x != y:
                break
            n += 1
        last, total = self.last, self.total
        del last[n:], total[n:]
        for end in range(n + 1, len(piece) + 1):
            for size in lengths.get(piece[end - 2 : end], (1,)) if end > 1 else (1,):
                if size > end:
                    continue
                t = rank.get(piece[end - size : end])
                if t is None:
                    continue
                if size == end:
                    if v.parts(t) != (-1, -1):
                        last.append(t), total.append(1)
                        break
                elif follows(last[end - size - 1], t):
                    last.append(t), total.append(total[end - size - 1] + 1)
                    break
        self.prefix = piece
        return total[-1] if total else 0


@lru_cache
def _cutter(top: int) -> Callable[[str], list[str]]:
    """PIECES in Python's notation, for texts without characters beyond `top`."""
    p = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", PIECES)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(top + 1))
    for k in "LN":
        ranges = "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{k}+", kinds))
        p = p.replace(rf" ?\p{{{k}}}+", f" ?[{ranges}]+").replace(rf"\p{{{k}}}", ranges)
    return re.compile(p).findall


def cut(text: str) -> list[str]:
    """The pieces of a text, as PIECES gives them in the JVM."""
    # a table finds the kinds of characters up to U+FFFF; those beyond it are searched among ranges, at three times the cost
    return _cutter(0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 0x10FFFF)(text)


class PieceCounts(dict):
    """Tokens of the pieces met so far, up to a fixed number of them; any other piece is merged when it is asked for."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000, short: int = 64) -> None:
        self.v, self.most, self.short = vocabulary, most, short

    def __missing__(self, piece: str) -> int:
        b = piece.encode("utf-8", "replace")
        if len(b) > self.short:  # merging takes the square of the length, the walk does not
            return Walk(self.v).count(b)
        n = self.v.merged(b)
        if len(self) < self.most:
            self[piece] = n
        return n

    def tokens(self, text: str | None) -> int:
        return sum(map(self.__getitem__, cut(text))) if text else 0


_SENT: dict[tuple[str, str], Broadcast] = {}


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary of a file on the driver, broadcast once per application; executors read no file."""
    k = (spark.sparkContext.applicationId, path)
    if k not in _SENT:
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _SENT[k] = spark.sparkContext.broadcast(Vocabulary(rank))
    return _SENT[k]


def _count(batches: Iterator[pa.RecordBatch], copy: Broadcast) -> Iterator[pa.RecordBatch]:
    walk = Walk(copy.value)  # what the worker has learned stays with its copy
    for b in batches:
        pieces = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([walk.count(p.encode("utf-8", "replace")) for p in pieces], pa.int32())], ["piece", "tokens"])


def pieces(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, piece, n): the distinct pieces of every text."""
    cut = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PIECES), F.lit(0)))
    return df.select(key, cut.alias("piece")).groupBy(key, "piece").agg(F.count("*").alias("n"))


def piece_counts(distinct: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(piece, tokens) of distinct pieces, each partition a sorted slice of the prefix trie."""
    copy = vocabulary(distinct.sparkSession, path)
    return distinct.repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(lambda it: _count(it, copy), "piece string, tokens int")


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, head: int = 16_384) -> DataFrame:
    """(id, tokens) of every distinct (id, text) with a non-null id; null and empty texts have 0 tokens.

    The `head` most frequent pieces of a sample (a fixed bound) are broadcast and summed where the documents lie; all other pieces
    are joined by shuffle, so the counts are exact. Repeated rows count once; other columns are not read. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    arrow_rows(spark, 10_000)
    # a row is known by 96 bits of its id and text, so that neither is shuffled with the pieces
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null").withColumn("row", F.struct(F.xxhash64("id", "t").alias("h"), F.hash("t", "id").alias("g")))
    words = src.select("row", F.explode(F.regexp_extract_all("t", F.lit(PIECES), F.lit(0))).alias("piece"))
    # which pieces are broadcast is chosen from a sample; whatever it misses is counted exactly by the other way
    some = src.sample(0.05, seed=5).select(F.explode(F.regexp_extract_all("t", F.lit(PIECES), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(head)
    first = materialize(piece_counts(some.select("piece"), path), "tk-head")
    top = F.broadcast(first.withColumnRenamed("tokens", "known"))
    split = words.join(top, "piece", "left")
    # one pass over the texts: what the broadcast knows is summed at once, the rest keeps its piece
    part = materialize(split.groupBy("row", F.when(F.col("known").isNull(), F.col("piece")).alias("rest")).agg(F.sum(F.coalesce("known", F.lit(0))).alias("tokens"), F.count("*").alias("n")), "tk-part")
    counted = piece_counts(part.where("rest is not null").select(F.col("rest").alias("piece")).distinct(), path)
    rare = part.where("rest is not null").join(counted, F.col("rest") == F.col("piece")).select("row", (counted["tokens"] * F.col("n")).cast("long").alias("tokens"))
    total = part.where("rest is null").select("row", F.col("tokens").cast("long").alias("tokens")).union(rare).groupBy("row").agg(F.sum("tokens").alias("tokens"))
    # copies of one row were summed together
    rows = src.groupBy("row").agg(F.first("id").alias("id"), F.count("*").alias("copies"))
    return rows.join(total, "row", "left").select("id", F.coalesce((F.col("tokens") / F.col("copies")).cast("long"), F.lit(0)).cast("long").alias("tokens"))
