"""The catalogue: filters, pages, ranks, facets and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as tx

#: The periods a page can be limited to, in days.
PERIODS = {"today": 1, "week": 7, "biweek": 14, "month": 30}


def filters(topic: str | None = None, year: int | None = None, edition: str | None = None, period: str | None = None, asof: str | None = None) -> Column:
    """The conjunction of the filters given; empty values and unknown periods are no filter. Pushed to the scan."""
    p = F.lit(True)
    if topic:
        p &= F.col("topic") == topic
    if year:
        p &= F.col("year") == year
    if edition == "na":
        p &= F.col("edition").isNull() | (F.col("edition") == "")
    elif edition:
        p &= F.col("edition").ilike(f"%{edition}%")
    if period in PERIODS and asof:
        p &= F.col("created_at") >= F.lit(asof).cast("timestamp_ntz") - F.expr(f"INTERVAL '{PERIODS[period]}' DAY")
    return p


def display(df: DataFrame) -> DataFrame:
    """The shown columns: title else file stem else book_id, topic else 'general'."""
    title = F.coalesce(tx.blank_to_null(F.col("title")), tx.blank_to_null(tx.stem(F.col("filename"))), F.col("book_id"))
    topic = F.coalesce(tx.blank_to_null(F.col("topic")), F.lit("general"))
    return df.select("file_hash", "book_id", title.alias("title"), topic.alias("topic"), "author", "year", "edition", "language", F.coalesce("download_count", F.lit(0)).alias("download_count"), "created_at")


def page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page by downloads, newest first, with the total beside it: top-k, no global sort; the count is a one-row broadcast."""
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(F.coalesce("download_count", F.lit(0)).desc(), F.desc_nulls_last("created_at"), "file_hash").offset(offset).limit(limit)
    return top.join(F.broadcast(total))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order, without one task seeing all rows.

    Rows are range-partitioned by the order, numbered inside their partition, and shifted by the rows of the partitions
    before it; only one count per partition is broadcast. The last column of the order must break all ties.
    """
    from quire.session import materialize

    parted = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "rank")
    local = parted.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_c"))
    shift = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_s"))
    return local.join(F.broadcast(shift), "_p").withColumn(name, F.col("_n") + F.col("_s")).drop("_p", "_n", "_s", "_c")


def upsert(old: DataFrame, new: DataFrame, key: str = "file_hash", keep: str = "download_count") -> DataFrame:
    """Insert or replace by key, the new row winning but for the kept counter; of repeated new keys the last created wins."""
    latest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), F.struct("created_at", F.xxhash64(*[c for c in new.columns if c != key]))).alias("n"))
    rest = [c for c in old.columns if c != key]
    j = old.select(key, F.struct(*rest).alias("o")).join(latest, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0)).alias(c) if c == keep else (F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c))
    return j.select(key, *[pick(c) for c in rest])


def add_downloads(catalog: DataFrame, hits: DataFrame) -> DataFrame:
    """Counters raised by the hits of each book_id, on all rows that carry it."""
    n = hits.groupBy("book_id").agg(F.count("*").alias("_hits"))
    return catalog.join(n, "book_id", "left").withColumn("download_count", F.coalesce("download_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))).drop("_hits")


def text_filter(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows that contain the needle in any of the columns, without regard to case and accents."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.contains(F.coalesce(tx.strip_accents(F.col(c).cast("string")), F.lit("")), tx.strip_accents(F.lit(needle)))
    return df.where(hit)


def point_read(catalog: DataFrame, bodies: DataFrame, file_hash: str | None = None, book_id: str | None = None) -> DataFrame:
    """The row of a content hash (or the least hash of a book) with its body; nothing if there is none. The key is pushed to
    the scans of both tables, so a catalogue laid out by hash opens few files."""
    if file_hash is None:
        c = catalog.where(F.col("book_id") == book_id).groupBy("book_id").agg(F.min_by(F.struct(*[c for c in catalog.columns if c != "book_id"]), "file_hash").alias("r")).select("book_id", "r.*")
        return c.select(*catalog.columns).join(bodies, "file_hash")
    return catalog.where(F.col("file_hash") == file_hash).join(bodies.where(F.col("file_hash") == file_hash), "file_hash")


def touch(catalog: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """The catalogue with the access time of the given hashes moved on; it never goes back, nor before the creation."""
    h = hashes.select("file_hash").distinct().withColumn("_hit", F.lit(True))
    j = catalog.join(h, "file_hash", "left")
    return j.withColumn("accessed_at", F.when(F.col("_hit"), F.greatest("accessed_at", "created_at", now)).otherwise(F.col("accessed_at"))).select(*catalog.columns)


def first_files(files: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """`within`: whether a file is among the first `most` of its batch. Files are numbered by prefix sums over parts, so a
    batch with a third of all files is no single task's work; `order` must break all ties."""
    from quire.operators.limits import prefix_sum

    n = prefix_sum(files.withColumn("_one", F.lit(1).cast("long")), [key], order, "_one", "_no")
    return n.withColumn("within", F.col("_no") <= most).drop("_one", "_no")


def reclassify(catalog: DataFrame, topic: Column) -> DataFrame:
    """Rows whose topic changes get it and the book id that goes with it; `updated` tells which. Counts are one aggregate away."""
    c = catalog.withColumn("_t", topic)
    new = ~F.col("_t").eqNullSafe(F.col("topic"))
    made = tx.book_id(F.col("isbn"), F.col("file_hash"), F.col("language"), F.col("_t"))
    return c.withColumns({"updated": new, "book_id": F.when(new, made).otherwise(F.col("book_id")), "topic": F.when(new, F.col("_t")).otherwise(F.col("topic"))}).drop("_t")


#: Roles in rising order.
ROLES = {"support": 1, "billing": 2, "admin": 3, "superadmin": 4}


def role_level(role: Column) -> Column:
    """The level of a role in any case and with blanks around it; 0 for none."""
    r = F.lower(F.trim(role))
    return F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in ROLES.items()], F.lit(0))


def set_claim(claims: Column, name: str, value: Column) -> Column:
    """A map of claims with one set, or cleared by null, and all others kept."""
    rest = F.map_filter(F.coalesce(claims, F.expr("cast(map() as map<string,string>)")), lambda k, v: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def merge_fields(users: DataFrame, changes: DataFrame, key: str = "uid") -> DataFrame:
    """Users with the fields of the changes that are not null set, new ones added; of repeated changes the greatest value."""
    own = [c for c in changes.columns if c != key]
    ch = changes.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in own])
    j = users.join(ch, key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in users.columns if c != key])
