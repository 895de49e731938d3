"""The conversion pipeline as one plan: gate, cache probe, cleaning, metadata, catalogue rows, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as tx
from quire.plans.text_queries import CODE, KEYWORDS


def catalogue_rows(files: DataFrame) -> DataFrame:
    """(file_hash, ... metadata, markdown) from (filename, text, created_at): one projection, no shuffle."""
    t = tx.normalize_text(F.col("text"))
    src = files.select("filename", "created_at", F.sha2("text", 256).alias("file_hash"), t.alias("markdown"))
    topic = tx.classify_topic(tx.clean_title(F.col("filename")), F.col("markdown"), KEYWORDS, code_topic="programacion", code_patterns=CODE)
    m = src.select(
        "file_hash", "filename", "created_at", "markdown", tx.isbn_extract(F.col("markdown")).alias("isbn"), tx.clean_title(F.col("filename")).alias("title"), tx.author_from_name(F.col("filename")).alias("author"),
        tx.year_extract(F.col("filename"), F.col("markdown")).alias("year"), tx.edition_extract(F.col("filename"), F.col("markdown")).alias("edition"), topic.alias("topic"),
        F.length("markdown").cast("long").alias("char_count"), tx.word_count(F.col("markdown")).alias("word_count"),
    )
    return m.withColumn("book_id", tx.book_id(F.col("isbn"), F.col("file_hash"), F.lit(None).cast("string"), F.col("topic"))).withColumn("download_count", F.lit(0).cast("long"))


def outcomes(files: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new catalogue rows, outcome of every file): known content is a cache hit and is not converted again; failures
    keep a row. Copies within the batch are converted once."""
    hashed = files.withColumn("file_hash", F.sha2("text", 256))
    known = catalogue.select("file_hash").distinct().withColumn("hit", F.lit(True))
    probe = hashed.join(known, "file_hash", "left")
    bad = F.col("text").isNull() | (F.length(F.trim("text")) == 0)
    status = F.when(bad, "failed").when(F.col("hit"), "cache_hit").otherwise("converted")
    new = catalogue_rows(probe.where(F.col("hit").isNull() & ~bad).dropDuplicates(["file_hash"]))
    return new, probe.select("filename", "file_hash", status.alias("status"))
