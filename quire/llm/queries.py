"""Queries of the training-data operators, and SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import langid, mixing, mojibake, names, neardup, packing, quality, scans, subjects, tokens
from quire.session import small_rows
from quire.sources.tables import table


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per conversion: class of near-identical texts and number of links."""
    c = neardup.near_duplicates(table(spark, d, "conversions"), "file_hash", "markdown", shingle=3, threshold=0.5)
    return c.select(F.col("id").alias("file_hash"), "class_id", "links")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    c = neardup.near_duplicates(table(spark, d, "conversions"), "file_hash", "markdown", shingle=3, threshold=0.5)
    return neardup.pairs_of_classes(c, "file_hash_a", "file_hash_b")


def _cipher(spark: SparkSession, d: str) -> mojibake.Cipher:
    return mojibake.fit(table(spark, d, "conversions"), ["markdown", "title"], table(spark, d, "topic_seed"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = mojibake.garbled(table(spark, d, "conversions"), _cipher(spark, d), "file_hash", ["markdown", "title"])
    return g.select(F.col("id").alias("file_hash"), "field").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    g = mojibake.garbled(table(spark, d, "conversions"), _cipher(spark, d), "file_hash", ["markdown", "title"])
    return g.select(F.col("id").alias("file_hash"), "field", "runs", "restored")


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversions").select("author").union(table(spark, d, "book_results").select("author"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.author_clusters(_spellings(spark, d), "author").select(F.col("name").alias("author"), "entity")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    e = names.author_clusters(_spellings(spark, d), "author").select(F.col("name").alias("id"), F.col("entity").alias("class_id"))
    return neardup.pairs_of_classes(e, "author_a", "author_b")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fit_from(table(spark, d, "topic_seed"))
    return langid.languages(table(spark, d, "conversions"), model, "file_hash", "markdown", "language")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    return s.select(F.col("id").alias("file_hash"), "para_no", "language", F.round("confidence", 6).alias("confidence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    wrong = (F.col("para_no") == 0) & F.col("language").isNotNull() & ~F.col("language").eqNullSafe(F.col("label"))
    other = (F.col("para_no") > 0) & (F.col("language") != F.col("main"))
    return s.where(wrong | other).select(F.col("id").alias("file_hash"), "para_no", "language").distinct()


def _noise(spark: SparkSession, d: str, repair: bool) -> DataFrame:
    c = table(spark, d, "conversions")
    return scans.scan_noise(c, scans.lexicon(c, "markdown"), "file_hash", "markdown", "title", "author", repair)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    n = _noise(spark, d, False).select("id", F.explode("noise").alias("x"))
    return n.select(F.col("id").alias("file_hash"), "x.line_no", "x.kind").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d, True).select(F.col("id").alias("file_hash"), F.size("noise").alias("noisy_lines"), "text")


def _topics(spark: SparkSession, d: str) -> tuple[subjects.Topics, subjects.Prior, DataFrame]:
    """The topic model of the conversions, its prior, and their texts as bags."""
    c = table(spark, d, "conversions")
    p = subjects.labelled(table(spark, d, "topic_seed"))
    cut = subjects.bags(c, p, "file_hash", "markdown")
    return subjects.fit_bags(spark, cut, p), p, cut


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    m, _, cut = _topics(spark, d)
    s = subjects.subjects(cut, m, "file_hash", "markdown", cut=cut)
    return s.select(F.col("id").alias("file_hash"), F.col("subject").alias("topic")).distinct()


def p6_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents and their paragraphs devoted to it."""
    m, _, cut = _topics(spark, d)
    s = subjects.subjects(cut, m, "file_hash", "markdown", cut=cut)
    g = s.groupBy(F.col("subject").alias("topic")).agg(F.count("*").alias("documents"), F.sum(F.col("share") * F.col("paragraphs")).alias("paragraphs"))
    total = g.agg(F.sum("paragraphs").alias("total"))
    return g.join(F.broadcast(total)).select("topic", "documents", F.round("paragraphs").cast("long").alias("paragraphs"), F.round(F.col("paragraphs") / F.col("total"), 6).alias("share"))


def _counted(t: DataFrame, model: subjects.Topics, cut: DataFrame, key: str, text: str) -> DataFrame:
    n = tokens.token_counts(t, key, text).select(F.col("id").cast("string").alias("id"), "tokens")
    s = subjects.slices(t, model, key, text, cut=cut).dropDuplicates(["id"])
    return n.join(s, "id", "left")


def p7_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Exact tokens by table, source, language and subject; language and subject come from the texts, not the labels."""
    m, p, cut = _topics(spark, d)
    t, c = table(spark, d, "documents"), table(spark, d, "conversions")
    doc = t.select(F.col("doc_id").cast("string").alias("id"), "source").dropDuplicates(["id"])
    a = _counted(t, m, subjects.bags(t, p, "doc_id", "text"), "doc_id", "text").join(doc, "id", "left").select(F.lit("documents").alias("collection"), "source", "language", "subject", "tokens")
    b = _counted(c, m, cut, "file_hash", "markdown").select(F.lit("conversions").alias("collection"), F.lit(None).cast("string").alias("source"), "language", "subject", "tokens")
    return a.union(b).groupBy("collection", "source", "language", "subject").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))


def p7_conversion_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "conversions"), "file_hash", "markdown").select(F.col("id").alias("file_hash"), "tokens")


def p7_source_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    n = tokens.token_counts(t, "doc_id", "text").withColumnRenamed("id", "doc_id")
    return n.join(t.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    specs = [tuple(r) for r in small_rows(table(spark, d, "pack_specs").select("spec_id", "capacity_tokens"), 1000)]
    return packing.pack_texts(t, None, specs, "doc_id", "text")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("spec_id", "container", F.col("id").cast("long").alias("doc_id"), "part", "token_from", "tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused space of each capacity."""
    c = _packed(spark, d).groupBy("spec_id", "capacity", "container").agg(F.sum("tokens").alias("t"))
    return c.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.round(F.sum("t") / (F.count("*") * F.first("capacity")), 6).alias("fill"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents")
    size = tokens.token_counts(t, "doc_id", "text").withColumnRenamed("id", "doc_id")
    return mixing.mix(size.join(t.select("doc_id", "source"), "doc_id"), table(spark, d, "mix_targets"), "doc_id", "source", "tokens")


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = quality.quality(table(spark, d, "documents"), quality.language(table(spark, d, "topic_seed")), "doc_id", "text")
    return q.withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    q = quality.quality(table(spark, d, "documents"), quality.language(table(spark, d, "topic_seed")), "doc_id", "text")
    return q.where("kind <> 'prose'").select(F.col("id").alias("doc_id"), "kind").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_restored, p3_found, p3_entities, p4_found, p4_segments, p5_found, p5_repaired, p6_found, p6_corpus_shares, p7_token_budget, p7_conversion_tokens, p7_source_tokens, p8_packing, p8_fill, p9_selection, p9_shares, p10_found, p10_statistics)
}

ORACLE: dict[str, str] = {
    "p1_found": r"""
        WITH w AS (SELECT file_hash, regexp_extract_all(lower(markdown), '[\p{L}\p{N}]+') AS w FROM conversions),
        s AS (SELECT DISTINCT file_hash, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
        n AS (SELECT file_hash, count(*) AS n FROM s GROUP BY file_hash),
        i AS (SELECT a.file_hash AS x, b.file_hash AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.file_hash < b.file_hash GROUP BY ALL)
        SELECT x AS file_hash_a, y AS file_hash_b FROM i JOIN n p ON p.file_hash = x JOIN n q ON q.file_hash = y
        WHERE c >= 0.5 * (p.n + q.n - c)""",
}
