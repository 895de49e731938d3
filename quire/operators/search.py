"""Typo-tolerant ranked search over index documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import strip_accents

#: Searched attributes by priority, those shown, those of suggestions; the farthest distance of two words.
ATTRIBUTES = ["title", "author", "description", "isbn", "tags", "publisher"]
SUGGESTED = ["id", "title"]
FAR = 8


def tokens(c: Column) -> Column:
    """Words in lower case and without accents."""
    return F.filter(F.split(strip_accents(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_words(query: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


def budget(word: str) -> int:
    """Typing errors allowed: none below four letters, one below eight, two from there."""
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def index_filter(filetype: str = "any", language: str = "any", site: str = "any") -> Column:
    p = F.lit(True)
    for c, v in (("filetype", filetype), ("language", language), ("source_site", site)):
        if v != "any":
            p &= F.col(c) == v
    return p


def postings(df: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """The inverted index (token, id, attribute, positions) of documents with an id; attributes that df lacks are passed over.

    Written once (partitioned by a prefix of the token, say), it serves every query; one document of repeated rows counts.
    """
    have = [(r, a) for r, a in enumerate(attributes) if a in df.columns]
    kinds = dict(df.dtypes)
    text = lambda a: F.concat_ws(" ", a) if kinds[a].startswith("array") else F.coalesce(F.col(a).cast("string"), F.lit(""))
    each = F.array(*[F.struct(F.lit(r).alias("attribute"), tokens(text(a)).alias("t")) for r, a in have])
    d = df.where("id is not null").dropDuplicates(["id"]).select("id", F.explode(each).alias("x"))
    t = d.select("id", "x.attribute", F.posexplode("x.t").alias("pos", "token"))
    return t.groupBy("token", "id", "attribute").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def meeting(distinct: DataFrame, query: str) -> DataFrame:
    """(token, word, typos): which distinct tokens meet which word of a query. A word meets a token that equals it, is within
    its budget of typing errors, or, for the last word, begins with it."""
    words = query_words(query)
    hits = []
    for i, w in enumerate(words):
        n = F.when((F.col("token") == w) | (F.col("token").startswith(w) if i == len(words) - 1 else F.lit(False)), 0).otherwise(F.levenshtein("token", F.lit(w), budget(w)))
        hits.append(F.when(n >= 0, F.struct(F.lit(i).alias("word"), n.alias("typos"))))
    met = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.expr("cast(array() as array<struct<word:int,typos:int>>)")
    return distinct.select("token", F.explode(met).alias("m")).select("token", "m.word", "m.typos")


def matches(df: DataFrame, query: str, attributes: list[str] = ATTRIBUTES, index: DataFrame | None = None) -> DataFrame:
    """(id, words, typos, proximity, attribute, exact): how each document meets the words of a query.

    The typing errors are weighed once per distinct token, not per document, and the few tokens that meet a word are
    joined with the index (built here if none is given). `proximity` sums, over the words that follow one another in the
    query, the least distance of their places in one attribute, at most FAR, also where a word is missing.
    """
    from quire.session import materialize

    words = query_words(query)
    p = index if index is not None else materialize(postings(df, attributes), "postings")
    met = meeting(p.select("token").distinct(), query)
    hit = p.join(met, "token")
    per = hit.groupBy("id", "word").agg(F.min(F.struct("typos", "attribute")).alias("best"), F.max((F.col("token") == F.element_at(F.array(*[F.lit(w) for w in words] or [F.lit("")]), F.col("word") + 1)).cast("int")).alias("exact"), F.collect_list(F.struct("attribute", "positions")).alias("at"))
    by = per.groupBy("id").agg(F.count("*").cast("int").alias("words"), F.sum("best.typos").cast("int").alias("typos"), F.min("best.attribute").alias("attribute"), F.sum("exact").cast("int").alias("exact"), F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("m"))
    near = F.lit(0)
    for i in range(len(words) - 1):
        a, b = F.try_element_at("m", F.lit(i)), F.try_element_at("m", F.lit(i + 1))
        gaps = F.flatten(F.transform(a, lambda x: F.flatten(F.transform(F.filter(b, lambda y: y["attribute"] == x["attribute"]), lambda y: F.flatten(F.transform(x["positions"], lambda u: F.transform(y["positions"], lambda v: F.abs(u - v))))))))
        near = near + F.least(F.lit(FAR), F.coalesce(F.array_min(F.filter(gaps, lambda g: g > 0)), F.lit(FAR)))
    return by.select("id", "words", "typos", near.cast("int").alias("proximity"), "attribute", "exact")


def search(df: DataFrame, query: str, page: int = 1, limit: int = 20, strategy: str = "all", attributes: list[str] = ATTRIBUTES, index: DataFrame | None = None) -> DataFrame:
    """A page of hits by words, typos, proximity, attribute, exactness and id. 'all' asks for every word, 'last' for at least
    one. A query without words hits nothing."""
    m = matches(df, query, attributes, index)
    if strategy == "all":
        m = m.where(F.col("words") == len(query_words(query)))
    return m.orderBy(F.desc("words"), "typos", "proximity", "attribute", F.desc("exact"), "id").offset((page - 1) * limit).limit(limit)


def paged(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One page of rows with `total` and `pages` (at least 1) beside them; the totals are one row."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long"))
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit).join(F.broadcast(total))
