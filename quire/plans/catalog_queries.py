"""Queries over the catalogue and its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import text as tx
from quire.operators import catalog as ct, limits as lm, stats as st
from quire.queries import query
from quire.sources import files as fs
from quire.sources.tables import table

ASOF = "2024-06-30 00:00:00"
SHOWN = """coalesce(CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(stem) <> '' THEN stem END, book_id) AS title,
    coalesce(CASE WHEN trim(topic) <> '' THEN topic END, 'general') AS topic"""
CAT = r"(SELECT *, regexp_replace(filename, '(.)\.[^.]*$', '\1') AS stem FROM conversions)"
COLS = f"file_hash, book_id, {SHOWN}, author, year, edition, language, coalesce(download_count, 0) AS download_count, created_at"


def _cat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversions").drop("markdown")


@query(f"""SELECT {COLS}, (SELECT count(*) FROM conversions) AS total FROM {CAT}
    ORDER BY conversions_dc DESC NULLS LAST, created_at DESC NULLS LAST, file_hash LIMIT 20 OFFSET 20""".replace("conversions_dc", "download_count"))
def vault_page(spark, d):
    top = ct.page(_cat(spark, d), 20, 20)
    return top.select(*[c for c in ct.display(top).columns if c not in ("title", "topic", "download_count")], F.coalesce(tx.blank_to_null(F.col("title")), tx.blank_to_null(tx.stem(F.col("filename"))), F.col("book_id")).alias("title"), F.coalesce(tx.blank_to_null(F.col("topic")), F.lit("general")).alias("topic"), F.coalesce("download_count", F.lit(0)).alias("download_count"), "total")


def _filtered(**kw):
    return lambda spark, d: ct.display(_cat(spark, d).where(ct.filters(asof=ASOF, **kw)))


for _n, _kw, _sql in (
    ("topic", {"topic": "historia"}, "topic = 'historia'"),
    ("year", {"year": 1990}, "year = 1990"),
    ("edition", {"edition": "2"}, "edition ILIKE '%2%'"),
    ("edition_na", {"edition": "na"}, "edition IS NULL OR edition = ''"),
    ("period", {"period": "month"}, f"created_at >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY"),
):
    query(f"SELECT {COLS} FROM {CAT} WHERE {_sql}", f"vault_filter_{_n}")(_filtered(**_kw))

query(f"SELECT {COLS} FROM {CAT}", "vault_projection")(lambda spark, d: ct.display(_cat(spark, d)))


@query("""SELECT coalesce(topic, 'null') AS topic, count(*) AS n, count(*) FILTER (WHERE edition IS NULL OR edition = '') AS no_edition, count(*) FILTER (WHERE download_count > 0) AS downloaded FROM conversions GROUP BY ALL""")
def vault_count(spark, d):
    return _cat(spark, d).groupBy(F.coalesce("topic", F.lit("null")).alias("topic")).agg(F.count("*").alias("n"), F.count_if(ct.filters(edition="na")).alias("no_edition"), F.count_if(F.col("download_count") > 0).alias("downloaded"))


@query("""SELECT file_hash, row_number() OVER (ORDER BY coalesce(download_count, 0) DESC, created_at DESC NULLS LAST, file_hash) AS rank,
    CAST(floor(100.0 * coalesce(download_count, 0) / greatest(1, max(coalesce(download_count, 0)) OVER ()) + 0.5) AS BIGINT) AS bar FROM conversions""")
def vault_rank(spark, d):
    c = _cat(spark, d).select("file_hash", "created_at", F.coalesce("download_count", F.lit(0)).alias("dl"))
    most = c.agg(F.greatest(F.lit(1), F.max("dl")).alias("most"))
    r = ct.global_rank(c, [F.desc("dl"), F.desc_nulls_last("created_at"), F.col("file_hash")])
    return r.join(F.broadcast(most)).select("file_hash", F.col("rank").cast("long").alias("rank"), F.floor(100.0 * F.col("dl") / F.col("most") + 0.5).cast("long").alias("bar"))


@query("SELECT DISTINCT year FROM conversions WHERE year BETWEEN 1500 AND 2100")
def year_facet(spark, d):
    return _cat(spark, d).where(F.col("year").between(1500, 2100)).select("year").distinct()


@query("SELECT file_hash, isbn FROM conversions WHERE isbn IS NOT NULL AND isbn <> '' AND (cover_url IS NULL OR cover_url = '')")
def cover_backlog(spark, d):
    return _cat(spark, d).where("isbn is not null and isbn <> '' and (cover_url is null or cover_url = '')").select("file_hash", "isbn")


@query("""SELECT file_hash FROM conversions WHERE contains(lower(strip_accents(concat_ws(chr(10), title, filename, author, isbn, topic, edition, CAST(year AS VARCHAR)))), 'introduccion')""")
def vault_text_filter(spark, d):
    return ct.text_filter(_cat(spark, d), "Introducción", ["title", "filename", "author", "isbn", "topic", "edition", "year"]).select("file_hash")


@query("SELECT book_id, file_hash, title, md5(markdown) AS body FROM conversions WHERE book_id = (SELECT min(book_id) FROM conversions) ORDER BY file_hash LIMIT 1")
def book_by_id(spark, d):
    """The point read of one book: its least hash with the body."""
    c = table(spark, d, "conversions")
    one = c.agg(F.min("book_id")).first()[0]
    return ct.point_read(c.drop("markdown"), c.select("file_hash", "markdown"), book_id=one or "").select("book_id", "file_hash", "title", F.md5("markdown").alias("body"))


@query("SELECT file_hash, title, md5(markdown) AS body FROM conversions WHERE file_hash = (SELECT max(file_hash) FROM conversions)")
def cache_lookup(spark, d):
    """The point read of one content hash with its body."""
    c = table(spark, d, "conversions")
    one = c.agg(F.max("file_hash")).first()[0]
    return ct.point_read(c.drop("markdown"), c.select("file_hash", "markdown"), one or "").select("file_hash", "title", F.md5("markdown").alias("body"))


@query("SELECT count(*) AS files, CAST(sum(strlen(markdown)) AS BIGINT) AS bytes, CAST(sum(file_size) AS BIGINT) AS file_bytes FROM conversions")
def store_stats(spark, d):
    return table(spark, d, "conversions").agg(F.count("*").alias("files"), F.sum(F.octet_length("markdown").cast("long")).alias("bytes"), F.sum("file_size").alias("file_bytes"))


_KEEP = "file_hash IN (SELECT file_hash FROM conversions WHERE substr(file_hash, 1, 1) < 'c')"


@query(f"SELECT file_hash, book_id FROM conversions WHERE {_KEEP}")
def blob_semi(spark, d):
    c = _cat(spark, d)
    bodies = table(spark, d, "conversions").where(F.substring("file_hash", 1, 1) < "c").select("file_hash")
    return c.join(bodies, "file_hash", "left_semi").select("file_hash", "book_id")


@query(f"SELECT file_hash, book_id FROM conversions WHERE NOT {_KEEP}")
def blob_anti(spark, d):
    c = _cat(spark, d)
    bodies = table(spark, d, "conversions").where(F.substring("file_hash", 1, 1) < "c").select("file_hash")
    return c.join(bodies, "file_hash", "left_anti").select("file_hash", "book_id")


@query("""WITH inc AS (SELECT doc_id, sha256(text) AS h FROM documents), known AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'boveda')
    SELECT doc_id, known.h IS NOT NULL AS hit FROM inc LEFT JOIN known USING (h)""")
def cache_split(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    known = t.where("source = 'boveda'").select("h").distinct().withColumn("hit", F.lit(True))
    return t.join(known, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


_NEW = """SELECT sha256(file_hash) AS file_hash, book_id, title || ' (new)' AS title, CAST(0 AS BIGINT) AS download_count, created_at FROM conversions WHERE year < 1970
    UNION ALL SELECT file_hash, book_id, title || ' (again)', CAST(0 AS BIGINT), created_at FROM conversions WHERE year >= 2000"""


def _incoming(spark, d):
    c = _cat(spark, d)
    cols = lambda h, mark: [h.alias("file_hash"), "book_id", F.concat("title", F.lit(mark)).alias("title"), F.lit(0).cast("long").alias("download_count"), "created_at"]
    return c.where("year < 1970").select(*cols(F.sha2("file_hash", 256), " (new)")).union(c.where("year >= 2000").select(*cols(F.col("file_hash"), " (again)")))


@query(f"""WITH n AS ({_NEW}), o AS (SELECT file_hash, book_id, title, download_count, created_at FROM conversions)
    SELECT file_hash, CASE WHEN n.file_hash IS NOT NULL THEN n.book_id ELSE o.book_id END AS book_id, CASE WHEN n.file_hash IS NOT NULL THEN n.title ELSE o.title END AS title,
    coalesce(o.download_count, 0) AS download_count, CASE WHEN n.file_hash IS NOT NULL THEN n.created_at ELSE o.created_at END AS created_at FROM o FULL JOIN n USING (file_hash)""")
def catalog_upsert(spark, d):
    return ct.upsert(_cat(spark, d).select("file_hash", "book_id", "title", "download_count", "created_at"), _incoming(spark, d))


@query("""WITH h AS (SELECT c.book_id, count(*) AS n FROM book_results b JOIN conversions c ON replace(b.isbn, '-', '') = replace(c.isbn, '-', '') GROUP BY 1)
    SELECT file_hash, c.book_id, coalesce(download_count, 0) + coalesce(n, 0) AS download_count FROM conversions c LEFT JOIN h USING (book_id)""")
def download_increment(spark, d):
    plain = lambda: F.replace("isbn", F.lit("-"), F.lit("")).alias("k")
    c = _cat(spark, d)
    hits = table(spark, d, "book_results").where("isbn is not null").select(plain()).join(c.select("book_id", plain()), "k")
    return ct.add_downloads(c.select("file_hash", "book_id", "download_count"), hits)


@query("SELECT file_hash, CASE WHEN year < 1980 THEN greatest(accessed_at, created_at, TIMESTAMP '2023-06-01') ELSE accessed_at END AS accessed_at FROM conversions")
def touch_accessed(spark, d):
    c = _cat(spark, d)
    return ct.touch(c, c.where("year < 1980").select("file_hash"), F.lit("2023-06-01").cast("timestamp_ntz")).select("file_hash", "accessed_at")


@query("""WITH m AS (SELECT DISTINCT ON (k) replace(isbn, '-', '') AS k, 'https://covers.example/' || replace(isbn, '-', '') || '-M.jpg' AS u FROM book_results WHERE isbn IS NOT NULL)
    SELECT file_hash, CASE WHEN isbn <> '' AND (cover_url IS NULL OR cover_url = '') THEN coalesce(u, cover_url) ELSE cover_url END AS cover_url FROM conversions LEFT JOIN m ON replace(isbn, '-', '') = k""")
def cover_backfill(spark, d):
    meta = table(spark, d, "book_results").where("isbn is not null").select(F.replace("isbn", F.lit("-"), F.lit("")).alias("k")).distinct()
    c = _cat(spark, d).select("file_hash", "isbn", "cover_url", F.replace("isbn", F.lit("-"), F.lit("")).alias("k")).join(meta.withColumn("u", F.concat(F.lit("https://covers.example/"), "k", F.lit("-M.jpg"))), "k", "left")
    lacks = (F.col("isbn") != "") & (F.col("cover_url").isNull() | (F.col("cover_url") == ""))
    return c.select("file_hash", F.when(lacks, F.coalesce("u", "cover_url")).otherwise(F.col("cover_url")).alias("cover_url"))


@query("""SELECT file_hash AS id, title, author, CAST(NULL AS DOUBLE) AS score, edition FROM conversions UNION ALL SELECT id, title, author, score, CAST(NULL AS VARCHAR) FROM book_results""")
def schema_evolve(spark, d):
    a = _cat(spark, d).select(F.col("file_hash").alias("id"), "title", "author", "edition")
    return a.unionByName(table(spark, d, "book_results").select("id", "title", "author", "score"), allowMissingColumns=True)


@query("""SELECT file_hash, regexp_extract(lower(filename), '(\\.[^.]+)$', 1) AS ext, regexp_extract(lower(filename), '(\\.[^.]+)$', 1) IN ('.pdf', '.epub', '.mobi', '.azw3', '.djvu', '.txt') AS accepted,
    row_number() OVER (PARTITION BY book_id ORDER BY created_at, file_hash) <= 5 AS within FROM conversions""".replace("\\\\", "\\"))
def ext_gate(spark, d):
    ext = F.regexp_extract(F.lower("filename"), r"(\.[^.]+)$", 1)
    c = ct.first_files(_cat(spark, d).select("book_id", "created_at", "file_hash", "filename"), "book_id", ["created_at", "file_hash"], 5)
    return c.select("file_hash", ext.alias("ext"), ext.isin(*fs.SUFFIXES).alias("accepted"), "within")


@query("SELECT file_hash, file_size > 0 AND file_size <= 5000000 AS accepted FROM conversions")
def size_gate(spark, d):
    return _cat(spark, d).select("file_hash", ((F.col("file_size") > 0) & (F.col("file_size") <= 5_000_000)).alias("accepted"))


@query("""SELECT coalesce(engine, 'none') AS engine, count(*) AS total, count(*) FILTER (WHERE coalesce(char_count, 0) > 0) AS success, count(*) FILTER (WHERE accessed_at > created_at) AS cache_hits,
    round(sum(file_size) / 1048576.0, 6) AS mb FROM conversions GROUP BY ALL""")
def batch_summary(spark, d):
    return _cat(spark, d).groupBy(F.coalesce("engine", F.lit("none")).alias("engine")).agg(F.count("*").alias("total"), F.count_if(F.coalesce("char_count", F.lit(0)) > 0).alias("success"), F.count_if(F.col("accessed_at") > F.col("created_at")).alias("cache_hits"), F.round(F.sum("file_size") / 1048576.0, 6).alias("mb"))


@query("""SELECT file_hash, 'converted' AS status FROM conversions WHERE coalesce(char_count, 0) > 0 UNION ALL SELECT file_hash, 'failed' FROM conversions WHERE coalesce(char_count, 0) <= 0""")
def batch_union(spark, d):
    c = _cat(spark, d).withColumn("n", F.coalesce("char_count", F.lit(0)))
    return c.where("n > 0").select("file_hash", F.lit("converted").alias("status")).unionByName(c.where("n <= 0").select("file_hash", F.lit("failed").alias("status")))


@query("""SELECT DISTINCT c.file_hash, b.title AS found_title, b.description FROM conversions c JOIN (SELECT DISTINCT ON (k) replace(isbn, '-', '') AS k, title, substr(description, 1, 800) AS description
    FROM (SELECT DISTINCT isbn, title, description, id FROM book_results WHERE isbn IS NOT NULL) ORDER BY k, id, title NULLS LAST, description NULLS LAST) b ON replace(c.isbn, '-', '') = b.k""")
def isbn_enrich(spark, d):
    b = table(spark, d, "book_results").where("isbn is not null").select(F.replace("isbn", F.lit("-"), F.lit("")).alias("k"), "id", "title", F.substring("description", 1, 800).alias("description"))
    first = b.groupBy("k").agg(F.min(F.struct("id", F.col("title").isNull().alias("t0"), "title", F.col("description").isNull().alias("d0"), "description")).alias("m"))
    return _cat(spark, d).select("file_hash", F.replace("isbn", F.lit("-"), F.lit("")).alias("k")).join(first, "k").select("file_hash", F.col("m.title").alias("found_title"), F.col("m.description").alias("description")).distinct()


@query("""SELECT s.log_id, coalesce(lower(u.plan), 'gratis') AS plan FROM (SELECT DISTINCT log_id, uid FROM search_log) s LEFT JOIN users u USING (uid)""")
def user_plan_join(spark, d):
    s = table(spark, d, "search_log").select("log_id", "uid").distinct()
    return s.join(table(spark, d, "users").select("uid", "plan"), "uid", "left").select("log_id", F.coalesce(F.lower("plan"), F.lit("gratis")).alias("plan"))


# limits

_REQ = "(SELECT DISTINCT log_id, coalesce(uid, '') AS uid, fecha FROM search_log)"


def _requests(spark, d):
    return table(spark, d, "search_log").select("log_id", F.coalesce("uid", F.lit("")).alias("uid"), "fecha").distinct()


@query(f"SELECT log_id, uid, CAST(fecha AS DATE) AS day, CAST(least(3, row_number() OVER w) - least(3, row_number() OVER w - 1) AS BIGINT) AS granted FROM {_REQ} WINDOW w AS (PARTITION BY uid, CAST(fecha AS DATE) ORDER BY fecha, log_id)")
def quota_daily(spark, d):
    r = _requests(spark, d).withColumn("day", F.to_date("fecha")).withColumn("n", F.lit(1).cast("long"))
    return lm.quota(r, ["uid", "day"], ["fecha", "log_id"], "n", 3).select("log_id", "uid", "day", "granted")


@query(f"""SELECT log_id, CAST(least(50, c) - least(50, c - n) AS BIGINT) AS granted FROM (SELECT log_id, log_id % 5 + 1 AS n, sum(log_id % 5 + 1) OVER (PARTITION BY uid ORDER BY fecha, log_id ROWS UNBOUNDED PRECEDING) AS c FROM {_REQ})""")
def quota_lifetime(spark, d):
    r = _requests(spark, d).withColumn("n", (F.col("log_id") % 5 + 1).cast("long"))
    return lm.quota(r, ["uid"], ["fecha", "log_id"], "n", 50).select("log_id", "granted")


@query("SELECT CAST(fecha AS DATE) AS day, count(DISTINCT log_id) AS searches, count(DISTINCT uid) AS users FROM search_log GROUP BY ALL")
def daily_counts(spark, d):
    return table(spark, d, "search_log").groupBy(F.to_date("fecha").alias("day")).agg(F.countDistinct("log_id").alias("searches"), F.countDistinct("uid").alias("users"))


BUCKET_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) / 3600.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts) / 3600.0, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, s, CAST(4 AS DOUBLE) AS t0 FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, e.s, least(4.0, CASE WHEN f.t0 >= 1 THEN f.t0 - 1 ELSE f.t0 END + greatest(0.0, e.s - f.s) * 0.125) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS event, t0 >= 1 AS allowed, CASE WHEN t0 >= 1 THEN 0 ELSE CAST(floor((1 - t0) / 0.125) AS BIGINT) + 1 END AS wait_s FROM f"""


@query(BUCKET_SQL)
def token_bucket(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("s"))
    return lm.token_bucket(e, "user_id", "event_id", "s", capacity=4.0, rate=0.125)


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return st.latency(table(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_p95_index(spark, d):
    return st.p95_by_index(table(spark, d, "events"), "event_type", "value")


@query("""SELECT role, lvl, lvl >= 2 AS may FROM (SELECT role, CASE lower(trim(role)) WHEN 'superadmin' THEN 4 WHEN 'admin' THEN 3 WHEN 'billing' THEN 2 WHEN 'support' THEN 1 ELSE 0 END AS lvl FROM (SELECT DISTINCT role FROM users))""")
def role_levels(spark, d):
    lvl = ct.role_level(F.col("role"))
    return table(spark, d, "users").select("role").distinct().select("role", lvl.alias("lvl"), (lvl >= 2).alias("may"))


@query("""SELECT uid, CASE WHEN length(uid) % 3 = 0 OR role IS NULL THEN 'plan=' || coalesce(plan, '-') ELSE 'plan=' || coalesce(plan, '-') || ',role=' || role END AS claims FROM users""")
def role_claims(spark, d):
    """The role set as a claim beside the others, or cleared for some."""
    u = table(spark, d, "users")
    own = F.create_map(F.lit("plan"), F.coalesce("plan", F.lit("-")), F.lit("role"), F.lit("old"))
    c = ct.set_claim(own, "role", F.when(F.length("uid") % 3 != 0, F.col("role")))
    return u.select("uid", F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("claims"))


@query("""SELECT u.uid, u.email, coalesce(u.phone_number, '') AS phone, coalesce(s.searches, 0) AS searches, s.last_search, coalesce(u.conversiones, 0) AS conversiones FROM users u LEFT JOIN (SELECT uid, count(DISTINCT log_id) AS searches, max(fecha) AS last_search FROM search_log GROUP BY uid) s USING (uid)""")
def user_view(spark, d):
    u = table(spark, d, "users")
    s = table(spark, d, "search_log").where("uid is not null").groupBy("uid").agg(F.countDistinct("log_id").alias("searches"), F.max("fecha").alias("last_search"))
    return u.join(s, "uid", "left").select("uid", "email", F.coalesce("phone_number", F.lit("")).alias("phone"), F.coalesce("searches", F.lit(0)).alias("searches"), "last_search", F.coalesce("conversiones", F.lit(0)).alias("conversiones"))


@query("""WITH c AS (SELECT uid, max('mail' || log_id % 7) FILTER (WHERE log_id % 3 = 0) AS email, max(log_id % 90) AS conversiones FROM search_log WHERE uid IS NOT NULL GROUP BY uid) SELECT uid, coalesce(c.email, u.email) AS email, coalesce(c.conversiones, u.conversiones) AS conversiones FROM users u FULL JOIN c USING (uid)""")
def user_merge(spark, d):
    i = F.col("log_id")
    ch = table(spark, d, "search_log").select("uid", F.when(i % 3 == 0, F.concat(F.lit("mail"), (i % 7).cast("string"))).alias("email"), (i % 90).alias("conversiones"))
    return ct.merge_fields(table(spark, d, "users").select("uid", "email", "conversiones"), ch)


@query(f"""WITH p AS (SELECT uid, min(lower(trim(plan))) AS plan FROM users WHERE uid IS NOT NULL GROUP BY uid), r AS (SELECT log_id, r.uid, fecha, plan, CASE plan WHEN 'basic' THEN 50 WHEN 'pro' THEN 200 ELSE 5 END AS top, CASE WHEN plan IN ('basic', 'pro') THEN CAST(fecha AS DATE) END AS day, log_id % 30 + 1 AS n FROM (SELECT DISTINCT log_id, uid, fecha FROM search_log) r LEFT JOIN p USING (uid))
    SELECT log_id, plan, CAST(least(top, c) - least(top, c - n) AS BIGINT) AS granted FROM (SELECT *, sum(n) OVER (PARTITION BY uid, day ORDER BY fecha, log_id ROWS UNBOUNDED PRECEDING) AS c FROM r)""")
def quota_by_plan(spark, d):
    r = table(spark, d, "search_log").select("log_id", "uid", "fecha").distinct().withColumn("n", F.col("log_id") % 30 + 1)
    return lm.plan_quota(r, table(spark, d, "users"), "uid", "fecha", "log_id", "n").select("log_id", "plan", "granted")


@query("""SELECT uid, CASE WHEN n > 100 THEN 'pro' ELSE plan END AS plan, plan AS previous FROM users LEFT JOIN (SELECT uid, count(*) AS n FROM search_log WHERE uid IS NOT NULL GROUP BY uid) USING (uid)""")
def plan_update(spark, d):
    n = table(spark, d, "search_log").where("uid is not null").groupBy("uid").count()
    return table(spark, d, "users").join(n, "uid", "left").select("uid", F.when(F.col("count") > 100, "pro").otherwise(F.col("plan")).alias("plan"), F.col("plan").alias("previous"))


@query("""SELECT log_id, max(recibido_en) AS recibido_en, min(fecha) AS fecha FROM search_log GROUP BY log_id""")
def log_dedup(spark, d):
    return table(spark, d, "search_log").groupBy("log_id").agg(F.max("recibido_en").alias("recibido_en"), F.min("fecha").alias("fecha"))
