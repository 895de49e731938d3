"""Further queries: span look-ups, gaps, telephone numbers, check digits, paths, load stages."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quire.functions import text as tx
from quire.operators import stats as st
from quire.operators.joins import range_join
from quire.queries import query
from quire.sources.tables import table


@query("""WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
    s AS (SELECT doc_id, pos AS a, pos + 3 AS z FROM l WHERE starts_with(line, '- ')) SELECT l.doc_id, l.pos, count(a) AS spans FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.pos >= s.a AND l.pos < s.z GROUP BY ALL""")
def span_join(spark, d):
    lines = st.line_table(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
    spans = lines.where(F.col("line").startswith("- ")).select("doc_id", F.col("pos").alias("a"), (F.col("pos") + 3).alias("z"))
    return range_join(lines.select("doc_id", "pos"), spans, "pos", "a", "z", 8, ["doc_id"], "left").groupBy("doc_id", "pos").agg(F.count("a").alias("spans"))


@query("""SELECT user_id, count(*) FILTER (WHERE gap > 3600) AS breaks, max(gap) AS longest FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id""")
def gap_islands(spark, d):
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    gap = s - F.lag(s).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count_if(F.col("gap") > 3600).alias("breaks"), F.max("gap").alias("longest"))


@query("SELECT source_site, count(DISTINCT log_id) AS searches, round(count(DISTINCT log_id) * 1.0 / (SELECT count(DISTINCT log_id) FROM search_log), 6) AS share FROM search_log GROUP BY source_site")
def site_shares(spark, d):
    s = table(spark, d, "search_log").select("log_id", "source_site").distinct()
    total = s.agg(F.countDistinct("log_id").alias("t"))
    return s.groupBy("source_site").agg(F.countDistinct("log_id").alias("searches")).join(F.broadcast(total)).select("source_site", "searches", F.round(F.col("searches") * 1.0 / F.col("t"), 6).alias("share"))


@query("SELECT uid, regexp_replace('+' || (34 + length(uid)) || ' ', '\\s', '', 'g') || regexp_replace(phone_number, '[^0-9]', '', 'g') AS phone FROM users".replace("\\\\", "\\"))
def phone_norm(spark, d):
    return table(spark, d, "users").select("uid", tx.phone(F.concat(F.lit("+"), (34 + F.length("uid")).cast("string"), F.lit(" ")), F.col("phone_number")).alias("phone"))


@query(r"""SELECT log_id, p, CASE WHEN regexp_matches(p, '^/([^/\\]|$)') AND regexp_extract(p, '^([^?#]*)', 1) IN ('/', '/search.html', '/vault.html') THEN p ELSE '/' END AS next FROM (SELECT DISTINCT log_id, CASE log_id % 6 WHEN 0 THEN '/vault.html?x=' || log_id WHEN 1 THEN '//evil.example/' WHEN 2 THEN '/\evil' WHEN 3 THEN 'https://x.example/search.html' WHEN 4 THEN '/search.html#a' ELSE NULL END AS p FROM search_log)""")
def safe_next(spark, d):
    i = F.col("log_id")
    p = F.when(i % 6 == 0, F.concat(F.lit("/vault.html?x="), i.cast("string"))).when(i % 6 == 1, "//evil.example/").when(i % 6 == 2, "/\\evil").when(i % 6 == 3, "https://x.example/search.html").when(i % 6 == 4, "/search.html#a")
    return table(spark, d, "search_log").select("log_id", p.alias("p")).distinct().select("log_id", "p", tx.safe_path(F.col("p"), ["/", "/search.html", "/vault.html"]).alias("next"))


@query("""SELECT o_orderkey, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(d, i, 1) AS INT) WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN CAST(substr(d, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, i, 1) AS INT) * 2 END)) % 10 = 0 AS ok FROM (SELECT o_orderkey, reverse(CAST(o_orderkey * 7919 + 79927398713 AS VARCHAR)) AS d FROM orders)""")
def luhn(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.luhn((F.col("o_orderkey") * 7919 + 79927398713).cast("string")).alias("ok"))


@query("""SELECT event_type, count(*) AS total, round(count(*) / 60.0, 6) AS rps, round(count(*) FILTER (WHERE status >= 500 OR status IS NULL) / count(*), 6) AS error_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max,
    concat_ws(',', '200=' || count(*) FILTER (WHERE status = 200), '404=' || count(*) FILTER (WHERE status = 404), '503=' || count(*) FILTER (WHERE status = 503)) AS by_status FROM (SELECT event_type, value, CASE WHEN event_id % 10 < 7 THEN 200 WHEN event_id % 10 = 7 THEN 404 WHEN event_id % 10 = 8 THEN 503 END AS status FROM events) GROUP BY event_type""")
def load_stages(spark, d):
    k = F.col("event_id") % 10
    e = table(spark, d, "events").select("event_type", "value", F.when(k < 7, 200).when(k == 7, 404).when(k == 8, 503).alias("status"), F.lit(60.0).alias("s"))
    return st.load_stats(e, "event_type", "value", "status", "s")
