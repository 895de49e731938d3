"""Queries of search, request handling and search-engine query strings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import dork as dk, text as tx
from quire.operators import search as se, stats as st
from quire.queries import query
from quire.session import shared_dir
from quire.sources import files as fs
from quire.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "book_results").drop("tags")


def _hits(spark, d):
    return table(spark, d, "book_results").dropDuplicates(["id"])


_UNIQ = "(SELECT DISTINCT * EXCLUDE (tags) FROM book_results)"


@query(f"SELECT DISTINCT id, title FROM {_UNIQ} WHERE filetype = 'pdf' AND language = 'es'")
def index_filter(spark, d):
    return _docs(spark, d).where(se.index_filter("pdf", "es")).select("id", "title").distinct()


@query(f"SELECT id, title, score, (SELECT count(*) FROM {_UNIQ}) AS total, CAST(ceil((SELECT count(*) FROM {_UNIQ}) / 20.0) AS BIGINT) AS pages FROM {_UNIQ} ORDER BY score DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def search_page(spark, d):
    return se.paged(_hits(spark, d).select("id", "title", "score"), [F.desc_nulls_last("score"), F.col("id")], 3, 20)


_ARR = "list_filter(regexp_split_to_array(lower(strip_accents(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')".replace("\\\\", "\\")
_HAVE = [(r, a) for r, a in enumerate(se.ATTRIBUTES) if a != "publisher"]
_TOKENS = "(" + " UNION ALL ".join(f"SELECT id, {r} AS attribute, unnest({_ARR.format('array_to_string(tags, chr(32))' if a == 'tags' else a)}) AS token, generate_subscripts({_ARR.format('array_to_string(tags, chr(32))' if a == 'tags' else a)}, 1) AS pos FROM (SELECT DISTINCT * FROM book_results)" for r, a in _HAVE) + ")"


def _match_sql(q: str) -> str:
    words = se.query_words(q)
    met = " UNION ALL ".join(
        f"SELECT *, {i} AS word, token = '{w}' AS same, CASE WHEN token = '{w}'" + (f" OR starts_with(token, '{w}')" if i == len(words) - 1 else "") + f" THEN 0 ELSE levenshtein(token, '{w}') END AS typos FROM t WHERE token = '{w}'" + (f" OR starts_with(token, '{w}')" if i == len(words) - 1 else "") + f" OR levenshtein(token, '{w}') <= {se.budget(w)}"
        for i, w in enumerate(words)
    )
    near = " + ".join(f"least({se.FAR}, coalesce((SELECT min(abs(a.pos - b.pos)) FROM m a JOIN m b ON a.id = b.id AND a.attribute = b.attribute AND a.pos <> b.pos WHERE a.id = p.id AND a.word = {i} AND b.word = {i + 1}), {se.FAR}))" for i in range(len(words) - 1)) or "0"
    return f"""(WITH t AS (SELECT * FROM {_TOKENS}), m AS ({met}), p AS (SELECT id, word, min(typos) AS typos, min(attribute) FILTER (WHERE typos = b) AS attribute, max(CAST(same AS INT)) AS exact FROM (SELECT *, min(typos) OVER (PARTITION BY id, word) AS b FROM m) GROUP BY id, word),
        g AS (SELECT id, CAST(count(*) AS INT) AS words, CAST(sum(typos) AS INT) AS typos, CAST(min(attribute) AS INT) AS attribute, CAST(sum(exact) AS INT) AS exact FROM p GROUP BY id) SELECT id, words, typos, CAST({near} AS INT) AS proximity, attribute, exact FROM g p)"""


_RANK = "ORDER BY words DESC, typos, proximity, attribute, exact DESC, id"


@query(f"SELECT * FROM {_match_sql('lecciones sobre la')} WHERE words = 3 {_RANK} LIMIT 50")
def search_rank(spark, d):
    return se.search(_hits(spark, d), "lecciones sobre la", limit=50)


@query(f"SELECT * FROM {_match_sql('leciones introductoin')}")
def search_typo(spark, d):
    return se.matches(_hits(spark, d), "leciones introductoin")


@query(f"SELECT s.id, title FROM {_match_sql('introduction zzzz')} s JOIN (SELECT DISTINCT id, title FROM book_results) USING (id) {_RANK} LIMIT 5")
def search_suggest(spark, d):
    hits = se.search(_hits(spark, d), "introduction zzzz", limit=5, strategy="last")
    return hits.join(_hits(spark, d).select(*se.SUGGESTED), "id").select(*se.SUGGESTED)


@query(f"SELECT DISTINCT id, 'local' AS origin FROM {_UNIQ} WHERE title ILIKE '%handbook%' UNION ALL SELECT file_hash, 'catalogue' FROM conversions WHERE title ILIKE '%handbook%' AND NOT EXISTS (SELECT 1 FROM {_UNIQ} b WHERE b.title ILIKE '%handbook%' AND replace(b.isbn, '-', '') = replace(conversions.isbn, '-', ''))")
def search_fallback(spark, d):
    local = _docs(spark, d).where(F.col("title").ilike("%handbook%"))
    k = F.replace("isbn", F.lit("-"), F.lit("")).alias("k")
    rest = table(spark, d, "conversions").where(F.col("title").ilike("%handbook%")).select("file_hash", k).join(local.select(k), "k", "left_anti")
    return local.select("id", F.lit("local").alias("origin")).distinct().union(rest.select("file_hash", F.lit("catalogue").alias("origin")))


@query(f"SELECT id, tag1, n FROM (SELECT DISTINCT id, tags[1] AS tag1, CAST(least(5, len(tags)) AS INT) AS n FROM book_results WHERE tags IS NOT NULL)")
def external_map(spark, d):
    t = table(spark, d, "book_results").where("tags is not null")
    return t.select("id", F.try_element_at("tags", F.lit(1)).alias("tag1"), F.size(F.slice("tags", 1, 5)).alias("n")).distinct()


@query(f"SELECT DISTINCT id, CAST(coalesce(CAST(filetype <> 'any' AS INT), 0) + coalesce(CAST(language <> 'any' AS INT), 0) + CAST(year IS NOT NULL AS INT) + CAST(coalesce(source_site, '') <> '' AS INT) AS INT) AS active FROM {_UNIQ}")
def filter_count(spark, d):
    b = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return _docs(spark, d).select("id", (b(F.col("filetype") != "any") + b(F.col("language") != "any") + b(F.col("year").isNotNull()) + b(F.coalesce("source_site", F.lit("")) != "")).alias("active")).distinct()


_W = ["sobre", "introduction", "la"]
_MARKED = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{N}}])(introduction|sobre|la)', '\\1<mark>\\2</mark>', 'gi')".replace("\\\\", "\\")


@query(f"""SELECT DISTINCT id, {_MARKED.format('title')} AS title, {_MARKED.format('author')} AS author, {_MARKED.format("array_to_string(list_slice(ws, s, s + 11), ' ')")} AS description FROM (SELECT *, greatest(1, least(CASE WHEN at_ > 0 THEN at_ ELSE 1 END - 6, len(ws) - 11)) AS s FROM (SELECT id, title, author, string_split(description, ' ') AS ws,
    CASE WHEN regexp_matches(description, '(?i)(^|[^\\p{{L}}\\p{{N}}])(?:sobre|introduction|la)') THEN len(string_split(regexp_extract(description, '(?is)^(.*?)(?:^|[^\\p{{L}}\\p{{N}}])(?:sobre|introduction|la)', 1) || CASE WHEN regexp_matches(description, '(?i)^(?:sobre|introduction|la)') THEN '' ELSE regexp_extract(description, '(?is)^.*?([^\\p{{L}}\\p{{N}}])(?:sobre|introduction|la)', 1) END, ' ')) ELSE 0 END AS at_ FROM {_UNIQ}))""".replace("\\\\", "\\"))
def highlight(spark, d):
    """Words of a query marked in what is shown, the description cropped to a few tokens about the first hit."""
    t = _docs(spark, d)
    return t.select("id", tx.highlight(F.col("title"), _W).alias("title"), tx.highlight(F.col("author"), _W).alias("author"), tx.highlight(tx.crop(F.col("description"), _W, 12), _W).alias("description")).distinct()


@query(f"""SELECT DISTINCT id, replace(replace(replace(replace(replace('<b>' || title || ' & <mark>x</mark>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>') AS title FROM {_UNIQ}""")
def escape_highlight(spark, d):
    return _docs(spark, d).select("id", tx.escape_marked(F.concat(F.lit("<b>"), "title", F.lit(" & <mark>x</mark>"))).alias("title")).distinct()


@query(r"SELECT DISTINCT log_id, trim(regexp_replace(regexp_replace(consulta, '[^\p{L}\p{N}_\s.,:;''\x22()-]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM search_log WHERE consulta IS NOT NULL")
def sanitize_query(spark, d):
    return table(spark, d, "search_log").where("consulta is not null").select("log_id", tx.sanitize_query(F.col("consulta")).alias("q")).distinct()


@query("SELECT DISTINCT id, translate('<' || title || '>|^`', '<>{}|\\^`', '') AS title FROM " + _UNIQ)
def sanitize_doc(spark, d):
    return _docs(spark, d).select("id", tx.sanitize_doc(F.concat(F.lit("<"), "title", F.lit(">|^`"))).alias("title")).distinct()


@query("SELECT DISTINCT id, CASE WHEN length(s) IN (10, 13, 17) THEN s END AS isbn FROM (SELECT id, regexp_replace(isbn, '[^0-9Xx-]', '', 'g') AS s FROM book_results)")
def isbn_param(spark, d):
    return _docs(spark, d).select("id", tx.isbn_param(F.col("isbn")).alias("isbn")).distinct()


@query(r"SELECT DISTINCT id, coalesce(nullif(trim(substr(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100)), ''), 'book') AS name FROM book_results")
def safe_filename(spark, d):
    return _docs(spark, d).select("id", tx.safe_filename(F.col("title")).alias("name")).distinct()


@query("SELECT DISTINCT uid, substr(sha256(uid), 1, 16) AS h FROM search_log WHERE uid IS NOT NULL")
def key_hash(spark, d):
    return table(spark, d, "search_log").where("uid is not null").select("uid", F.substring(F.sha2("uid", 256), 1, 16).alias("h")).distinct()


@query("""SELECT log_id, bad FROM (SELECT DISTINCT log_id, concat_ws(',', CASE WHEN consulta IS NULL OR length(consulta) NOT BETWEEN 2 AND 512 THEN 'query' END, CASE WHEN log_id % 120 NOT BETWEEN 1 AND 100 THEN 'page' END, CASE WHEN source_site IS NULL THEN 'site' END) AS bad FROM search_log)""")
def request_validate(spark, d):
    q = F.col("consulta").isNull() | ~F.length("consulta").between(2, 512)
    bad = F.concat_ws(",", F.when(q, "query"), F.when(~(F.col("log_id") % 120).between(1, 100), "page"), F.when(F.col("source_site").isNull(), "site"))
    return table(spark, d, "search_log").select("log_id", bad.alias("bad")).distinct()


@query("""SELECT DISTINCT log_id, coalesce(list_filter(list_transform(string_split('10.0.0.' || (log_id % 250) || ', 172.16.0.1 , ' || coalesce(uid, ''), ','), lambda x: trim(x)), lambda x: x <> '')[-2], 'peer') AS ip FROM search_log""")
def client_ip(spark, d):
    fwd = F.concat(F.lit("10.0.0."), (F.col("log_id") % 250).cast("string"), F.lit(", 172.16.0.1 , "), F.coalesce("uid", F.lit("")))
    return table(spark, d, "search_log").select("log_id", tx.client_ip(fwd, F.lit("peer"), 2).alias("ip")).distinct()


@query("SELECT DISTINCT id, CASE WHEN dork_url LIKE 'https://%' OR dork_url LIKE 'http://%' THEN dork_url ELSE '' END AS url FROM book_results WHERE dork_url IS NOT NULL")
def safe_url(spark, d):
    return _docs(spark, d).where("dork_url is not null").select("id", tx.safe_url(F.col("dork_url")).alias("url")).distinct()


@query(r"SELECT DISTINCT id, regexp_full_match(id, '[\p{L}\p{N}_-]{1,80}') AS ok FROM book_results")
def identifier_ok(spark, d):
    return _docs(spark, d).select("id", F.col("id").rlike(r"^[\p{L}\p{N}_-]{1,80}$").alias("ok")).distinct()


def _san(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\-.'']', ' ', 'g'), '\s+', ' ', 'g'))"


def _ph(x: str) -> str:
    return f"'\"' || {_san(x)} || '\"'"


_AU = "CASE WHEN trim(author) <> '' THEN {} END"
_LAST = f"CASE WHEN trim(author) <> '' AND length(string_split({_san('author')}, ' ')[-1]) > 2 THEN string_split({_san('author')}, ' ')[-1] END"
_FT = "CASE WHEN trim(filetype) <> '' AND filetype <> 'any' THEN filetype END"
_ST = "CASE WHEN trim(source_site) <> '' AND source_site <> 'any' THEN source_site END"
_DIRECT = f"concat_ws(' ', {_ph('title')}, {_LAST}, 'filetype:' || coalesce({_FT}, 'pdf'))"


def _byft(ft: str, site: str) -> str:
    return f"concat_ws(' ', 'intitle:' || {_ph('title')}, CASE WHEN {ft} = 'pdf' THEN 'filetype:pdf' WHEN {ft} IS NOT NULL THEN '(filetype:' || {ft} || ' OR filetype:pdf)' ELSE '(filetype:pdf OR filetype:epub OR filetype:mobi OR filetype:djvu)' END, coalesce('site:' || {site}, '{' '.join('-site:' + s for s in dk.SHOPS[:2])}'), '-inurl:login -inurl:register')"


_ISBN = f"concat_ws(' ', {_ph('isbn')}, 'intext:isbn (filetype:pdf OR filetype:epub)')"
_URL = "'" + dk.BASE + "?q=' || replace(url_encode(q), '%20', '+') || '&safe=active'"
_SITE_FT = _byft("CASE WHEN trim(filetype) <> '' THEN nullif(filetype, 'any') ELSE 'pdf' END", _ST).replace("trim(filetype) <> '' THEN nullif(filetype, 'any') ELSE 'pdf'", "filetype IS NOT NULL AND trim(filetype) <> '' THEN nullif(filetype, 'any') ELSE 'pdf'")


@query(f"""SELECT id, q AS raw_query, {_URL} AS google_url FROM (SELECT DISTINCT id, CASE WHEN trim(isbn) <> '' THEN {_ISBN} WHEN {_ST} IS NOT NULL THEN {_SITE_FT}
    WHEN {_FT} <> 'pdf' THEN {_byft(_FT, 'NULL')} ELSE {_DIRECT} END AS q FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM {_UNIQ}))""")
def dork_primary(spark, d):
    t = _docs(spark, d).withColumn("title", F.coalesce("title", F.lit("")))
    p = dk.primary(*[F.col(c) for c in ("title", "author", "isbn", "filetype", "source_site")])
    return t.select("id", p.alias("p")).select("id", "p.raw_query", "p.google_url").distinct()


_ALL = [
    ("direct_pdf", _DIRECT),
    ("filetype", _byft(_FT, _ST)),
    ("open_library", f"concat_ws(' ', 'intitle:' || {_ph('title')}, {_AU.format(_ph('author'))}, '(" + " OR ".join(f"site:{s}" for s in dk.LIBRARIES) + ")')"),
    ("index_of", f"""concat_ws(' ', '(intitle:"index of" OR intitle:"parent directory")', {_ph('title')}, coalesce('".' || {_FT} || '"', '(".pdf" OR ".epub" OR ".mobi")'), '-inurl:login')"""),
    ("google_books", f"concat_ws(' ', 'site:books.google.com', 'intitle:' || {_ph('title')}, {_AU.format(chr(39) + 'intext:' + chr(39) + ' || ' + _ph('author'))}, 'inurl:/books/edition/')"),
    ("academic", f"concat_ws(' ', {_ph('title')}, {_AU.format(_ph('author'))}, '(" + " OR ".join(dk.ACADEMIC) + ")', '(filetype:pdf OR filetype:epub)')"),
    ("download_page", f"concat_ws(' ', 'intitle:' || {_ph('title')}, {_AU.format(_ph('author'))}, 'inurl:(download OR pdf OR ebook OR book)', '(filetype:pdf OR filetype:epub OR filetype:mobi)', '{' '.join('-site:' + s for s in dk.SHOPS)}')"),
]


@query(f"SELECT id, strategy, q AS raw_query, {_URL} AS google_url FROM (" + " UNION ALL ".join(f"SELECT DISTINCT id, '{n}' AS strategy, {s} AS q FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM {_UNIQ})" for n, s in _ALL) + f" UNION ALL SELECT DISTINCT id, 'isbn', {_ISBN} FROM {_UNIQ} WHERE trim(isbn) <> '')")
def dork_all(spark, d):
    t = _docs(spark, d).withColumn("title", F.coalesce("title", F.lit(""))).distinct()
    p = dk.every(*[F.col(c) for c in ("title", "author", "isbn", "filetype", "source_site")])
    return t.select("id", F.explode(p).alias("p")).select("id", "p.strategy", "p.raw_query", "p.google_url")


_CLIENT = "'https://www.google.com/search?q=' || replace(replace(replace(replace(replace(replace(replace(replace(url_encode(q), '+', '%20'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~'), '%2B', '%2B')"


@query(rf"""SELECT id, {_CLIENT} AS url, {_CLIENT.replace('url_encode(q)', 'url_encode(r)')} AS alternative FROM (SELECT DISTINCT id, '"' || replace(coalesce(title, ''), '"', '') || '" filetype:' || ft || coalesce(' ' || last_, '') AS q, '"' || replace(coalesce(title, ''), '"', '') || '" ' || ft || coalesce(' ' || last_, '') AS r FROM (SELECT id, title, coalesce(CASE WHEN filetype <> '' AND filetype <> 'any' THEN filetype END, 'pdf') AS ft, CASE WHEN length(w[-1]) > 2 THEN w[-1] END AS last_ FROM (SELECT *, regexp_split_to_array(trim(replace(author, '"', '')), '\s+') AS w FROM {_UNIQ})))""")
def client_links(spark, d):
    t = _docs(spark, d)
    one, two = dk.client(F.col("title"), F.col("author"), F.col("filetype"))
    return t.select("id", one.alias("url"), two.alias("alternative")).distinct()


@query("SELECT id, title, language FROM (SELECT DISTINCT * FROM book_results)")
def index_sink(spark, d):
    """The index documents written, parted by language, and read back."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    fs.write_index(_hits(spark, d).select("id", "title", "author", "language"), path)
    return spark.read.schema("id string, title string, author string, language string").parquet(path).select("id", "title", "language")


@query("SELECT source_site, count(DISTINCT log_id) AS n FROM search_log WHERE source_site IS NOT NULL GROUP BY source_site")
def report_sink(spark, d):
    """An inventory written as JSON lines and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    fs.write_report(table(spark, d, "search_log").where("source_site is not null").groupBy("source_site").agg(F.countDistinct("log_id").alias("n")), path)
    return spark.read.schema("source_site string, n long").json(path)


@query()
def weighted_pick(spark, d):
    """Twenty documents drawn in proportion to their length."""
    return st.weighted_pick(table(spark, d, "documents"), "doc_id", "n_chars", 20, 7).select("doc_id", "n_chars")
