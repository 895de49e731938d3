"""Queries of metadata extraction, cleaning and text measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as tx, unicode as un
from quire.operators import catalog as ct, fidelity as fd, stats as st
from quire.queries import query
from quire.sources.tables import table

#: Our own keywords of the thirteen topics, in the order that breaks ties.
KEYWORDS = {
    "ia": ["aprendizaje supervisado", "red neuronal", "neural network", "machine learning", "modelo de lenguaje", "language model", "clasificador"],
    "programacion": ["compilador", "compiler", "variable global", "programación", "servidor web", "debugger", "código"],
    "matematicas": ["teorema", "theorem", "integral", "matriz inversa", "número primo", "vector space"],
    "fisica": ["gravedad", "kinetic", "campo magnético", "fotón", "electromagn", "péndulo"],
    "economia": ["inflación", "inflation", "mercado de trabajo", "banco emisor", "déficit fiscal", "exchange rate"],
    "biologia": ["célula", "membrane", "fotosíntesis", "depredador", "gen recesivo", "chromosome"],
    "historia": ["imperio", "dynast", "tratado de paz", "cronista", "batalla naval", "revolt"],
    "psicologia": ["terapia", "therap", "memoria episódica", "sesgo cognitivo", "anxiety", "temperament"],
    "filosofia": ["dialéctica", "silogismo", "syllogism", "imperativo moral", "sceptic", "virtud"],
    "literatura": ["narrador", "soneto", "metáfora", "stanza", "novela", "rhyme"],
    "quimica": ["catalizador", "polímero", "molécula", "reagent", "valenc", "distill"],
    "medicina": ["vacuna", "vaccine", "tumor", "diagnóstico", "surgeon", "fiebre"],
    "derecho": ["contrato", "tribunal", "norma penal", "verdict", "creditor", "cláusula"],
}
CODE = [r"\bdef \w+\(", r"\breturn\b", r"\bselect \w+", r"const \w+ ="]

_VARIANT = """(SELECT *, ascii(substr(file_hash, 1, 1)) % 4 AS k FROM (SELECT * REPLACE (coalesce(title, '') AS title, coalesce(author, '') AS author) FROM conversions))"""
_FILENAME = """CASE k WHEN 0 THEN title || ' 2nd Edition (1999) [' || author || '].pdf' WHEN 1 THEN title || ' - ' || author || '.epub' WHEN 2 THEN title || '___' || author || '.pdf' ELSE title || ' by ' || author || ' [2003].txt' END"""


def _named(spark, d):
    """Conversions with an empty title or author for a missing one."""
    return table(spark, d, "conversions").withColumns({"title": F.coalesce("title", F.lit("")), "author": F.coalesce("author", F.lit(""))})


def _variants(spark, d):
    c = _named(spark, d)
    k = F.ascii(F.substring("file_hash", 1, 1)) % 4
    name = F.when(k == 0, F.concat("title", F.lit(" 2nd Edition (1999) ["), "author", F.lit("].pdf"))).when(k == 1, F.concat("title", F.lit(" - "), "author", F.lit(".epub"))).when(k == 2, F.concat("title", F.lit("___"), "author", F.lit(".pdf"))).otherwise(F.concat("title", F.lit(" by "), "author", F.lit(" [2003].txt")))
    return c.select("file_hash", "markdown", name.alias("filename"))


VAR = f"(SELECT file_hash, markdown, {_FILENAME} AS filename FROM {_VARIANT})"
STEM = r"regexp_replace(filename, '(.)\.[^.]*$', '\1')"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""SELECT file_hash, concat_ws('-', coalesce(CASE WHEN trim(isbn) <> '' THEN isbn END, substr(file_hash, 1, 8)), lower(substr(coalesce(CASE WHEN trim(language) <> '' THEN language END, 'und'), 1, 5)),
    substr(regexp_replace(lower(coalesce(CASE WHEN trim(topic) <> '' THEN topic END, 'general')), '[^a-z0-9]', '', 'g'), 1, 15)) AS made FROM conversions""")
def book_id(spark, d):
    c = table(spark, d, "conversions")
    return c.select("file_hash", tx.book_id(F.col("isbn"), F.col("file_hash"), F.col("language"), F.col("topic")).alias("made"))


def _valid(s: str) -> str:
    d = f"CASE WHEN substr({s}, i, 1) = 'X' THEN 10 ELSE coalesce(TRY_CAST(substr({s}, i, 1) AS INT), 0) END"
    return f"""(coalesce((regexp_full_match({s}, '[0-9]{{13}}') AND list_sum(list_transform(range(1, 14), lambda i: ({d}) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0)
      OR (regexp_full_match({s}, '[0-9]{{9}}[0-9X]') AND list_sum(list_transform(range(1, 11), lambda i: ({d}) * (11 - i))) % 11 = 0), false))"""


@query(f"SELECT file_hash, {_valid('s')} AS valid FROM (SELECT file_hash, regexp_replace(upper(isbn), '[^0-9X]', '', 'g') AS s FROM conversions)")
def isbn_valid(spark, d):
    return table(spark, d, "conversions").select("file_hash", tx.isbn_valid(F.col("isbn")).alias("valid"))


@query(f"""WITH c AS (SELECT file_hash, o, regexp_replace(upper(m), '[^0-9X]', '', 'g') AS s FROM (SELECT file_hash, unnest(regexp_extract_all(substr(markdown, 1, 5000), '{tx.ISBN}')) AS m, generate_subscripts(regexp_extract_all(substr(markdown, 1, 5000), '{tx.ISBN}'), 1) AS o FROM conversions)),
    v AS (SELECT file_hash, min(o) AS o FROM c WHERE {_valid('s')} GROUP BY 1) SELECT f.file_hash, c.s AS isbn FROM conversions f LEFT JOIN v ON v.file_hash = f.file_hash LEFT JOIN c ON c.file_hash = v.file_hash AND c.o = v.o""")
def isbn_extract(spark, d):
    return table(spark, d, "conversions").select("file_hash", tx.isbn_extract(F.col("markdown")).alias("isbn"))


@query(rf"""SELECT file_hash, coalesce(CASE WHEN trim(t) <> '' THEN t END, CASE WHEN trim(s) <> '' THEN s END, 'Unknown') AS title FROM (SELECT file_hash, s, trim(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(s, '(?i)(?:[0-9]{{1,2}}(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)[ _-]*edition', '', 'g'), '[(\[](?:19|20)[0-9]{{2}}[)\]]', '', 'g'), '\[[^\]]*\]', '', 'g'), '[-_]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t
    FROM (SELECT file_hash, {STEM} AS s FROM {VAR}))""")
def clean_title(spark, d):
    return _variants(spark, d).select("file_hash", tx.clean_title(F.col("filename")).alias("title"))


def _year(src: str, p: str) -> str:
    return f"TRY_CAST(regexp_extract({src}, '{p}', 1) AS INT)"


_Y2, _Y3 = _year("substr(markdown, 1, 3000)", r"(?i)(?:copyright|published|publicado|edition|edición|©)[^0-9\n]{0,20}((?:19|20)[0-9]{2})"), _year("substr(markdown, 1, 3000)", r"(?m)^#[^\n0-9]*((?:19|20)[0-9]{2})")


@query(rf"""SELECT file_hash, coalesce({_year('filename', r'[(\[]((?:19|20)[0-9]{2})[)\]]')}, CASE WHEN {_Y2} BETWEEN 1900 AND 2025 THEN {_Y2} END, CASE WHEN {_Y3} BETWEEN 1900 AND 2025 THEN {_Y3} END) AS year FROM {VAR}""")
def year_extract(spark, d):
    return _variants(spark, d).select("file_hash", tx.year_extract(F.col("filename"), F.col("markdown")).alias("year"))


def _g(src: str, p: str) -> str:
    return f"nullif(regexp_extract({src}, '{p}', 1), '')"


@query(rf"""SELECT file_hash, coalesce({_g('s', '(?i)([0-9]{1,2}(?:st|nd|rd|th)) edition')}, {_g('s', '(?i)edition ([0-9]{1,2})')}, {_g('s', '(?i)(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth) edition')}, {_g('s', '(?i)([0-9]{1,2})[ªa] ed')}) AS edition
    FROM (SELECT file_hash, concat_ws(' ', filename, substr(markdown, 1, 2000)) AS s FROM conversions)""")
def edition_extract(spark, d):
    return table(spark, d, "conversions").select("file_hash", tx.edition_extract(F.col("filename"), F.col("markdown")).alias("edition"))


_SKIP = ", ".join(f"'{w}'" for w in tx.SKIP)
_SITES = ", ".join(f"'{w}'" for w in tx.SITES)


def _named_sql(x: str) -> str:
    w = rf"list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda w: regexp_matches(w, '^\p{{L}}'))"
    return rf"(len({w}) BETWEEN 1 AND 5 AND len(list_filter({w}, lambda w: NOT regexp_matches(w, '^\p{{Lu}}') OR lower(w) IN ({_SKIP}))) = 0)"


def _author_sql(src: str) -> str:
    """file_hash and author from (file_hash, raw), the stem of a file name."""
    last = "trim(replace(string_split(raw, '___')[-1], '_', ' '))"
    return rf"""(SELECT file_hash, coalesce(CASE WHEN length(sign) > 4 AND len(list_filter(regexp_split_to_array(sign, '\s+'), lambda w: lower(w) IN ({_SITES}, {_SKIP}))) = 0 THEN sign END,
        CASE WHEN contains(s, ' - ') THEN list_filter(list_transform(list_reverse(string_split(s, ' - ')), lambda x: trim(x)), lambda x: {_named_sql('x')})[1] END,
        CASE WHEN contains(raw, '___') AND {_named_sql(last)} THEN array_to_string(list_filter(regexp_split_to_array({last}, '\s+'), lambda w: regexp_matches(w, '^\p{{L}}')), ' ') END, CASE WHEN length(by_) > 4 THEN by_ END) AS author
        FROM (SELECT *, trim(regexp_extract(raw, '\[([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,4}})\]\s*$', 1)) AS sign, trim(regexp_extract(s, '(?i)\bby\s+([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]+){{0,4}})\s*[\[\s]', 1)) AS by_ FROM (SELECT *, replace(raw, '_', ' ') AS s FROM {src})))"""


@query(f"SELECT * FROM {_author_sql(f'(SELECT file_hash, {STEM} AS raw FROM {VAR})')}")
def author_from_name(spark, d):
    return _variants(spark, d).select("file_hash", tx.author_from_name(F.col("filename")).alias("author"))


_TW = ", ".join(f"'{w}'" for w in [*tx.SKIP, *tx.TITLE_WORDS])
_BW = ", ".join(f"'{w}'" for w in tx.BETWEEN)
_SHAPE = rf"""len(w) BETWEEN 2 AND 5 AND x <> upper(x) AND len(list_filter(w, lambda v: lower(v) NOT IN ({_BW}))) > 0 AND len(list_filter(w, lambda v: NOT regexp_matches(v, '^[A-Za-z][a-zA-Z'']*\.?$'))) = 0
    AND len(list_filter(w, lambda v: lower(v) NOT IN ({_BW}) AND (NOT regexp_matches(v, '^[A-Z]') OR regexp_matches(v, '^[A-Z]{{3,}}\.?$')))) = 0 AND len(list_filter(w, lambda v: lower(v) IN ({_TW}))) = 0 AND len(list_filter(w, lambda v: lower(v) NOT IN ({_BW}) AND length(v) > 3)) > 0"""


@query(rf"""WITH l AS (SELECT file_hash, i, trim(regexp_split_to_array(trim(ls[i]), ',\s*[A-Z]{{2,}}')[1]) AS x FROM (SELECT file_hash, string_split(substr(string_split(markdown, E'
---')[1], 1, 600), chr(10)) AS ls FROM conversions), unnest(range(1, len(ls) + 1)) AS u(i) WHERE trim(ls[i]) <> ''),
    n AS (SELECT file_hash, arg_max(x, i) AS author FROM (SELECT *, regexp_split_to_array(x, '\s+') AS w FROM l) WHERE {_SHAPE} GROUP BY 1) SELECT file_hash, n.author FROM conversions LEFT JOIN n USING (file_hash)""")
def author_from_cover(spark, d):
    """The cover scan alone: the texts of this table name no author in a line of their own."""
    c = table(spark, d, "conversions")
    return c.select("file_hash", tx.author_from_text(F.col("markdown")).alias("author"))


def _topic_sql(title: str = "title", text: str = "markdown") -> str:
    h = f"repeat(lower(coalesce({title}, '')) || ' ', 8) || lower(substr({text}, 1, 200)) || ' ' || lower(substr({text}, 501, 6200))"
    n = lambda w: f"CAST((length(h) - length(replace(h, '{w}', ''))) / {len(w)} AS INT)"
    cols = []
    for i, (t, ws) in enumerate(KEYWORDS.items()):
        s = " + ".join(n(w) for w in ws)
        if t == "programacion":
            s += " + least(80, 5 * (" + " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in CODE) + "))"
        cols.append(f"struct_pack(score := {s}, rank := {-i}, topic := '{t}')")
    return f"(SELECT *, list_max([{', '.join(cols)}]) AS best FROM (SELECT *, {h} AS h FROM conversions))"


_TOPIC = "CASE WHEN best.score >= 4 THEN best.topic ELSE 'general' END"


def _topic():
    return tx.classify_topic(F.col("title"), F.col("markdown"), KEYWORDS, code_topic="programacion", code_patterns=CODE)


@query(f"SELECT file_hash, {_TOPIC} AS topic FROM {_topic_sql()}")
def classify_topic(spark, d):
    return table(spark, d, "conversions").select("file_hash", _topic().alias("topic"))


@query(f"SELECT count(*) AS checked, count(*) FILTER (WHERE t IS DISTINCT FROM topic) AS updated FROM (SELECT topic, {_TOPIC} AS t FROM {_topic_sql()})")
def reclassify(spark, d):
    c = ct.reclassify(table(spark, d, "conversions"), _topic())
    return c.agg(F.count("*").alias("checked"), F.count_if("updated").alias("updated"))


@query(f"""SELECT file_hash, t AS topic, CASE WHEN t IS DISTINCT FROM topic THEN concat_ws('-', coalesce(CASE WHEN trim(isbn) <> '' THEN isbn END, substr(file_hash, 1, 8)), lower(substr(coalesce(CASE WHEN trim(language) <> '' THEN language END, 'und'), 1, 5)), substr(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), 1, 15)) ELSE book_id END AS book_id, t IS DISTINCT FROM topic AS updated FROM (SELECT *, {_TOPIC} AS t FROM {_topic_sql()})""")
def reclassified(spark, d):
    return ct.reclassify(table(spark, d, "conversions"), _topic()).select("file_hash", "topic", "book_id", "updated")


_AGAIN = rf"(SELECT file_hash, regexp_replace(CASE WHEN k < 2 THEN title || '.pdf' ELSE title || '___' || author || '.pdf' END, '(.)\.[^.]*$', '\1') AS raw FROM {_VARIANT})"


@query(f"""SELECT file_hash, CASE WHEN a.author IS NOT NULL THEN a.author WHEN c.author = upper(c.author) OR contains(c.author, chr(10)) THEN NULL ELSE c.author END AS author FROM {_author_sql(_AGAIN)} a JOIN conversions c USING (file_hash)""")
def reextract(spark, d):
    c = _named(spark, d)
    k = F.ascii(F.substring("file_hash", 1, 1)) % 4
    found = tx.author_from_name(F.when(k < 2, F.concat("title", F.lit(".pdf"))).otherwise(F.concat("title", F.lit("___"), "author", F.lit(".pdf"))))
    own = table(spark, d, "conversions").select("file_hash", F.col("author").alias("stored"))
    shouted = (F.col("stored") == F.upper("stored")) | F.contains("stored", F.lit("\n"))
    return c.select("file_hash", found.alias("found")).join(own, "file_hash").select("file_hash", F.when(F.col("found").isNotNull(), F.col("found")).when(shouted, F.lit(None)).otherwise(F.col("stored")).alias("author"))


@query(r"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(list_filter(regexp_split_to_array(text, '[\s\x{85}\x{A0}\x{2028}\x{2029}\x0B]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents")
def doc_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), tx.word_count(F.col("text")).alias("words"))


_LANGS = ", ".join(f"struct_pack(n := len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))), rank := {-i}, lang := '{k}')" for i, (k, ws) in enumerate(tx.STOP_WORDS.items()))


@query(f"SELECT doc_id, CASE WHEN best.n > 0 THEN best.lang ELSE 'und' END AS lang FROM (SELECT doc_id, list_max([{_LANGS}]) AS best FROM (SELECT doc_id, regexp_split_to_array(lower(substr(text, 1, 3000)), '[^\\p{{L}}]+') AS w FROM documents))".replace("\\\\", "\\"))
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.lang_detect(F.col("text")).alias("lang"))


# cleaning: results are compared by the digest of the cleaned text, with a sign of whether it changed

def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _translate_sql(x: str) -> str:
    for k, v in tx.LIGATURES.items():
        x = f"replace({x}, '{k}', '{v}')"
    return f"translate({x}, {_lit(''.join(tx.ONE_TO_ONE) + tx.DROPPED.replace(chr(0), ''))}, {_lit(''.join(tx.ONE_TO_ONE.values()))})"


DEHYPHEN = r"regexp_replace({x}, '(\p{L})-[ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g')"
CHARSET = r"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{AD}\x{600}-\x{605}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFB}\x{FFFE}\x{FFFF}]', '', 'g')"
WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' +\n', '\n', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')".replace("{x}", "{x}")
WS = WS.replace(r"' +\n', '\n'", r"' +\n', E'\n'").replace("{3,}", "{{3,}}")


def _changed(sql: str, src: str = "markdown") -> str:
    return f"SELECT file_hash, md5(t) AS digest, t <> {src} AS changed FROM (SELECT *, {sql} AS t FROM conversions)"


def _digest(spark, d, f):
    c = table(spark, d, "conversions")
    t = f(F.col("markdown"))
    return c.select("file_hash", F.md5(t).alias("digest"), (t != F.col("markdown")).alias("changed"))


query(_changed(_translate_sql("markdown")), "char_translate")(lambda s, d: _digest(s, d, tx.char_translate))
query(_changed(DEHYPHEN.replace("{x}", "markdown")), "dehyphenate")(lambda s, d: _digest(s, d, tx.dehyphenate))
query(_changed(CHARSET.replace("{x}", "markdown")), "charset_sanitize")(lambda s, d: _digest(s, d, tx.charset_sanitize))
query(_changed(WS.format(x="markdown")), "ws_collapse")(lambda s, d: _digest(s, d, tx.ws_collapse))


def _scripts_sql(x: str) -> str:
    # braces round runs and wide signs, a bare mark before the others, then the signs as they are on the line
    for chars, plain, mark in ((tx.SUPER, tx.SUPER_PLAIN, "^"), (tx.SUB, tx.SUB_PLAIN, "_")):
        wide = "".join(c for c in tx.WIDE if c in chars)
        x = f"regexp_replace({x}, '([{chars}]{{2,}}|[{wide}])', '{mark}{{\\1}}', 'g')"
        x = f"regexp_replace({x}, '([^{{{chars}]|^)([{chars}])([^{chars}}}]|$)', '\\1{mark}\\2\\3', 'g')"
        x = f"translate({x}, '{chars}', '{plain}')"
    return x


@query(f"SELECT file_hash, {_scripts_sql('s')} AS t FROM (SELECT file_hash, coalesce(title, '') || ' x² + y₁₀ = H₂O, 10⁻³ m, aⁿ⁺¹ cᵢⱼ kₙ r⁺' AS s FROM conversions)")
def scripts_digits(spark, d):
    return table(spark, d, "conversions").select("file_hash", tx.scripts(F.concat(F.coalesce("title", F.lit("")), F.lit(" x² + y₁₀ = H₂O, 10⁻³ m, aⁿ⁺¹ cᵢⱼ kₙ r⁺"))).alias("t"))


@query("SELECT file_hash, md5(t) AS digest, t <> markdown AS changed FROM (SELECT *, " + WS.format(x=CHARSET.replace("{x}", DEHYPHEN.replace("{x}", _translate_sql(_scripts_sql(_translate_sql("markdown"))))).replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}") + " AS t FROM conversions)")
def normalize_text(spark, d):
    return _digest(spark, d, lambda c: un.normalize(c, plain=True))


_SUSPECT = r"[\p{Cc}\p{Cf}\p{Co}]"


@query(f"SELECT 'U+' || lpad(upper(to_hex(unicode(ch))), 4, '0') AS code, count(*) AS n, count(DISTINCT file_hash) AS files FROM (SELECT file_hash, unnest(regexp_extract_all(markdown, '{_SUSPECT}')) AS ch FROM conversions) WHERE ch NOT IN (chr(9), chr(10), chr(13)) GROUP BY ch")
def charset_audit(spark, d):
    return st.charset_audit(table(spark, d, "conversions"), "file_hash", "markdown")


@query(f"SELECT doc_id, NOT regexp_matches(regexp_replace(text, '[\\t\\n\\r]', '', 'g'), '{_SUSPECT}') AS clean FROM documents")
def charset_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", st.charset_clean(F.col("text")).alias("clean"))


_INJECT = "(SELECT file_hash, coalesce(title, '') || CASE ascii(substr(file_hash, 1, 1)) % 5 WHEN 0 THEN ' \\frac{a' WHEN 1 THEN ' }b{' WHEN 2 THEN ' x^' WHEN 3 THEN ' {{{{y' ELSE ' {z}_' END AS s FROM conversions)"


def _injected(spark, d):
    k = F.ascii(F.substring("file_hash", 1, 1)) % 5
    tail = F.when(k == 0, " \\frac{a").when(k == 1, " }b{").when(k == 2, " x^").when(k == 3, " {{{{y").otherwise(" {z}_")
    return table(spark, d, "conversions").select("file_hash", F.concat(F.coalesce("title", F.lit("")), tail).alias("s"))


def _brace(x: str) -> str:
    cs = f"string_split(regexp_replace({x}, '\\\\[{{}}]|[^{{}}]', '', 'g'), '')"
    return f"list_reduce(list_prepend(struct_pack(d := 0, b := false, c := ''), list_transform({cs}, lambda c: struct_pack(d := 0, b := false, c := c))), lambda a, y: struct_pack(d := CASE WHEN y.c = '{{' THEN a.d + 1 WHEN y.c = '}}' AND a.d > 0 THEN a.d - 1 ELSE a.d END, b := a.b OR (y.c = '}}' AND a.d = 0), c := ''))"


@query(f"SELECT file_hash, b.d AS depth, b.b AS bad FROM (SELECT file_hash, {_brace('s')} AS b FROM {_INJECT})")
def brace_balance(spark, d):
    b = tx.brace_state(F.col("s"))
    return _injected(spark, d).select("file_hash", b["depth"].alias("depth"), b["bad"].alias("bad"))


@query(f"SELECT file_hash, CASE WHEN NOT b.b AND b.d BETWEEN 1 AND 3 THEN t || repeat('}}', b.d) ELSE t END AS line FROM (SELECT file_hash, t, {_brace('t')} AS b FROM (SELECT file_hash, regexp_replace(s, '[\\^_]+\\s*$', '') AS t FROM {_INJECT}))")
def repair_md(spark, d):
    return _injected(spark, d).select("file_hash", tx.repair_markdown(F.col("s")).alias("line"))


@query(r"""SELECT file_hash, CAST(len(regexp_extract_all(markdown, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) AS INT) AS controls, CAST(len(regexp_extract_all(markdown, '[ﬀ-ﬆ]')) AS INT) AS ligatures, CAST(len(regexp_extract_all(markdown, '-[ ]*\n')) AS INT) AS hyphens,
    CAST(len(regexp_extract_all(markdown, '(?m)^#{1,6} ')) AS INT) AS headings, CAST(len(regexp_extract_all(markdown, '\^\{')) AS INT) AS supers, CAST(len(regexp_extract_all(markdown, '_\{')) AS INT) AS subs, CAST(len(regexp_extract_all(markdown, '[Α-ω]')) AS INT) AS greek FROM conversions""")
def text_qa(spark, d):
    n = lambda p: F.regexp_count("markdown", F.lit(p))
    return table(spark, d, "conversions").select("file_hash", n(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]").alias("controls"), n("[ﬀ-ﬆ]").alias("ligatures"), n(r"-[ ]*\n").alias("hyphens"), n(r"(?m)^#{1,6} ").alias("headings"), n(r"\^\{").alias("supers"), n(r"_\{").alias("subs"), n("[Α-ω]").alias("greek"))


_OK = r"""(SELECT len(st.o) = 0 AND st.ok FROM (SELECT list_reduce(list_prepend(struct_pack(t := '', o := CAST([] AS VARCHAR[]), ok := true), list_transform(regexp_extract_all(f, '(\\(?:begin|end)\{[^}]*\}|\\left|\\right|\\.|[{}])'), lambda t: struct_pack(t := t, o := CAST([] AS VARCHAR[]), ok := true))),
    lambda a, y: struct_pack(t := '', o := CASE WHEN y.t = '{' THEN list_append(a.o, '}') WHEN y.t = '\left' THEN list_append(a.o, '\right') WHEN starts_with(y.t, '\begin{') THEN list_append(a.o, '\end{' || substr(y.t, 8)) WHEN (y.t = '}' OR y.t = '\right' OR starts_with(y.t, '\end{')) AND a.o[-1] = y.t THEN a.o[:-2] ELSE a.o END,
    ok := a.ok AND (NOT (y.t = '}' OR y.t = '\right' OR starts_with(y.t, '\end{')) OR coalesce(a.o[-1] = y.t, false)))) AS st))"""


@query(rf"""WITH l AS (SELECT file_hash, unnest(string_split(markdown, chr(10))) AS line FROM conversions), m AS (SELECT file_hash, row_number() OVER () AS id, line, {_brace('line')} AS b FROM l WHERE regexp_matches(line, '{fd.MARKED}')),
    f AS (SELECT id, count(*) FILTER (WHERE NOT ok) AS w FROM (SELECT id, {_OK} AS ok FROM (SELECT id, unnest(regexp_extract_all(line, '\$\$?(.+?)\$\$?', 1)) AS f FROM m)) GROUP BY id),
    s AS (SELECT file_hash, b.b OR b.d <> 0 AS u, NOT b.b AND b.d BETWEEN 1 AND 3 AS r, regexp_matches(line, '{fd.ORPHAN}') AS o, coalesce(w, 0) AS w FROM m LEFT JOIN f USING (id)),
    g AS (SELECT file_hash, count(*) AS total, count(*) FILTER (WHERE NOT u AND NOT o AND w = 0) AS valid, count(*) FILTER (WHERE r) AS repaired, count(*) FILTER (WHERE u) AS unbalanced, count(*) FILTER (WHERE o) AS orphan, CAST(sum(w) AS BIGINT) AS latex_errors FROM s GROUP BY 1)
    SELECT file_hash, coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, coalesce(repaired, 0) AS repaired, coalesce(unbalanced, 0) AS unbalanced, coalesce(orphan, 0) AS orphan, coalesce(latex_errors, 0) AS latex_errors, round(CASE WHEN coalesce(total, 0) = 0 THEN 1 ELSE valid / total END, 6) AS validity FROM conversions LEFT JOIN g USING (file_hash)""")
def math_validate(spark, d):
    return fd.validate(table(spark, d, "conversions"), "file_hash", "markdown").withColumn("validity", F.round("validity", 6))


@query(rf"WITH m AS (SELECT file_hash, unnest(regexp_extract_all(markdown, '\$[^$\n]+\$')) AS f FROM conversions) SELECT file_hash, count(*) AS formulas, count(*) FILTER (WHERE NOT {_OK}) AS broken FROM m GROUP BY 1")
def latex_check(spark, d):
    m = table(spark, d, "conversions").select("file_hash", F.explode(F.regexp_extract_all("markdown", F.lit(r"\$[^$\n]+\$"), F.lit(0))).alias("f"))
    return m.groupBy("file_hash").agg(F.count("*").alias("formulas"), F.count_if(~fd.delimiters_ok(F.col("f"))).alias("broken"))


_SIGNS = "list_distinct(list_filter(string_split({x}, ''), lambda c: NOT regexp_full_match(c, '[\\s\\x0B]*')))".replace("\\\\", "\\")
_FID = rf"""(SELECT doc_id, text AS src, regexp_replace(regexp_replace(text, '[aeiou]([a-z]) ', 'x_\1 ', 'g'), '[0-9]', '', 'g') AS md, n_chars % 40 AS small, CASE WHEN n_chars % 3 > 0 THEN n_chars % 3 / 2.0 END AS val FROM documents)"""
_FID_PARTS = rf"""SELECT *, {_SIGNS.format(x='src')} AS a, {_SIGNS.format(x='md')} AS b, len(regexp_extract_all(md, '[{fd.BROKEN.replace(chr(92) + "x00", "")}]')) AS bad, len(regexp_extract_all(md, '[\^_](?:\{{[^}}]+\}}|[A-Za-z0-9])')) AS sc FROM {_FID}"""


@query(rf"""SELECT doc_id, round(gc, 6) AS glyph_coverage, round(mo, 6) AS mojibake_score, round(sy, 6) AS symbol_preservation, st AS structure_score, round(su, 6) AS super_sub_detection, va AS equation_validity, round(0.20 * gc + 0.15 * mo + 0.20 * sy + 0.10 * st + 0.25 * su + 0.10 * va, 6) AS overall FROM (
    SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 1 END AS gc, CASE WHEN length(md) > 0 THEN greatest(0.0, 1 - bad / greatest(1.0, length(md) / 100)) ELSE 1 END AS mo,
    CASE WHEN len(list_filter(a, lambda c: contains('{fd.TRACKED}', c))) > 0 THEN len(list_intersect(list_filter(a, lambda c: contains('{fd.TRACKED}', c)), b)) / len(list_filter(a, lambda c: contains('{fd.TRACKED}', c))) ELSE 1 END AS sy,
    CASE WHEN length(src) > 200 AND NOT regexp_matches(md, '(?m)^#{{1,6}}\s+') THEN 0.5 ELSE 1.0 END AS st, CASE WHEN small >= 3 THEN least(1.0, sc / greatest(1, small // 8)) ELSE 1 END AS su, coalesce(val, 1.0) AS va FROM ({_FID_PARTS}))""")
def fidelity(spark, d):
    """Texts beside a worsened copy of themselves: digits lost, some letters lowered."""
    n = F.col("n_chars")
    md = F.regexp_replace(F.regexp_replace("text", "[aeiou]([a-z]) ", "x_$1 "), "[0-9]", "")
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("src"), md.alias("md"), (n % 40).alias("small"), F.when(n % 3 > 0, n % 3 / 2.0).alias("val"))
    f = fd.fidelity(F.col("src"), F.col("md"), F.col("small"), F.col("val"))
    return t.select("doc_id", *[F.round(c, 6).alias(k) for k, c in f.items()])


_EQ = "[['alpha', 'α'], ['sum', '∑'], ['x'], ['12']]"


@query(rf"""SELECT file_hash, round(a, 6) AS text_words, round(b, 6) AS math_symbols, round(c, 6) AS mojibake_free, round(e, 6) AS super_sub, round(f, 6) AS structure, round(g, 6) AS equation_tokens, round(0.15 * a + 0.20 * b + 0.15 * c + 0.30 * e + 0.10 * f + 0.10 * g, 6) AS overall FROM (
    SELECT file_hash, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(markdown, x))) / len(w) ELSE 1 END AS a, len(list_filter(['∑', '≤', '='], lambda x: contains(markdown, x))) / 3 AS b, greatest(0.0, 1 - len(list_filter(['Ã', 'ﬁ', '¬'], lambda x: contains(markdown, x))) / 3) AS c,
    (CAST(regexp_matches(markdown, 'de[\s{{]*la') AS INT) + CAST(regexp_matches(markdown, '\^[\s{{]*2') AS INT)) / 2 AS e, greatest(least(1.0, len(list_filter(string_split(markdown, chr(10)), lambda x: starts_with(trim(x), '#'))) / len(h)), len(list_filter(h, lambda x: contains(markdown, x))) / len(h)) AS f,
    len(list_filter({_EQ}, lambda t: len(list_filter(t, lambda x: contains(markdown, x))) > 0)) / 4 AS g FROM (SELECT file_hash, markdown, list_filter(string_split(coalesce(title, ''), ' '), lambda x: x <> '') AS w, [coalesce(title, 'x'), coalesce(author, 'y')] AS h FROM conversions))""")
def truth_score(spark, d):
    """Conversions against what their title and author let expect, and a few signs and formulas."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    c = table(spark, d, "conversions")
    w = F.filter(F.split(F.coalesce("title", F.lit("")), " "), lambda x: x != "")
    follows = F.array(F.struct(F.lit("de").alias("context"), F.lit("la").alias("next")), F.struct(F.lit("^").alias("context"), F.lit("2").alias("next")))
    t = fd.truth(F.col("markdown"), w, arr("∑", "≤", "="), arr("Ã", "ﬁ", "¬"), follows, F.array(F.coalesce("title", F.lit("x")), F.coalesce("author", F.lit("y"))), F.array(arr("alpha", "α"), arr("sum", "∑"), arr("x"), arr("12")))
    return c.select("file_hash", *[F.round(v, 6).alias(k) for k, v in t.items()])


_CHARS = "SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE lang = '{}'"


def _chars(spark, d, lang):
    return table(spark, d, "documents").where(F.col("lang") == lang).select(F.explode(st.chars(F.col("text"))).alias("ch")).distinct()


query(f"{_CHARS.format('es')} INTERSECT {_CHARS.format('de')}", "char_intersect")(lambda s, d: _chars(s, d, "es").intersect(_chars(s, d, "de")))
query(f"{_CHARS.format('es')} EXCEPT {_CHARS.format('de')}", "char_except")(lambda s, d: _chars(s, d, "es").subtract(_chars(s, d, "de")))


_PAGES = "(SELECT doc_id, i AS page, substr(text, CAST(i * 300 + 1 AS BIGINT), 300) AS body FROM documents, unnest(range(0, CAST(ceil(length(text) / 300.0) AS BIGINT))) AS u(i))"


def _pages(spark, d):
    n = F.ceil(F.length("text") / 300.0).cast("int")
    t = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    return t.select("doc_id", F.col("page").cast("long").alias("page"), F.substr(F.col("text"), F.col("page") * 300 + 1, F.lit(300)).alias("body"))


@query(f"SELECT doc_id, md5(string_agg(body, chr(10) || '---' || chr(10) ORDER BY page)) AS digest, count(*) AS pages FROM {_PAGES} GROUP BY doc_id")
def page_reassembly(spark, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n---\n")
    return _pages(spark, d).groupBy("doc_id").agg(F.md5(joined).alias("digest"), F.count("*").alias("pages"))


@query(rf"SELECT doc_id, round(avg(CASE WHEN length(regexp_replace(body, '\s', '', 'g')) < 30 THEN 1.0 ELSE 0.0 END), 6) AS empty_share, avg(CASE WHEN length(regexp_replace(body, '\s', '', 'g')) < 30 THEN 1.0 ELSE 0.0 END) > 0.4 AS scanned FROM {_PAGES} WHERE page < 10 GROUP BY doc_id")
def scan_detect(spark, d):
    e = F.avg(F.when(F.length(F.regexp_replace("body", r"\s", "")) < 30, 1.0).otherwise(0.0))
    return _pages(spark, d).where("page < 10").groupBy("doc_id").agg(F.round(e, 6).alias("empty_share"), (e > 0.4).alias("scanned"))


@query(f"SELECT file_hash, round(least(1.0, (2.0 * len(regexp_extract_all(markdown, '[{st.MATH}$^_\\\\]'))) / greatest(1, length(markdown))), 6) AS density FROM conversions")
def stem_density_text(spark, d):
    n = F.size(F.regexp_extract_all("markdown", F.lit(f"[{st.MATH}$^_\\\\]"), F.lit(0)))
    return table(spark, d, "conversions").select("file_hash", F.round(F.least(F.lit(1.0), (2.0 * n) / F.greatest(F.lit(1), F.length("markdown"))), 6).alias("density"))


@query("SELECT coalesce(lang, 'none') AS family, ch, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ALL")
def char_profile(spark, d):
    return st.char_profile(table(spark, d, "documents"), F.coalesce("lang", F.lit("none")), "text")


@query("""WITH g AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, sum(n) OVER (ORDER BY n DESC, k) AS cum, row_number() OVER (ORDER BY n DESC, k) AS i, sum(n) OVER () AS t FROM g)
    SELECT CAST(s AS DOUBLE) AS share, min(i) AS groups FROM r, (VALUES (0.5), (0.8), (0.95), (0.99)) v(s) WHERE cum >= s * t GROUP BY s""")
def zipf_coverage(spark, d):
    return st.zipf_coverage(table(spark, d, "lineitem").select("l_partkey", F.lit(1).alias("one")), "l_partkey", "one", [0.5, 0.8, 0.95, 0.99])


@query(r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]{4,}')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 50")
def top_words(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(50)


@query(r"""SELECT doc_id, least(4, (i - 1) // greatest(1, len(ws) // 5)) AS page, count(*) AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i) GROUP BY ALL""")
def word_chunks(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws"))
    p = t.select("doc_id", F.greatest(F.lit(1), F.floor(F.size("ws") / 5)).alias("k"), F.posexplode("ws").alias("i", "w"))
    return p.groupBy("doc_id", F.least(F.lit(4), F.floor(F.col("i") / F.col("k"))).cast("long").alias("page")).agg(F.count("*").alias("words"))


@query("SELECT file_hash, md5(translate(replace(replace(replace(replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'), '½', '1⁄2'), '™', 'TM'), 'ϕ', 'φ'), 'ªº²³¹ℓ' || chr(160), 'ao231l ')) AS digest FROM (SELECT file_hash, regexp_replace(markdown, '[^\\x00-\\x7Eáéíóúüñçãõâêôàèßäöª²³¹º…ﬁﬂ½\\x{A0}А-яёЁ—–«»“”‘’¿¡·]', '', 'g') || ' ℓϕ½ﬁﬂ' AS t FROM conversions)")
def nfkc(spark, d):
    """The compatibility form of all texts, of the characters whose form is said in SQL."""
    keep = F.regexp_replace("markdown", r"[^\x00-\x7Eáéíóúüñçãõâêôàèßäöª²³¹º…ﬁﬂ½\x{A0}А-яёЁ—–«»“”‘’¿¡·]", "")
    return table(spark, d, "conversions").select("file_hash", F.md5(un.nfkc(F.concat(keep, F.lit(" ℓϕ½ﬁﬂ")))).alias("digest"))


_GARBLED = {"á": "Ã¡", "é": "Ã©", "ó": "Ã³", "ú": "Ãº", "ñ": "Ã±", "ü": "Ã¼", "ö": "Ã¶", "ä": "Ã¤", "ç": "Ã§", "ã": "Ã£", "ê": "Ãª", "ß": "ÃŸ"}


@query("SELECT id, t AS out FROM (SELECT DISTINCT id, regexp_replace(title, '[^\\x20-\\x7E" + "".join(_GARBLED) + "]', '', 'g') AS t FROM book_results)")
def mojibake(spark, d):
    """Titles garbled by a wrong decoding and repaired."""
    t = F.regexp_replace("title", r"[^\x20-\x7E" + "".join(_GARBLED) + "]", "")
    g = t
    for k, v in _GARBLED.items():
        g = F.replace(g, F.lit(k), F.lit(v))
    return table(spark, d, "book_results").select("id", un.mojibake(g).alias("out")).distinct()
