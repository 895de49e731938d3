"""Queries of the glyph and font layer, over documents laid out as glyphs.

No table holds glyphs, so the texts of `documents` are laid out by plain rules, said alike in Spark and in SQL: fonts by
language, sizes by place. The operators see rows of the shape a page reader gives. Geometry that SQL cannot state is
compared on small cases of our own with results worked out by hand (VALUES), and in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import fonts as ft, glyphs as gl
from quire.queries import query
from quire.session import materialize
from quire.sources.tables import table

#: The raw font names by language, of every kind the predicates tell apart; None is the rest.
FONTS = {"ru": "WXYZAB+NovaMathPi-Two", "es": "BCDEFG+CMSY9-Identity-H", "de": "Sym", "fr": "GHIJKL+Delta-Grk", "pt": "STIXTwo-Text-UCS2-H", "it": "HELVET+Plain-Identity-V", "en": "PQRSTU+Open-Book", None: ""}
_FONT = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FONTS.items() if k) + " ELSE '' END"
_KEY = r"regexp_replace(regexp_replace({f}, '^[A-Z]{{6}}\+', ''), '-(Identity-[HV]|UCS2-[HV]|UTF16-[HV])$', '')"
_CHARS = f"(SELECT doc_id, source AS book, {_FONT} AS font, unnest(string_split(text, '')) AS ch FROM documents)"
_BARE = r"regexp_replace(coalesce({f}, ''), '^[^+]*\+', '')"


def _font():
    f = F.lit("")
    for k, v in FONTS.items():
        if k:
            f = F.when(F.col("lang") == k, v).otherwise(f)
    return f


def _glyphs(spark, d):
    """(doc_id, book, font, ch): every character as a glyph, counted within a text before it is shuffled."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("book"), _font().alias("font"), F.explode(F.split("text", "")).alias("ch"))


@query(f"SELECT doc_id, {_KEY.format(f='f')} AS family FROM (SELECT doc_id, {_FONT} AS f FROM documents)")
def font_key(spark, d):
    return table(spark, d, "documents").select("doc_id", gl.font_key(_font()).alias("family"))


def _rx(name: str, p: str) -> str:
    return f"regexp_matches({_BARE.format(f=name)}, '{p}')"


@query(f"SELECT doc_id, {_rx('f', ft.BROKEN_NAMES)} AS broken, {_rx('f', ft.GREEK_NAMES)} AS greek, regexp_matches(f, '{ft.MATH_NAMES}') AS math FROM (SELECT doc_id, {_FONT} AS f FROM documents)")
def font_predicates(spark, d):
    f = _font()
    return table(spark, d, "documents").select("doc_id", ft.name_broken(f).alias("broken"), ft.greek_font(f).alias("greek"), ft.math_font(f).alias("math"))


@query(f"""SELECT font, count(*) FILTER (WHERE {_rx('font', ft.BROKEN_NAMES)} AND ((unicode(ch) BETWEEN 1 AND 8) OR (unicode(ch) BETWEEN 14 AND 27) OR ({_rx('font', ft.GREEK_NAMES)} AND regexp_full_match(ch, '[A-Za-z]')))) AS needed, count(*) AS glyphs FROM {_CHARS} WHERE ch <> '' GROUP BY font""")
def recovery_needed(spark, d):
    g = _glyphs(spark, d).where("ch <> ''").groupBy("font", "ch").count()
    return g.groupBy("font").agg(F.sum(F.when(ft.needs_recovery(F.col("font"), F.col("ch")), F.col("count")).otherwise(0)).alias("needed"), F.sum("count").alias("glyphs"))


_METRICS = f"""(SELECT book, family, count(*) AS glyphs, count(*) FILTER (WHERE unicode(ch) BETWEEN 33 AND 126) AS printable, count(*) FILTER (WHERE regexp_full_match(ch, '[A-Za-z]')) AS letters
    FROM (SELECT book, {_KEY.format(f='font')} AS family, ch FROM {_CHARS} WHERE ch <> '') GROUP BY 1, 2)"""


@query(f"SELECT book, family, glyphs, printable, letters, round(CASE WHEN printable > 0 THEN letters / printable ELSE 0 END, 6) AS alpha_ratio FROM {_METRICS}")
def family_metrics(spark, d):
    return ft.family_metrics(ft.char_counts(_glyphs(spark, d))).withColumn("alpha_ratio", F.round("alpha_ratio", 6))


_META = f"""(SELECT source AS book, {_FONT} AS font, n_chars % 5 AS page, doc_id AS seq, CASE WHEN n_chars % 2 = 0 THEN 'Type0' ELSE 'TrueType' END AS subtype, CASE WHEN n_chars % 3 = 0 THEN 'WinAnsi' WHEN n_chars % 3 = 1 THEN 'Identity-H' ELSE '' END AS encoding, n_chars % 7 > 4 AS has_tounicode FROM documents WHERE lang IS NOT NULL)"""
_FIRST = f"(SELECT book, {_KEY.format(f='font')} AS family, arg_min(subtype, page * 1000000000 + seq) AS subtype, arg_min(encoding, page * 1000000000 + seq) AS encoding, arg_min(has_tounicode, page * 1000000000 + seq) AS has_tounicode FROM {_META} WHERE font <> '' GROUP BY 1, 2)"


def _meta(spark, d):
    n = F.col("n_chars")
    t = table(spark, d, "documents").where("lang is not null")
    m = t.select(F.col("source").alias("book"), _font().alias("font"), (n % 5).alias("page"), F.col("doc_id").alias("seq"), F.when(n % 2 == 0, "Type0").otherwise("TrueType").alias("subtype"), F.when(n % 3 == 0, "WinAnsi").when(n % 3 == 1, "Identity-H").otherwise("").alias("encoding"), (n % 7 > 4).alias("has_tounicode"))
    return ft.first_per_family(m, ["page", "seq"])


@query(f"SELECT * FROM {_FIRST}")
def font_meta_first(spark, d):
    return _meta(spark, d).select("book", "family", "subtype", "encoding", "has_tounicode")


_REPORT = f"""(SELECT *, broken_name OR structural AS suspect FROM (SELECT book, family, glyphs, printable, coalesce(subtype, '') AS subtype, coalesce(encoding, '') AS encoding, coalesce(has_tounicode, false) AS has_tounicode, {_rx('family', ft.BROKEN_NAMES)} AS broken_name, {_rx('family', ft.GREEK_NAMES)} AS greek,
    printable > 0 AND NOT coalesce(has_tounicode, false) AND starts_with(coalesce(subtype, ''), 'Type0') AND contains(coalesce(encoding, ''), 'Identity') AND (CASE WHEN printable > 0 THEN letters / printable ELSE 0 END) < 0.6 AS structural FROM {_METRICS} m LEFT JOIN {_FIRST} f USING (book, family)))"""


def _counts(spark, d):
    """Counted once for all that is told from the counts."""
    return materialize(ft.char_counts(_glyphs(spark, d)), "font-counts")


def _report(spark, d, counts):
    return ft.with_meta(ft.family_metrics(counts), _meta(spark, d))


@query(f"SELECT book, family, subtype, encoding, has_tounicode, broken_name, greek, structural, suspect FROM {_REPORT}")
def family_report(spark, d):
    return _report(spark, d, _counts(spark, d)).select("book", "family", "subtype", "encoding", "has_tounicode", "broken_name", "greek", "structural", "suspect")


_RISK = """CASE WHEN (unicode(ch) < 32 AND unicode(ch) NOT IN (9, 10, 13)) OR unicode(ch) BETWEEN 127 AND 159 OR unicode(ch) BETWEEN 57344 AND 63743 THEN CASE WHEN suspect THEN 'markered' ELSE 'stray' END
    WHEN unicode(ch) BETWEEN 33 AND 126 AND greek AND regexp_full_match(ch, '[A-Za-z]') THEN 'recovered' WHEN unicode(ch) BETWEEN 33 AND 126 AND suspect THEN 'silent' ELSE 'ok' END"""
_RISKS = f"(SELECT book, family, ch, count(*) AS n, any_value({_RISK}) AS risk FROM (SELECT book, {_KEY.format(f='font')} AS family, ch FROM {_CHARS} WHERE ch <> '') JOIN {_REPORT} USING (book, family) GROUP BY book, family, ch)"


def _risks(spark, d):
    c = _counts(spark, d)
    r = _report(spark, d, c)
    return ft.risks(c, r), r


@query(f"SELECT risk, count(*) AS signs, CAST(sum(n) AS BIGINT) AS glyphs FROM {_RISKS} GROUP BY risk")
def glyph_risk(spark, d):
    return _risks(spark, d)[0].groupBy("risk").agg(F.count("*").alias("signs"), F.sum("n").alias("glyphs"))


_FC = f"(SELECT family, CAST(sum(CASE WHEN risk = 'silent' THEN n ELSE 0 END) AS BIGINT) AS silent, CAST(sum(CASE WHEN risk IN ('markered', 'stray') THEN n ELSE 0 END) AS BIGINT) AS control, CAST(sum(n) AS BIGINT) AS total FROM {_RISKS} GROUP BY family)"


@query(f"SELECT * FROM {_FC}")
def font_counts(spark, d):
    return ft.font_counts(_risks(spark, d)[0])


@query(f"SELECT * FROM {_FC} WHERE silent > 0 OR control > 0 ORDER BY silent DESC, family LIMIT 4")
def top_fonts(spark, d):
    return ft.top_fonts(ft.font_counts(_risks(spark, d)[0]), 4)


_MERGED = f"""(SELECT family, bool_or(structural) AS structural, bool_or(broken_name) AS broken_name, bool_and(has_tounicode) AS has_tounicode, coalesce(arg_min(subtype, book) FILTER (WHERE subtype <> ''), '') AS subtype, coalesce(arg_min(encoding, book) FILTER (WHERE subtype <> ''), '') AS encoding,
    array_to_string(list_sort(list(DISTINCT book)), ',') AS books, CAST(sum(glyphs) AS BIGINT) AS glyphs, bool_or(structural) AND NOT bool_or(broken_name) AS blind_spot FROM {_REPORT} GROUP BY family)"""


@query(f"SELECT * FROM {_MERGED}")
def corpus_merge(spark, d):
    return ft.merge_corpus(_report(spark, d, _counts(spark, d)))


@query(f"""SELECT family, ch, CAST(sum(n) AS BIGINT) AS n, arg_max(risk, CASE risk WHEN 'silent' THEN '3' WHEN 'markered' THEN '2' WHEN 'ok' THEN '0' ELSE '1' END || risk) AS risk FROM {_RISKS} GROUP BY family, ch""")
def corpus_risks(spark, d):
    return ft.merge_risks(_risks(spark, d)[0])


@query(f"""WITH m AS (SELECT family, ch, CAST(sum(n) AS BIGINT) AS n, arg_max(risk, CASE risk WHEN 'silent' THEN '3' WHEN 'markered' THEN '2' WHEN 'ok' THEN '0' ELSE '1' END || risk) AS risk FROM {_RISKS} GROUP BY family, ch)
    SELECT family, CAST(sum(CASE WHEN risk = 'silent' THEN n ELSE 0 END) AS BIGINT) AS silent, string_agg('U+' || lpad(upper(to_hex(unicode(ch))), 4, '0') || ':' || n || ':' || risk, ' ' ORDER BY n DESC, ch) FILTER (WHERE n >= 3) AS glyphs
    FROM m WHERE risk IN ('silent', 'markered') AND family IN (SELECT family FROM {_MERGED} WHERE structural OR broken_name) GROUP BY family HAVING count(*) FILTER (WHERE n >= 3) > 0""")
def inventory(spark, d):
    k, r = _risks(spark, d)
    return ft.inventory(ft.merge_risks(k), ft.merge_corpus(r), 3).withColumn("glyphs", F.array_join("glyphs", " "))


# recovery: tables by rule over the signs that occur

_CODES = f"(SELECT {_KEY.format(f='font')} AS family, unicode(ch) AS codepoint, ch, bool_or({_rx('font', ft.BROKEN_NAMES)}) AS broken, count(*) AS n FROM {_CHARS} WHERE ch <> '' GROUP BY 1, 2, 3)"
_NAME = "CASE WHEN codepoint % 5 = 0 THEN 'g' || codepoint WHEN codepoint % 5 < 3 THEN 'name' || chr(97 + codepoint % 26) END"
_RECOVERED = f"""(SELECT family, codepoint, ch, broken, n, name, CASE WHEN codepoint % 11 = 0 THEN 'T' WHEN broken AND ascii(substr(name, 5, 1)) % 2 = 0 THEN 'A' WHEN broken AND ascii(substr(name, 5, 1)) % 3 = 0 THEN 'S' WHEN broken AND codepoint % 13 = 1 THEN 'V'
    WHEN broken THEN '⟦?' || coalesce(name, 'U+' || lpad(upper(to_hex(codepoint)), 4, '0')) || '⟧' ELSE ch END AS out,
    CASE WHEN codepoint % 11 = 0 THEN 'table' WHEN broken AND ascii(substr(name, 5, 1)) % 2 = 0 THEN 'names' WHEN broken AND ascii(substr(name, 5, 1)) % 3 = 0 THEN 'supplement' WHEN broken AND codepoint % 13 = 1 THEN 'visual' WHEN broken AND name IS NULL THEN 'no_name' WHEN broken THEN 'unknown_name' ELSE 'kept' END AS source
    FROM (SELECT *, CASE WHEN nm LIKE 'name%' THEN nm ELSE nm END AS name FROM (SELECT *, {_NAME} AS nm FROM {_CODES})))"""
_RECOVERED = _RECOVERED.replace("ascii(substr(name, 5, 1))", "(CASE WHEN name LIKE 'name%' THEN ascii(substr(name, 5, 1)) ELSE 1 END)")


def _recovered(spark, d):
    g = ft.char_counts(_glyphs(spark, d))
    raw = table(spark, d, "documents").select(_font().alias("font")).distinct().select(gl.font_key(F.col("font")).alias("family"), "font").groupBy("family").agg(F.bool_or(ft.name_broken(F.col("font"))).alias("broken"))
    c = materialize(g.groupBy("family", F.ascii("ch").alias("codepoint"), "ch").agg(F.sum("n").alias("n")).join(raw, "family"), "font-signs")
    codes = c.select("family", "codepoint").distinct()
    k = F.col("codepoint")
    name = F.when(k % 5 == 0, F.concat(F.lit("g"), k.cast("string"))).when(k % 5 < 3, F.concat(F.lit("name"), F.char(97 + k % 26)))
    diff = codes.select("family", "codepoint", name.alias("name")).where("name is not null")
    letters = spark.range(26).select(F.concat(F.lit("name"), F.char(97 + F.col("id"))).alias("name"), (97 + F.col("id")).alias("o"))
    return ft.recover(c, codes.where(k % 11 == 0).withColumn("unicode", F.lit("T")), diff, letters.where("o % 2 = 0").select("name", F.lit("A").alias("unicode")), letters.where("o % 3 = 0").select("name", F.lit("S").alias("unicode")), codes.where(k % 13 == 1).withColumn("unicode", F.lit("V")))


@query(f"SELECT family, codepoint, ch, n, out, source FROM {_RECOVERED}")
def glyph_recover(spark, d):
    """The cascade over every sign of every family."""
    return _recovered(spark, d).select("family", "codepoint", "ch", "n", "out", "source")


@query(f"""SELECT family, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(CASE WHEN source = 'names' THEN n ELSE 0 END) AS BIGINT) AS by_name, CAST(sum(CASE WHEN source = 'supplement' THEN n ELSE 0 END) AS BIGINT) AS by_supplement, CAST(sum(CASE WHEN source = 'no_name' THEN n ELSE 0 END) AS BIGINT) AS no_name, CAST(sum(CASE WHEN source = 'unknown_name' THEN n ELSE 0 END) AS BIGINT) AS unknown_name,
    round(100.0 * sum(CASE WHEN source IN ('names', 'supplement') THEN n ELSE 0 END) / sum(n), 4) AS recovered FROM {_RECOVERED} WHERE broken GROUP BY ROLLUP (family)""")
def recovery_summary(spark, d):
    return ft.recovery_summary(_recovered(spark, d))


_TABLE = [("CMSY9", 97, "α"), ("CMSY9", 101, "ε"), ("Open-Book", 97, "∀"), ("Sym", 223, "β")]


@query(f"SELECT family, ch, coalesce(u, ch) AS unicode, CAST(sum(n) AS BIGINT) AS n FROM {_CODES} LEFT JOIN (VALUES {', '.join(map(str, _TABLE))}) t(f, cp, u) ON f = family AND cp = codepoint GROUP BY ALL")
def glyph_table_join(spark, d):
    t = spark.createDataFrame(_TABLE, "family string, codepoint int, unicode string")
    n = ft.char_counts(_glyphs(spark, d)).groupBy("family", "ch").agg(F.sum("n").alias("n")).withColumn("codepoint", F.ascii("ch"))
    return gl.lookup(n, t).select("family", "ch", "unicode", "n")


@query(f"SELECT family, count(*) AS signs FROM {_CODES} WHERE family IN ('CMSY9', 'Open-Book', 'Sym') GROUP BY family")
def glyph_table_covers(spark, d):
    t = spark.createDataFrame(_TABLE, "family string, codepoint int, unicode string")
    return ft.covers(ft.char_counts(_glyphs(spark, d)).select("family", "ch").distinct(), t).groupBy("family").agg(F.count("*").alias("signs"))


@query(f"SELECT family, ch, CASE WHEN {_rx('family', ft.BROKEN_NAMES)} AND {_rx('family', ft.GREEK_NAMES)} THEN translate(ch, '{ft.LATIN}', '{ft.SYMBOL}') ELSE ch END AS shown FROM (SELECT DISTINCT family, ch FROM {_CODES})")
def greek_letters(spark, d):
    c = ft.char_counts(_glyphs(spark, d)).select("family", "ch").distinct()
    return c.select("family", "ch", ft.greek_letter(F.col("family"), F.col("ch")).alias("shown"))


# spans: a line of 80 characters each 4 parts, pages of 12 lines

_SPANS = f"""(SELECT doc_id AS doc, i // 48 AS page, (i // 4) % 12 AS line, i % 4 AS seq, CASE WHEN i % 7 = 3 THEN 'CMMI8' ELSE {_FONT} END AS font, CASE WHEN i % 5 = 2 THEN 7.0 ELSE 10.0 + doc_id % 3 END AS size, substr(text, CAST(i * 20 + 1 AS BIGINT), 20) AS text
    FROM documents, unnest(range(0, CAST(ceil(length(text) / 20.0) AS BIGINT))) AS u(i))"""


def _spans(spark, d):
    n = F.ceil(F.length("text") / 20.0).cast("int")
    t = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text", _font().alias("f"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    i = F.col("i")
    return t.select(F.col("doc_id").alias("doc"), F.floor(i / 48).alias("page"), (F.floor(i / 4) % 12).alias("line"), (i % 4).alias("seq"), F.when(i % 7 == 3, "CMMI8").otherwise(F.col("f")).alias("font"), F.when(i % 5 == 2, 7.0).otherwise(10.0 + F.col("doc_id") % 3).alias("size"), F.substr(F.col("text"), i * 20 + 1, F.lit(20)).alias("text"))


@query(f"""SELECT doc_id AS doc, coalesce(size, 11.0) AS body FROM documents LEFT JOIN (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY n DESC, pos) AS r FROM (SELECT doc, round(size, 1) AS size, sum(length(text)) AS n, min(page * 1000 + line * 10 + seq) AS pos FROM {_SPANS} WHERE page < 3 GROUP BY 1, 2)) s ON s.doc = doc_id AND r = 1""")
def body_size(spark, d):
    return ft.body_size(_spans(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("doc")))


@query(f"""SELECT doc, CAST(sum(CASE WHEN size < 0.85 * m THEN length(regexp_replace(text, '[\\s\\x0B]', '', 'g')) ELSE 0 END) AS BIGINT) AS small FROM (SELECT *, max(size) OVER (PARTITION BY doc, page, line) AS m FROM {_SPANS} WHERE page < 5) GROUP BY doc""")
def small_glyphs(spark, d):
    return ft.small_glyphs(_spans(spark, d))


@query(f"""WITH p AS (SELECT doc_id AS doc, CAST(ceil(ceil(length(text) / 20.0) / 48) AS BIGINT) AS pages FROM documents), s AS (SELECT s.*, max(size) OVER (PARTITION BY doc, page, line) AS m FROM {_SPANS} s JOIN p USING (doc) WHERE pages <= 12 OR page IN (SELECT CAST(floor(pages / 12 * i + pages / 24) AS BIGINT) FROM range(0, 12) t(i)))
    SELECT doc, round(coalesce(least(1.0, w / n), 0), 6) AS density FROM p LEFT JOIN (SELECT doc, sum(length(text)) AS n, sum(2.0 * len(regexp_extract_all(text, '[{ft.MATH_SYMBOLS}]')) + 0.8 * CASE WHEN size < 0.85 * m AND trim(text) <> '' THEN length(text) ELSE 0 END + 3.0 * CASE WHEN regexp_matches(font, '{ft.MATH_NAMES}') THEN length(text) ELSE 0 END) AS w FROM s GROUP BY doc) USING (doc)""")
def math_density(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.ceil(F.ceil(F.length("text") / 20.0) / 48).alias("pages"))
    return ft.math_density(_spans(spark, d), pages).withColumn("density", F.round("density", 6))


@query(r"""SELECT doc_id, i AS line_no, CASE WHEN len(regexp_extract_all(line, '[A-Za-z]')) < 4 OR regexp_matches(line, '[∑∫∏=]|\^\{|_\{') THEN 0 WHEN r >= 1.40 THEN 1 WHEN r >= 1.18 THEN 2 WHEN r >= 1.08 THEN 3 ELSE 0 END AS level
    FROM (SELECT doc_id, i, ls[i] AS line, 1 + (i % 50) / 100.0 AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))""")
def heading_level(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    no = (F.col("i") + 1).cast("long")
    return t.select("doc_id", no.alias("line_no"), gl.heading_level(F.col("line"), 1 + (no % 50) / 100.0).alias("level"))


@query("SELECT event_id, CASE WHEN z >= 0.85 * 10 THEN 'body' WHEN s < -1.5 THEN 'super' WHEN s > 1.5 THEN 'sub' ELSE 'body' END AS role FROM (SELECT event_id, 6.0 + event_id % 5 AS z, user_id % 9 - 4.0 AS s FROM events)")
def glyph_role(spark, d):
    return table(spark, d, "events").select("event_id", gl.glyph_role(6.0 + F.col("event_id") % 5, F.lit(10.0), F.col("user_id") % 9 - 4.0).alias("role"))


@query("SELECT * FROM (VALUES (1, '7=star,8=club'), (2, '64=oplus,65=otimes,66=wreath'), (3, '5=u,6=v,90=w,91=u'), (4, '0=a1,255=z'), (5, ''), (6, ''), (7, '12=x.alt')) t(i, names)")
def parse_differences(spark, d):
    cases = ["[7/star 8/club]", "[ 64 /oplus /otimes\n/wreath ]", "[5 /u /v 90/w/u]", "0 /a1 255 /z", "/lost /names", None, "[ 11 12 /x.alt ]"]
    df = spark.createDataFrame(list(enumerate(cases, 1)), "i int, s string")
    return df.select("i", F.coalesce(F.array_join(F.transform(gl.parse_differences(F.col("s")), lambda x: F.concat_ws("=", x["code"].cast("string"), x["name"])), ","), F.lit("")).alias("names"))


@query("""SELECT doc_id, starts_with(st, 'Type0') AND contains(en, 'Identity') AND NOT u AND p AND a < 0.6 AS suspect FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Type1' ELSE 'Type0' END AS st, CASE WHEN doc_id % 4 = 0 THEN 'MacRoman' ELSE 'Identity-V' END AS en, doc_id % 5 = 0 AS u, doc_id % 7 <> 0 AS p, (doc_id % 11) / 10.0 AS a FROM documents)""")
def structural_suspect(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", gl.structural_suspect(F.when(i % 3 == 0, "Type1").otherwise("Type0"), F.when(i % 4 == 0, "MacRoman").otherwise("Identity-V"), i % 5 == 0, i % 7 != 0, (i % 11) / 10.0).alias("suspect"))


# geometry: our own small pages

def _page(spark, docs):
    """Rows of glyphs from {doc: [line, ...]}; a line lists (ch, x0, x1[, y[, size]])."""
    rows = []
    for doc, lines in docs.items():
        for ln, line in enumerate(lines):
            for q, g in enumerate(line):
                x0, x1 = g[1], g[2]
                y, size = (g[3] if len(g) > 3 else 200 + 30 * ln), (g[4] if len(g) > 4 else 12)
                rows.append((doc, 0, ln, q, g[0], float(size), float(y), float(x0), float(x1)))
    return spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, seq int, ch string, size double, origin_y double, bbox_x0 double, bbox_x1 double")


def _shown(spark, docs):
    return gl.render(_page(spark, docs), 12.0).select(F.col("doc_id").cast("int").alias("doc_id"), F.replace("text", F.lit("\n"), F.lit("|")).alias("text"))


#: A run of letters of width 7 with a gap of 5 where a blank stands.
def _run(s: str, x: float = 0.0, y: float = 200.0) -> list[tuple]:
    out = []
    for c in s:
        if c == " ":
            x += 5
            continue
        out.append((c, x, x + 7, y))
        x += 7
    return out


@query(r"""SELECT * FROM (VALUES (1, 'mar y luz'), (2, 'ola'), (3, ': \frac{p}{q}'), (4, 'b_n^7'), (5, 'tiny'), (6, 'v^9'), (7, 'C_6'), (8, 'IZQ|DER'), (9, 'q^{ab}')) t(doc_id, text)""")
def line_render(spark, d):
    up, down = (190, 8), (210, 8)
    return _shown(spark, {
        1: [_run("mar y luz")], 2: [[("o", 0, 7), ("l", 7.5, 14), ("a", 14.9, 21)]], 3: [[(":", 0, 7), ("p", 13, 19, *up), ("q", 13, 19, *down)]], 4: [[("b", 0, 7), ("7", 7, 12, *up), ("n", 7, 12, *down)]],
        5: [[(c, 4 * i, 4 * i + 4, 200, 6) for i, c in enumerate("tiny")]], 6: [[("v", 0, 7), ("9", 7, 12, *up)]], 7: [[("C", 0, 7), ("6", 7, 12, *down)]], 8: [_run("IZQ") + _run("DER", 90)], 9: [[("q", 0, 7), ("a", 7, 11, *up), ("b", 11, 15, *up)]],
    })


@query(r"""SELECT * FROM (VALUES (1, '\begin{bmatrix}|u & v \\|w & x \\|y & z|\end{bmatrix}'), (2, 'u v|w x')) t(doc_id, text)""")
def matrix_render(spark, d):
    cells = [[(a, 4, 11), (b, 34, 41)] for a, b in ("uv", "wx", "yz")]
    return _shown(spark, {1: [[("⎛", 0, 9)], *cells, [("⎝", 0, 9)]], 2: cells[:2]})


@query("SELECT * FROM (VALUES (1, 'sol luna'), (2, 'sol|luna')) t(doc_id, text)")
def line_merge(spark, d):
    return _shown(spark, {1: [_run("sol"), _run("luna", 26, 205)], 2: [_run("sol"), _run("luna", 26, 215)]})


_BLANKS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"


@query(f"""SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest, count(*) AS lines FROM (SELECT doc_id, i, trim(regexp_replace(ls[i], '{_BLANKS}', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)) WHERE line <> '' GROUP BY doc_id""")
def glyph_roundtrip(spark, d):
    """All texts laid out as glyphs, one line below the other, and read back from their geometry."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", F.trim(F.regexp_replace("line", _BLANKS, " ")).alias("line")).where("line <> ''")
    g = t.select("doc_id", F.lit(0).alias("page_no"), "line_no", F.posexplode(F.split("line", "")).alias("seq", "ch")).where("ch <> '' and ch <> ' '")
    g = g.withColumns({"size": F.lit(10.0), "origin_y": F.col("line_no") * 12.0, "bbox_x0": F.col("seq") * 6.0, "bbox_x1": F.col("seq") * 6.0 + 6.0})
    return gl.render(g).select("doc_id", F.md5("text").alias("digest"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
