"""The font side of pages: predicates on names, counts and risks per family, recovery of wrong codes, measures of a page.

Glyph tables have a row per glyph: (book, page, line, seq, font, ch, size); spans a row per stretch of one font and size:
(doc, page, line, seq, font, size, text). All operators aggregate partially before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.operators.glyphs import SMALL, font_key, glyph_risk, structural_suspect

#: Names of fonts whose codes are known to be wrong, of Greek ones among them, and of mathematical fonts.
BROKEN_NAMES = r"(?i:MathematicalPi)|(?i:MathPi)|\bGrk\b|\bSym\b|(?i:EuclidSymbol)"
GREEK_NAMES = r"\bGrk\b"
MATH_NAMES = r"\b(?:CM[A-Z]+|cm[a-z]+)\b|\b(?:MTSY|MTMI|MTEX|MTSYN)\b|(?i:\bMath)|\b(?:STIX|stix)|\bAMS\w*\b|(?i:\bEuler\w*\b)|\bSymbol\b|\b(?:rsfs|euex|msam|msbm)\b"
#: Letters of the public Symbol encoding and what they show.
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUWXYZ"
SYMBOL = "αβχδεφγηιϕκλμνοπθρστυϖωξψζΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥΩΞΨΖ"
#: Which risk wins when books are merged.
RISK_RANK = {"silent": 3, "markered": 2, "recovered": 1, "stray": 1, "ok": 0}
#: Body size without text, pages looked at, weights of the density of mathematics.
BODY_DEFAULT, BODY_PAGES, SMALL_PAGES, DENSITY_PAGES = 11.0, 3, 5, 12
DENSITY = {"symbols": 2.0, "small": 0.8, "math_font": 3.0}
MATH_SYMBOLS = "∫∮∯∰∱∲∳∑∏∐∂∇√∛∜≠≤≥≈≡≢≜≝≅≃≄±∓×÷⋅∗⊕⊖⊗⊘⊙∈∉∋∌⊂⊃⊆⊇∩∪∀∃∄∅→←↔⇒⇐⇔↦∞ℵℶℷℏℎℓ℘ℜℑαβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"


def bare_name(font: Column) -> Column:
    """The name behind a subset prefix; null is ''."""
    return F.regexp_replace(F.coalesce(font, F.lit("")), r"^[^+]*\+", "")


def name_broken(font: Column) -> Column:
    return bare_name(font).rlike(BROKEN_NAMES)


def greek_font(font: Column) -> Column:
    return bare_name(font).rlike(GREEK_NAMES)


def math_font(font: Column) -> Column:
    return F.coalesce(font, F.lit("")).rlike(MATH_NAMES)


def needs_recovery(font: Column, ch: Column) -> Column:
    """Whether a glyph of a broken font shows its raw code: a control sign that is no space, or a Latin letter of a Greek font."""
    o = F.ascii(ch)
    raw = (F.length(ch) > 0) & (o.between(0, 8) | o.between(14, 27))
    return F.coalesce(name_broken(font) & (raw | (greek_font(font) & ch.rlike("^[A-Za-z]$"))), F.lit(False))


def greek_letter(font: Column, ch: Column) -> Column:
    """What a Latin letter of a broken Greek font stands for; anything else as it is."""
    return F.when(name_broken(font) & greek_font(font), F.translate(ch, LATIN, SYMBOL)).otherwise(ch)


def first_per_family(meta: DataFrame, order: list[str]) -> DataFrame:
    """Per (book, family) the first font object in the given order; fonts without a name are dropped.

    One value per group is kept while aggregating, so a font on every page of a long book costs nothing to group.
    """
    rest = [c for c in meta.columns if c not in ("book", "font")]
    m = meta.withColumn("family", font_key(F.col("font"))).where("family <> ''")
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return m.groupBy("book", "family").agg(first.alias("m")).select("book", "family", *[F.col(f"m.{c}").alias(c) for c in rest])


def char_counts(glyphs: DataFrame) -> DataFrame:
    """(book, family, ch, n); null and empty signs are dropped."""
    return glyphs.where("ch <> ''").groupBy("book", font_key(F.col("font")).alias("family"), "ch").agg(F.count("*").alias("n"))


def family_metrics(counts: DataFrame) -> DataFrame:
    """(book, family, glyphs, printable, letters, alpha_ratio) from (book, family, ch, n); the ratio is 0 without printable signs."""
    o = F.ascii("ch")
    ascii_ = (F.length("ch") == 1) & o.between(33, 126)
    sum_ = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    m = counts.groupBy("book", "family").agg(F.sum("n").alias("glyphs"), sum_(ascii_).alias("printable"), sum_(ascii_ & F.col("ch").rlike("[A-Za-z]")).alias("letters"))
    return m.withColumn("alpha_ratio", F.when(F.col("printable") > 0, F.col("letters") / F.col("printable")).otherwise(0.0))


def with_meta(metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """Family metrics beside their font metadata (defaults where a family has none), and whether the font is suspect."""
    m = meta.select("book", "family", "subtype", "encoding", "has_tounicode")
    j = metrics.join(m, ["book", "family"], "left")
    j = j.withColumns({"subtype": F.coalesce("subtype", F.lit("")), "encoding": F.coalesce("encoding", F.lit("")), "has_tounicode": F.coalesce("has_tounicode", F.lit(False)), "broken_name": name_broken(F.col("family")), "greek": greek_font(F.col("family"))})
    j = j.withColumn("structural", structural_suspect(F.col("subtype"), F.col("encoding"), F.col("has_tounicode"), F.col("printable") > 0, F.col("alpha_ratio")))
    return j.withColumn("suspect", F.col("broken_name") | F.col("structural"))


def risks(counts: DataFrame, report: DataFrame) -> DataFrame:
    """(book, family, ch, n, risk) of every sign of every family."""
    j = counts.join(report.select("book", "family", "suspect", "greek"), ["book", "family"])
    return j.select("book", "family", "ch", "n", glyph_risk(F.col("ch"), F.col("suspect"), F.col("greek")).alias("risk"))


def font_counts(risk: DataFrame) -> DataFrame:
    """(family, silent, control, total) over all books."""
    pick = lambda *k: F.sum(F.when(F.col("risk").isin(*k), F.col("n")).otherwise(0))
    return risk.groupBy("family").agg(pick("silent").alias("silent"), pick("markered", "stray").alias("control"), F.sum("n").alias("total"))


def merge_corpus(report: DataFrame) -> DataFrame:
    """Families over all books: suspect if ever so, with Unicode maps only if always, the first book's subtype and encoding
    that are not empty, and all books in order. Books are numbered by their name."""
    told = F.when(F.col("subtype") != "", F.struct("book", "subtype", "encoding"))
    g = report.groupBy("family").agg(F.bool_or("structural").alias("structural"), F.bool_or("broken_name").alias("broken_name"), F.bool_and("has_tounicode").alias("has_tounicode"), F.min(told).alias("t"), F.array_join(F.sort_array(F.collect_set("book")), ",").alias("books"), F.sum("glyphs").alias("glyphs"))
    return g.select("family", "structural", "broken_name", "has_tounicode", F.coalesce("t.subtype", F.lit("")).alias("subtype"), F.coalesce("t.encoding", F.lit("")).alias("encoding"), "books", "glyphs", (F.col("structural") & ~F.col("broken_name")).alias("blind_spot"))


def merge_risks(risk: DataFrame) -> DataFrame:
    """(family, ch, n, risk) over all books; the worst risk wins."""
    rank = F.coalesce(*[F.when(F.col("risk") == k, F.lit(v)) for k, v in RISK_RANK.items()])
    return risk.groupBy("family", "ch").agg(F.sum("n").alias("n"), F.max_by("risk", F.struct(rank, "risk")).alias("risk"))


def top_fonts(counts: DataFrame, n: int) -> DataFrame:
    """The n families of most silent signs, without those that have neither silent nor control signs."""
    return counts.where("silent > 0 or control > 0").orderBy(F.desc("silent"), "family").limit(n)


def inventory(merged_risks: DataFrame, merged: DataFrame, least: int = 1) -> DataFrame:
    """(family, silent, glyphs): suspect families with their silent and control signs, the most frequent first."""
    bad = merged_risks.where(F.col("risk").isin("silent", "markered"))
    one = F.struct((-F.col("n")).alias("o"), "ch", "n", "risk")
    g = bad.groupBy("family").agg(F.sum(F.when(F.col("risk") == "silent", F.col("n")).otherwise(0)).alias("silent"), F.sort_array(F.collect_list(F.when(F.col("n") >= least, one))).alias("g"))
    g = g.join(merged.where("structural or broken_name").select("family"), "family", "left_semi").where(F.size("g") > 0)
    code = lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x["ch"])), 4, "0"), F.lit(":"), x["n"].cast("string"), F.lit(":"), x["risk"])
    return g.select("family", "silent", F.transform("g", code).alias("glyphs"))


# recovery


def covers(glyphs: DataFrame, table: DataFrame) -> DataFrame:
    """Glyphs of the families that a curated table knows at all."""
    return glyphs.join(table.select("family").distinct(), "family", "left_semi")


def recover(glyphs: DataFrame, table: DataFrame, differences: DataFrame, names: DataFrame, supplement: DataFrame, visual: DataFrame | None = None) -> DataFrame:
    """glyphs (family, codepoint, ch, broken, ...) with `out` and `source`: what each sign should read.

    The order of the channels: the curated table (family, codepoint, unicode); for broken signs the glyph name of
    differences (family, codepoint, name) by the standard names (name, unicode), then by the supplement; then what was
    matched by sight (family, codepoint, unicode); then a marker with the name or the code. Signs of fonts that are not
    broken stay. Names made of a letter and digits alone mean nothing and are looked up nowhere but in the supplement.
    """
    j = glyphs.join(table.select("family", "codepoint", F.col("unicode").alias("_t")).dropDuplicates(["family", "codepoint"]), ["family", "codepoint"], "left")
    j = j.join(differences.select("family", "codepoint", F.col("name").alias("_n")).dropDuplicates(["family", "codepoint"]), ["family", "codepoint"], "left")
    j = j.join(names.select(F.col("name").alias("_n"), F.col("unicode").alias("_a")).dropDuplicates(["_n"]), "_n", "left")
    j = j.join(supplement.select(F.col("name").alias("_n"), F.col("unicode").alias("_s")).dropDuplicates(["_n"]), "_n", "left")
    if visual is not None:
        j = j.join(visual.select("family", "codepoint", F.col("unicode").alias("_v")).dropDuplicates(["family", "codepoint"]), ["family", "codepoint"], "left")
    else:
        j = j.withColumn("_v", F.lit(None).cast("string"))
    void = F.coalesce(F.col("_n").rlike(r"^[A-Za-z]{1,3}[0-9]+$"), F.lit(False))
    agl = F.when(F.col("broken") & ~void, F.col("_a"))
    sup = F.when(F.col("broken"), F.col("_s"))
    seen = F.when(F.col("broken"), F.col("_v"))
    out = F.coalesce("_t", agl, sup, seen, F.when(F.col("broken"), marker(F.col("_n"), F.col("codepoint"))), F.col("ch"))
    source = F.when(F.col("_t").isNotNull(), "table").when(agl.isNotNull(), "names").when(sup.isNotNull(), "supplement").when(seen.isNotNull(), "visual").when(F.col("broken"), F.when(F.col("_n").isNull(), "no_name").otherwise("unknown_name")).otherwise("kept")
    return j.select(*glyphs.columns, F.col("_n").alias("name"), out.alias("out"), source.alias("source"))


def marker(name: Column, codepoint: Column) -> Column:
    """The sign that stands for an unreadable glyph: its name, else its code."""
    return F.concat(F.lit("⟦?"), F.coalesce(name, F.concat(F.lit("U+"), F.when(codepoint > 0xFFFF, F.hex(codepoint)).otherwise(F.lpad(F.hex(codepoint), 4, "0")))), F.lit("⟧"))


def recovery_summary(recovered: DataFrame, n: str = "n") -> DataFrame:
    """Per family and in all (null family): broken signs by how they were recovered, and the share recovered in percent."""
    b = recovered.where("broken")
    k = lambda *s: F.sum(F.when(F.col("source").isin(*s), F.col(n)).otherwise(0))
    g = b.rollup("family").agg(F.sum(n).alias("occurrences"), k("names").alias("by_name"), k("supplement").alias("by_supplement"), k("no_name").alias("no_name"), k("unknown_name").alias("unknown_name"))
    return g.withColumn("recovered", F.round(100.0 * (F.col("by_name") + F.col("by_supplement")) / F.col("occurrences"), 4))


# measures of pages


def body_size(spans: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc, body): the size, to a tenth, of most characters on the first pages; of equal ones the one seen first; documents
    of `docs` without text get the default."""
    s = spans.where(F.col("page") < BODY_PAGES).groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line", "seq")).alias("at"))
    order = F.struct("n", (-F.col("at.page")).alias("a"), (-F.col("at.line")).alias("b"), (-F.col("at.seq")).alias("c"))
    b = s.groupBy("doc").agg(F.max_by("size", order).alias("body"))
    return b if docs is None else docs.select("doc").distinct().join(b, "doc", "left").select("doc", F.coalesce("body", F.lit(BODY_DEFAULT)).alias("body"))


def _largest(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_max", F.max("size").over(W.partitionBy("doc", "page", "line")))


def small_glyphs(spans: DataFrame) -> DataFrame:
    """(doc, small): signs on the first pages that are set clearly smaller than their line's largest."""
    n = F.length(F.regexp_replace("text", r"\s", ""))
    return _largest(spans.where(F.col("page") < SMALL_PAGES)).groupBy("doc").agg(F.sum(F.when(F.col("size") < SMALL * F.col("_max"), n).otherwise(0)).alias("small"))


def sampled(page: Column, pages: Column, most: int = DENSITY_PAGES) -> Column:
    """Whether a page belongs to the `most` pages spread evenly over a document of so many pages."""
    step = pages / most
    at = F.greatest(F.lit(0), F.floor((page - step / 2) / step))
    near = [F.floor(step * (at + i) + step / 2) == page for i in (0, 1)]
    return (pages <= most) | near[0] | near[1]


def math_density(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, density): symbols, small type and mathematical fonts among the characters of the sampled pages, weighted, at
    most 1; documents without text have 0. `pages` holds (doc, pages)."""
    s = _largest(spans.join(pages, "doc").where(sampled(F.col("page"), F.col("pages"))))
    n = F.length("text")
    part = {"symbols": F.regexp_count("text", F.lit(f"[{MATH_SYMBOLS}]")), "small": F.when((F.col("size") < SMALL * F.col("_max")) & (F.trim("text") != ""), n).otherwise(0), "math_font": F.when(math_font(F.col("font")), n).otherwise(0)}
    g = s.groupBy("doc").agg(F.sum(n).alias("n"), F.sum(sum((DENSITY[k] * c for k, c in part.items()), F.lit(0.0))).alias("w"))
    d = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("w") / F.col("n"))).otherwise(0.0)
    return pages.select("doc").join(g, "doc", "left").select("doc", F.coalesce(d, F.lit(0.0)).alias("density"))
