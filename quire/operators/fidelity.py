"""Measures of a conversion: fidelity to its source, validity of its formulas, agreement with a known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import brace_state
from quire.operators.stats import line_table

#: Signs whose survival is measured, signs of broken text, weights of the measures.
TRACKED = "∫∮∑∏∂∇√≠≤≥≈±×÷⋅∗⊕⊗∈∉⊂⊃∪∩∀∃∞ℵℏ→←↔⇒⇐⇔↦αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
BROKEN = r"\x{FFFD}\x{FFFE}\x{FEFF}\x00ﬀ-ﬆ"
HEADING, SCRIPT = r"(?m)^#{1,6}\s+", r"[\^_](?:\{[^}]+\}|[A-Za-z0-9])"
FIDELITY = {"glyph_coverage": 0.20, "mojibake_score": 0.15, "symbol_preservation": 0.20, "structure_score": 0.10, "super_sub_detection": 0.25, "equation_validity": 0.10}
TRUTH = {"text_words": 0.15, "math_symbols": 0.20, "mojibake_free": 0.15, "super_sub": 0.30, "structure": 0.10, "equation_tokens": 0.10}
MARKED, ORPHAN = r"\^\{|_\{|\^[A-Za-z0-9]|_[A-Za-z0-9]", r"[\^_]\s*$|[\^_]\s*[)}\],.!?]"
#: What opens and closes in a formula, in reading order; an escaped sign neither.
DELIMITERS = r"\\(?:begin|end)\{[^}]*\}|\\left|\\right|\\.|[{}]"


def signs(c: Column) -> Column:
    """The distinct characters of a text but for white space."""
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: ~x.rlike(r"^\s*$"))


def fidelity(source: Column, markdown: Column, small: Column, validity: Column, compatible: Column | None = None) -> dict[str, Column]:
    """The six scores and `overall` of a conversion beside the text it came from.

    small: signs of the source set smaller than their line; validity: share of valid formulas (null counts as 1);
    compatible: the markdown in compatibility form, whose signs count as present too.
    """
    src = signs(source)
    md = signs(markdown) if compatible is None else F.array_union(signs(markdown), signs(compatible))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(1.0)
    tracked = F.filter(src, lambda x: F.contains(F.lit(TRACKED), x))
    n = F.length(markdown)
    bad = F.regexp_count(markdown, F.lit(f"[{BROKEN}]"))
    scripts = F.regexp_count(markdown, F.lit(SCRIPT))
    out = {
        "glyph_coverage": share(F.array_intersect(src, md), src),
        "mojibake_score": F.when(n > 0, F.greatest(F.lit(0.0), 1 - bad / F.greatest(F.lit(1.0), n / 100))).otherwise(1.0),
        "symbol_preservation": share(F.array_intersect(tracked, signs(markdown)), tracked),
        "structure_score": F.when((F.length(source) > 200) & ~markdown.rlike(HEADING), 0.5).otherwise(1.0),
        "super_sub_detection": F.when(small >= 3, F.least(F.lit(1.0), scripts / F.greatest(F.lit(1), F.floor(small / 8)))).otherwise(1.0),
        "equation_validity": F.coalesce(validity, F.lit(1.0)),
    }
    return {**out, "overall": sum((w * out[k] for k, w in FIDELITY.items()), F.lit(0.0))}


def delimiters_ok(formula: Column) -> Column:
    """Whether braces, \\left and \\right, and environments close in the order they were opened."""
    toks = F.regexp_extract_all(formula, F.lit(f"({DELIMITERS})"), F.lit(1))
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("open"), F.lit(True).alias("ok"))

    def step(a: Column, t: Column) -> Column:
        opens = F.when(t == "{", "}").when(t == r"\left", r"\right").when(t.startswith(r"\begin{"), F.concat(F.lit(r"\end{"), F.substring(t, 8, 1_000_000)))
        closes = (t == "}") | (t == r"\right") | t.startswith(r"\end{")
        last = F.try_element_at(a["open"], F.lit(-1))
        fits = F.coalesce(last == t, F.lit(False))
        return F.struct(
            F.when(opens.isNotNull(), F.concat(a["open"], F.array(opens))).when(closes & fits, F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1)).otherwise(a["open"]).alias("open"), (a["ok"] & (~closes | fits)).alias("ok")
        )

    end = F.aggregate(toks, zero, step)
    return end["ok"] & (F.size(end["open"]) == 0)


def validate(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per document its lines with formula marks: total, valid, repaired (one to three missing braces closed would balance
    them), unbalanced, orphan, latex_errors, and validity (1 without such lines)."""
    m = line_table(df, key, text).where(F.col("line").rlike(MARKED))
    b = brace_state(F.col("line"))
    broken = b["bad"] | (b["depth"] != 0)
    orphan = F.col("line").rlike(ORPHAN)
    wrong = F.size(F.filter(F.regexp_extract_all("line", F.lit(r"\$\$?(.+?)\$\$?"), F.lit(1)), lambda f: ~delimiters_ok(f)))
    g = m.select(key, broken.alias("u"), (~b["bad"] & b["depth"].between(1, 3)).alias("r"), orphan.alias("o"), wrong.alias("w")).groupBy(key)
    g = g.agg(F.count("*").alias("total"), F.count_if(~F.col("u") & ~F.col("o") & (F.col("w") == 0)).alias("valid"), F.count_if("r").alias("repaired"), F.count_if("u").alias("unbalanced"), F.count_if("o").alias("orphan"), F.sum("w").alias("latex_errors"))
    n = ["total", "valid", "repaired", "unbalanced", "orphan", "latex_errors"]
    all_ = df.select(key).join(g, key, "left").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in n])
    return all_.withColumn("validity", F.when(F.col("total") == 0, 1.0).otherwise(F.col("valid") / F.col("total")))


def truth(markdown: Column, words: Column, symbols: Column, forbidden: Column, follows: Column, headings: Column, tokens: Column) -> dict[str, Column]:
    """The six scores of a conversion against what it must hold, and `overall`.

    words, symbols, forbidden, headings: arrays of text to be found (or not); follows: array of (context, next), where next
    must come behind the context with nothing but spaces and opening braces between; tokens: array of arrays, each a token
    of a formula with the signs that may stand for it.
    """
    inside = lambda c: F.filter(c, lambda x: F.contains(markdown, x))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(1.0)
    pattern = lambda x: F.concat(F.lit(r"\Q"), x["context"], F.lit(r"\E[\s{]*\Q"), x["next"], F.lit(r"\E"))
    kept = F.filter(follows, lambda x: F.regexp_like(markdown, pattern(x)))
    lines = F.size(F.filter(F.split(markdown, r"\n"), lambda x: F.trim(x).startswith("#")))
    n = F.greatest(F.lit(1), F.size(headings))
    hits = F.filter(tokens, lambda t: F.exists(t, lambda x: F.contains(markdown, x)))
    out = {
        "text_words": share(inside(words), words),
        "math_symbols": share(inside(symbols), symbols),
        "mojibake_free": F.when(F.size(forbidden) > 0, F.greatest(F.lit(0.0), 1 - F.size(inside(forbidden)) / F.size(forbidden))).otherwise(1.0),
        "super_sub": share(kept, follows),
        "structure": F.greatest(F.least(F.lit(1.0), lines / n), F.size(inside(headings)) / n),
        "equation_tokens": share(hits, tokens),
    }
    return {**out, "overall": sum((w * out[k] for k, w in TRUTH.items()), F.lit(0.0))}
