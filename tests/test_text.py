"""Column functions against plain Python and hand-worked cases."""

import re
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.functions import text as tx, unicode as un


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", f(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def isbn_ok(s):
    s = re.sub("[^0-9X]", "", (s or "").upper())
    if re.fullmatch(r"\d{13}", s):
        return sum(int(c) * (1 if i % 2 == 0 else 3) for i, c in enumerate(s)) % 10 == 0
    if re.fullmatch(r"\d{9}[\dX]", s):
        return sum((10 if c == "X" else int(c)) * (10 - i) for i, c in enumerate(s)) % 11 == 0
    return False


def test_isbn_valid_matches_checksum(spark):
    v = ["9780306406157", "978-0-306-40615-7", "0306406152", "080442957X", "0804429570", "", None, "123", "X" * 10, "9780306406158", "0" * 50]
    assert run(spark, tx.isbn_valid, v) == [isbn_ok(x) for x in v]


def test_isbn_transposition_fails(spark):
    good = "0306406152"
    swapped = [good[:i] + good[i + 1] + good[i] + good[i + 2 :] for i in range(8) if good[i] != good[i + 1]]
    assert not any(run(spark, tx.isbn_valid, swapped))


def test_isbn_extract_takes_first_valid(spark):
    v = ["x 9780306406158 y 0-306-40615-2 z", "nothing 12345", None, "", "a" * 6000 + " 0306406152"]
    assert run(spark, tx.isbn_extract, v) == ["0306406152", None, None, None, None]


def test_clean_title_and_author(spark):
    v = ["The_Book_2nd Edition (1999) [Ada Byron].pdf", "[x].pdf", "", None]
    assert run(spark, tx.clean_title, v) == ["The Book", "[x]", "Unknown", "Unknown"]
    v = ["The Book [Ada Byron].pdf", "Notes - Ada Byron.epub", "Notes___Ada_Byron.pdf", "Notes by Ada Byron [x].txt", "Notes.pdf", None, "x [Second Edition].pdf", "Ada Byron - some notes.pdf", ""]
    assert run(spark, tx.author_from_name, v) == ["Ada Byron", "Ada Byron", "Ada Byron", "Ada Byron", None, None, None, "Ada Byron", None]
    v = ["The Complete Guide\nAda Byron and Kay Long\nLONDON PRESS\n---\nNo Cover Here", "x y z\nWritten by Ada Byron, K. Long\n", "by Ada Byron\nfoo", "nothing at all here", None, "", "Edited by Modern Practice\n"]
    assert run(spark, tx.author_from_text, v) == ["Ada Byron and Kay Long", "Ada Byron, K. Long", "Ada Byron", None, None, None, None]


def test_scripts_and_hyphens(spark):
    v = ["x² y₁₀ 10⁻³", None, "", "aⁿ⁺¹", "cᵢⱼ q₊ k⁻", "x²₃"]
    want = ["x^2 y_{10} 10^{-3}", None, "", "a^{n+1}", "c_iⱼ q_{+} k^-", "x^2_3"]
    assert run(spark, tx.scripts, v) == want
    assert [un._RUN.sub(un._script, x) if x else x for x in v] == want
    assert run(spark, tx.dehyphenate, ["exam-\n ple", "A-\nB", "a - \nb"]) == ["example", "A-\nB", "a - \nb"]


def test_braces(spark):
    v = [r"\frac{a", "}b{", "{{{{y", "ok {a}", "x^", None]
    assert run(spark, tx.repair_line, v) == [r"\frac{a}", "}b{", "{{{{y", "ok {a}", "x", None]


def test_normalize_drops_category_c_and_is_idempotent(spark):
    v = ["a\x00b\x85c​d", "ﬁn “x” — y", "a-\nb  c \n\n\n\nd", "", None, "x" * 20_000]
    once = run(spark, tx.normalize_text, v)
    assert run(spark, tx.normalize_text, once) == once
    assert all(unicodedata.category(c)[0] != "C" or c in "\t\n\r" for t in once if t for c in t)


def test_nfkc_and_mojibake(spark):
    assert run(spark, un.nfkc, ["ℵ", "½", None]) == ["א", "1⁄2", None]
    assert run(spark, un.mojibake, ["cafÃ©", "café", None, "NÃO", ""]) == ["café", "café", None, "NÃO", ""]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab {}\\^_\n", max_size=12), min_size=5, max_size=25))
def test_repaired_markdown_is_balanced_or_beyond_repair(spark, values):
    for out in run(spark, tx.repair_markdown, values):
        for line in out.split("\n"):
            depth, bad = 0, False
            for c in re.sub(r"\\[{}]", "", line):
                depth += c == "{"
                if c == "}":
                    bad |= depth == 0
                    depth = max(0, depth - 1)
            assert bad or depth == 0 or depth > 3 or line.endswith("\\")


def test_topic_ties_go_to_the_first(spark):
    kw = {"first": ["alpha"], "second": ["beta"]}
    df = spark.createDataFrame([("alpha beta", "x"), (None, None), ("none", "y")], "t string, b string")
    assert [r[0] for r in df.select(tx.classify_topic(F.col("t"), F.col("b"), kw)).collect()] == ["first", "general", "general"]


def test_all_cleaning_steps(spark):
    v = ["cafÃ©  y ½ x²\x00 ﬁn", "plain-\ntext", "ok cafÃ© y ÑANDÚ", None, "", "a​b  \n\n\n\nc", "Ångström"]
    assert run(spark, un.normalize, v) == ["café y 1⁄2 x^2 fin", "plaintext", "ok café y ÑANDÚ", None, "", "ab\n\nc", "Ångström"]
    plain = ["ﬁn “x” — y²", "a-\nb c \n\n\nd", "", None, "x" * 9000, "\ttab\x07 y"]
    assert run(spark, lambda c: un.normalize(c, plain=True), plain) == run(spark, tx.normalize_text, plain)


def test_highlight_crop_and_check_digits(spark):
    assert run(spark, lambda c: tx.highlight(c, ["red", "re"]), ["Red fired redder", None, ""]) == ["<mark>Red</mark> fired <mark>red</mark>der", None, ""]
    assert run(spark, lambda c: tx.highlight(c, []), ["Red"]) == ["Red"]
    long = " ".join(f"w{i}" for i in range(50)) + " hit " + " ".join(f"v{i}" for i in range(50))
    out = run(spark, lambda c: tx.crop(c, ["hit"], 10), [long, "short hit", None, "none " * 3, ""])
    assert "hit" in out[0].split() and len(out[0].split()) == 10 and out[1:] == ["short hit", None, "none none none ", ""]
    assert run(spark, tx.luhn, ["79927398713", "79927398710", "7992 7398-713", "", None, "x1"]) == [True, False, True, False, False, False]
    assert run(spark, lambda c: tx.safe_path(c, ["/", "/a"]), ["/a?x", "//a", "/\\a", "/b", None, ""]) == ["/a?x", "/", "/", "/", "/", "/"]
    assert run(spark, lambda c: tx.phone(F.lit("+3 4"), c), ["91-2 3", None]) == ["+349123", None]


def test_language_by_stop_words(spark):
    v = ["El autor de los libros que se leen en la casa", "the author of the books that are read in the house", "der Autor der Bücher, die nicht im Haus sind", "le livre est dans la maison et les pages sont pour vous", "os livros que não são da casa com uma porta", "il libro che non è nel cassetto della casa", "это книга не для тех, кто в доме", "12 34", "", None]
    assert run(spark, tx.lang_detect, v) == ["es", "en", "de", "fr", "pt", "it", "ru", "und", "und", "und"]
