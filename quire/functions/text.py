"""Column functions for metadata and cleaning: built-in expressions only, so they stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: One-to-one replacements of typographic characters, and the dropped ones behind them.
ONE_TO_ONE = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"',
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
    "­": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "ħ": "ℏ",
}
DROPPED = "​‌‍⁠﻿" + "".join(map(chr, [*range(0, 9), 11, 12, *range(14, 32), *range(127, 160), *range(0xFFFC, 0x10000)]))
#: Ligatures by their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Digits, signs and letters set high or low, and what they are on the line.
SUPER, SUPER_PLAIN = "²³¹⁰ⁱ⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "2310i456789+-=()n"
SUB, SUB_PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜᵢᵣᵤᵥ", "0123456789+-=()aeoxhklmnpstiruv"
#: Those that keep their braces also alone.
WIDE = "⁺⁼⁽⁾₊₌₍₎"
ISBN = "[0-9](?:[- ]?[0-9]){8,11}[- ]?[0-9Xx]"
WORD_CHARS = r"\p{L}\p{N}_"


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def stem(filename: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def isbn_digits(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^0-9X]", "")


def isbn_valid(c: Column) -> Column:
    """Whether an ISBN of 13 or 10 places has a right check digit; null, empty and other lengths are false."""
    s = isbn_digits(c)
    digit = lambda i: F.when(F.substr(s, i, F.lit(1)) == "X", 10).otherwise(F.substr(s, i, F.lit(1)).try_cast("int"))
    add = lambda n, weight: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + F.coalesce(digit(i), F.lit(0)) * weight(i))
    t13 = s.rlike("^[0-9]{13}$") & (add(13, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10 == 0)
    t10 = s.rlike("^[0-9]{9}[0-9X]$") & (add(10, lambda i: F.lit(11) - i) % 11 == 0)
    return F.coalesce(t13 | t10, F.lit(False))


def isbn_extract(text: Column, scan: int = 5000) -> Column:
    """The first number in the opening of a text that is a valid ISBN, without separators; null if there is none."""
    found = F.transform(F.regexp_extract_all(F.substring(text, 1, scan), F.lit(ISBN), F.lit(0)), isbn_digits)
    return F.get(F.filter(found, isbn_valid), F.lit(0))


def clean_title(filename: Column) -> Column:
    """A title from a file name: edition phrases, bracketed years and bracketed parts dropped, dashes opened."""
    s = stem(filename)
    t = F.regexp_replace(s, r"(?i)(?:[0-9]{1,2}(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)[ _-]*edition", "")
    t = F.regexp_replace(t, r"[(\[](?:19|20)[0-9]{2}[)\]]", "")
    t = F.regexp_replace(t, r"\[[^\]]*\]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[-_]+", " "), " +", " "))
    return F.coalesce(blank_to_null(t), blank_to_null(s), F.lit("Unknown"))


def year_extract(filename: Column, text: Column, last: int = 2025) -> Column:
    """A year: bracketed in the file name, else after a word of publication, else in a heading, within 1900..last."""
    year = lambda c, p: F.regexp_extract(c, p, 1).try_cast("int")
    head = F.substring(text, 1, 3000)
    bound = lambda y: F.when((y >= 1900) & (y <= last), y)
    return F.coalesce(
        year(filename, r"[(\[]((?:19|20)[0-9]{2})[)\]]"),
        bound(year(head, r"(?i)(?:copyright|published|publicado|edition|edición|©)[^0-9\n]{0,20}((?:19|20)[0-9]{2})")),
        bound(year(head, r"(?m)^#[^\n0-9]*((?:19|20)[0-9]{2})")),
    )


def edition_extract(filename: Column, text: Column) -> Column:
    """The edition as written in the file name or the opening: '2nd edition', 'edition 2', 'First edition', '2ª ed'."""
    s = F.concat_ws(" ", filename, F.substring(text, 1, 2000))
    get = lambda p: F.when(F.length(F.regexp_extract(s, p, 1)) > 0, F.regexp_extract(s, p, 1))
    return F.coalesce(
        get(r"(?i)([0-9]{1,2}(?:st|nd|rd|th)) edition"), get(r"(?i)edition ([0-9]{1,2})"), get(r"(?i)(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth) edition"), get(r"(?i)([0-9]{1,2})[ªa] ed")
    )


#: Words that no author's name holds, sites that sign file names, words of titles, words between names.
SKIP = "edition press publishing published university chapter contents isbn copyright reserved introduction preface foreword table volume acknowledgments third second first fourth fifth".split()
SITES = "bookfi pdfdrive libgen z-lib bookzz org".split()
TITLE_WORDS = "the approach modern hacking ethical strategy innovative digital products guide complete handbook manual textbook fundamentals principles that people want devise make think things applications concepts theory practice using learning mastering advanced beginner missing revisited essential practical professional".split()
BETWEEN = "and & y e und et".split()


def _named(c: Column) -> Column:
    """Whether a part is one to five words, each with a capital, none of them a word that no name holds."""
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x.rlike(r"^\p{L}"))
    return F.size(w).between(1, 5) & F.forall(w, lambda x: x.rlike(r"^\p{Lu}")) & ~F.exists(w, lambda x: F.lower(x).isin(SKIP))


def author_from_name(filename: Column) -> Column:
    """An author from a file name: '[Name Name]' at its end, 'Title - Name' or 'Name - Title', 'title___Name', 'by Name'."""
    raw = stem(filename)
    s = F.translate(raw, "_", " ")
    sign = F.trim(F.regexp_extract(raw, r"\[([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,4})\]\s*$", 1))
    bad = F.exists(F.split(sign, r"\s+"), lambda x: F.lower(x).isin(SITES + SKIP))
    parts = F.when(F.contains(s, F.lit(" - ")), F.reverse(F.transform(F.split(s, " - "), lambda x: F.trim(x))))
    dashed = F.get(F.filter(parts, _named), F.lit(0))
    last = F.trim(F.translate(F.element_at(F.split(raw, "___"), -1), "_", " "))
    under = F.when(F.contains(raw, F.lit("___")) & _named(last), F.array_join(F.filter(F.split(last, r"\s+"), lambda x: x.rlike(r"^\p{L}")), " "))
    by = F.trim(F.regexp_extract(s, r"(?i)\bby\s+([A-Z][a-zA-Z]+(?:[^\S\n]+[A-Z][a-zA-Z]+){0,4})\s*[\[\s]", 1))
    return F.coalesce(F.when((F.length(sign) > 4) & ~bad, sign), dashed, under, F.when(F.length(by) > 4, by))


def author_from_text(text: Column) -> Column:
    """An author from the opening of a text: the last line of its cover that looks like a name, else a line that says so
    ('by', 'author', 'written by', 'edited by')."""
    cover = F.substring(F.get(F.split(text, r"\n---"), F.lit(0)), 1, 600)
    core = F.transform(F.filter(F.transform(F.split(cover, r"\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.trim(F.get(F.split(x, r",\s*[A-Z]{2,}"), F.lit(0))))

    def name(x: Column) -> Column:
        w = F.split(x, r"\s+")
        own = F.filter(w, lambda v: ~F.lower(v).isin(BETWEEN))
        shape = F.forall(w, lambda v: v.rlike(r"^[A-Za-z][a-zA-Z']*\.?$")) & F.forall(own, lambda v: v.rlike(r"^[A-Z]")) & ~F.exists(own, lambda v: v.rlike(r"^[A-Z]{3,}\.?$"))
        return F.size(w).between(2, 5) & (x != F.upper(x)) & (F.size(own) > 0) & shape & ~F.exists(w, lambda v: F.lower(v).isin(SKIP + TITLE_WORDS)) & F.exists(own, lambda v: F.length(v) > 3)

    found = F.try_element_at(F.filter(core, name), F.lit(-1))
    one, gap = r"(?:[A-Z][a-zA-Z']+|[A-Z]\.)", r"(?:[^\S\n]+(?:and|&|y)[^\S\n]+|[^\S\n]*,[^\S\n]*|[^\S\n]+)"
    names = f"({one}(?:{gap}{one}){{0,5}})"
    said = []
    for lead in (r"^[Bb]y\s+", r"[Aa]uthors?[:\s]+", r"[Ww]ritten\s+by\s+", r"[Ee]dited\s+by\s+"):
        c = F.regexp_replace(F.regexp_extract(F.substring(text, 1, 1500), rf"(?m){lead}{names}\s*$", 1), r"^[ ,.]+|[ ,.]+$", "")
        w = F.split(c, r"\s+")
        fine = (F.length(c) > 4) & (F.length(c) < 80) & ~F.lower(F.get(w, F.lit(0))).isin(SKIP) & (c != F.upper(c)) & ~F.exists(w, lambda v: F.lower(v).isin(TITLE_WORDS))
        said.append(F.when(fine, c))
    return F.coalesce(found, *said)


def extract_author(filename: Column, text: Column) -> Column:
    """An author from the file name, else from the opening of the text; null if neither tells."""
    return F.coalesce(author_from_name(filename), author_from_text(text))


def book_id(isbn: Column, file_hash: Column, language: Column, topic: Column) -> Column:
    """isbn (or 8 characters of the hash)-language-topic."""
    lang = F.lower(F.substring(F.coalesce(blank_to_null(language), F.lit("und")), 1, 5))
    top = F.substring(F.regexp_replace(F.lower(F.coalesce(blank_to_null(topic), F.lit("general"))), "[^a-z0-9]", ""), 1, 15)
    return F.concat_ws("-", F.coalesce(blank_to_null(isbn), F.substring(file_hash, 1, 8)), lang, top)


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def topic_scores(title: Column, text: Column, keywords: dict[str, list[str]], code_topic: str | None = None, code_patterns: list[str] | None = None) -> Column:
    """Array of (score, -order, topic): keyword counts over the title eight times, the opening, and the body after it."""

    def scored(h: Column) -> Column:
        out = []
        for i, (topic, words) in enumerate(keywords.items()):
            n = F.lit(0)
            for w in words:
                n = n + F.when(F.contains(h, F.lit(w)), occurrences(h, w)).otherwise(0)
            if topic == code_topic and code_patterns:
                hits = F.lit(0)
                for p in code_patterns:
                    hits = hits + F.regexp_count(text, F.lit(p))
                n = n + F.least(hits * 5, F.lit(80))
            out.append(F.struct(n.alias("score"), F.lit(-i).alias("rank"), F.lit(topic).alias("topic")))
        return F.array(*out)

    h = F.concat(F.repeat(F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" ")), 8), F.lower(F.substring(text, 1, 200)), F.lit(" "), F.lower(F.substring(text, 501, 6200)))
    return _let(h, scored)


def classify_topic(title: Column, text: Column, keywords: dict[str, list[str]], least: int = 4, **code) -> Column:
    """The topic of most keyword hits, ties to the first listed; 'general' below `least`."""
    best = F.array_max(topic_scores(title, F.coalesce(text, F.lit("")), keywords, **code))
    return _let(best, lambda b: F.when(b["score"] >= least, b["topic"]).otherwise("general"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[\s\x{85}\x{A0}\x{2028}\x{2029}]+"), lambda w: w != "")).cast("long")


def char_translate(c: Column) -> Column:
    """Ligatures opened, typographic quotes, spaces and dashes made plain, invisible and control characters dropped."""
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(ONE_TO_ONE) + DROPPED, "".join(ONE_TO_ONE.values()))


def scripts(c: Column) -> Column:
    """Runs of raised or lowered signs as ^{23} or _{23}; a single letter, digit or minus as ^2 or _2."""
    for chars, plain, mark in ((SUPER, SUPER_PLAIN, r"\^"), (SUB, SUB_PLAIN, "_")):
        wide = "".join(x for x in WIDE if x in chars)
        c = F.regexp_replace(c, f"([{chars}]{{2,}}|[{wide}])", mark + "{$1}")
        c = F.regexp_replace(c, f"(?<![{{{chars}])([{chars}])(?![{chars}}}])", mark + "$1")
        c = F.translate(c, chars, plain)
    return c


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")


def charset_sanitize(c: Column) -> Column:
    """Without control, format, surrogate, private and unassigned characters, but for tab, line feed and return."""
    return F.regexp_replace(c, r"[\p{C}&&[^\t\n\r]]", "")


def ws_collapse(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" +\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """The cleaning steps that built-in functions can say, in their order; functions.unicode.normalize has them all."""
    return ws_collapse(charset_sanitize(dehyphenate(char_translate(scripts(char_translate(c))))))


def brace_state(c: Column) -> Column:
    """(depth, bad): open braces at the end, and whether one closed before it opened; escaped braces are ignored."""
    chars = F.split(F.regexp_replace(c, r"\\[{}]|[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))
    return F.aggregate(
        chars, zero, lambda a, x: F.struct((a["depth"] + F.when(x == "{", 1).when((x == "}") & (a["depth"] > 0), -1).otherwise(0)).alias("depth"), (a["bad"] | ((x == "}") & (a["depth"] == 0))).alias("bad"))
    )


def repair_line(line: Column) -> Column:
    """A line without an orphan ^ or _ at its end, and with one to three open braces closed."""
    t = F.regexp_replace(line, r"[\^_]+\s*$", "")
    b = brace_state(t)
    # a backslash at the end would escape the brace that closes
    return F.when(~b["bad"] & b["depth"].between(1, 3) & ~t.endswith("\\"), F.concat(t, F.repeat(F.lit("}"), b["depth"]))).otherwise(t)


def repair_markdown(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), repair_line), "\n")


def sanitize_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"[^{WORD_CHARS}\s.,:;'\"()-]", " "), r"\s+", " "))


def sanitize_doc(c: Column) -> Column:
    return F.translate(c, "<>{}|\\^`", "")


def isbn_param(c: Column) -> Column:
    s = F.regexp_replace(c, "[^0-9Xx-]", "")
    return F.when(F.length(s).isin(10, 13, 17), s)


def safe_filename(c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(c, rf"[^{WORD_CHARS}-]+", "_"), "^_+|_+$", ""), 1, 100)
    return F.coalesce(blank_to_null(s), F.lit("book"))


def client_ip(forwarded: Column, peer: Column, depth: int) -> Column:
    """The address `depth` places from the right of X-Forwarded-For, else the peer."""
    ips = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(ips, F.lit(-depth)), peer)


def safe_url(c: Column) -> Column:
    return F.when(c.rlike("^(?:https?://|/(?!/)|[^:/?#]+(?:[/?#]|$))") & ~c.rlike(r"^\s*(?i)(?:javascript|data|vbscript):"), c).otherwise("")


def strip_accents(c: Column) -> Column:
    """Lower case without accents, for the Latin letters, by a rule-made table."""
    import unicodedata

    pairs = [(x, unicodedata.normalize("NFD", x)[0]) for x in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", x)) > 1]
    return F.translate(F.lower(c), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def highlight(c: Column, words: list[str]) -> Column:
    """The words of a query (beginnings count) marked in a text, without regard to case; no words mark nothing."""
    import re as _re

    own = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    return F.regexp_replace(c, "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(_re.escape(w) for w in own) + ")", "<mark>$1</mark>") if own else c


def crop(c: Column, words: list[str], tokens: int = 200) -> Column:
    """At most so many blank-parted tokens of a text, from a little before the first word of the query that it holds."""
    import re as _re

    own = [w for w in words if w]
    toks = F.split(c, " ")
    if not own:
        return F.array_join(F.slice(toks, 1, tokens), " ")
    before = F.regexp_extract(c, "(?is)^(.*?)(?<![\\p{L}\\p{N}])(?:" + "|".join(_re.escape(w) for w in own) + ")", 1)
    hit = c.rlike("(?i)(?<![\\p{L}\\p{N}])(?:" + "|".join(_re.escape(w) for w in own) + ")")
    at = F.when(hit, F.size(F.split(before, " "))).otherwise(1)
    # the window starts half a window before the hit, but shows as many tokens as there are
    start = F.greatest(F.lit(1), F.least(at - F.lit(tokens // 2), F.size(toks) - F.lit(tokens - 1)))
    return F.array_join(F.slice(toks, start, F.lit(tokens)), " ")


def escape_marked(c: Column) -> Column:
    """HTML-escaped but for the marks of highlighting."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("&lt;mark&gt;", "<mark>"), ("&lt;/mark&gt;", "</mark>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def phone(prefix: Column, number: Column) -> Column:
    """A telephone number: the prefix without blanks, then the digits of the number; null without a number."""
    return F.concat(F.regexp_replace(F.coalesce(prefix, F.lit("")), r"\s", ""), F.regexp_replace(number, "[^0-9]", ""))


def safe_path(c: Column, allowed: list[str], default: str = "/") -> Column:
    """A path of this site to go on to: one leading slash and a page that is allowed; else the default."""
    page = F.regexp_extract(c, r"^([^?#]*)", 1)
    return F.when(c.rlike(r"^/(?![/\\])") & page.isin(*allowed), c).otherwise(default)


def luhn(c: Column) -> Column:
    """Whether the digits of a number have a right check digit; null, empty and other signs are false."""
    d = F.reverse(F.regexp_replace(c, r"[\s-]", ""))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(d))), lambda i: _doubled(F.substr(d, i, F.lit(1)).try_cast("int"), i))
    return F.coalesce(d.rlike("^[0-9]+$") & (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0), F.lit(False))


def _doubled(x: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, x).when(x > 4, x * 2 - 9).otherwise(x * 2)


#: Frequent short words of seven languages, by which a language is told without a model.
STOP_WORDS = {
    "es": "el los las del una por con para se su que es y en lo como pero más".split(),
    "en": "the of and to in is that it for with as on by are this from be was".split(),
    "fr": "le les des une est dans pour qui sur pas avec au et du ce par ne plus".split(),
    "de": "der die das und ist nicht mit auf ein eine zu den von im dem für sich auch".split(),
    "pt": "o os uma não com mais para do da em um são ao pela dos nas também mas".split(),
    "it": "il gli che della più di un per non sono nel con la dei le una si anche".split(),
    "ru": "и в на не что как для это по из но от с к так или же при".split(),
}


def lang_detect(c: Column, scan: int = 3000) -> Column:
    """The language of most stop words in the opening of a text, ties to the first listed; 'und' without any, or for null."""
    words = F.split(F.lower(F.substring(F.coalesce(c, F.lit("")), 1, scan)), r"[^\p{L}]+")
    hits = lambda w, own: F.size(F.filter(w, lambda x: x.isin(own)))
    score = lambda w: F.array(*[F.struct(hits(w, own).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("lang")) for i, (k, own) in enumerate(STOP_WORDS.items())])
    return _let(F.array_max(_let(words, score)), lambda b: F.when(b["n"] > 0, b["lang"]).otherwise("und"))
