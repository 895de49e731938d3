"""Noise of scanned pages: found line by line and repaired into continuous paragraphs.

The running text is taken off its lines into one stream of characters and decoded against a lexicon counted over all
documents, joined by the document's own repeated words. Where the stream leaves the lexicon, a lattice over its characters
has an edge for every known word, read as it stands, under character confusions, across a space, a line end or a hyphen,
or beside another without a space, and for every word kept as unknown; the cheapest path wins. What is decoded at once is a
word outside the lexicon with all neighbours, known ones too, to which a word across their border leads at less cost; two
known words side by side stay as they are, since single words cannot tell "si no" from "sino". Running heads and page numbers are
taken out by their place, their repetition and the sequence of their numbers. Where paragraphs begin is chosen by dynamic
programming over the lines, whose state is the length of the paragraph so far.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import arrow_rows, materialize, ship

#: What scanners read, by what stood there.
CONFUSIONS = [("rn", "m"), ("m", "rn"), ("0", "o"), ("o", "0"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("@", "a"), ("5", "s"), ("9", "g"), ("6", "ó"), ("6", "b"), ("8", "b"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("li", "u"), ("u", "ii"), ("ll", "u"), ("q", "ç"), ("q", "g"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("3", "з"), ("4", "ч"), ("$", "s"), ("|", "l"), ("!", "l"), ("nn", "m"), ("iii", "m"), ("б", "6"), ("6", "б"), ("0", "о"), ("н", "и"), ("и", "н"), ("п", "л"), ("ш", "щ"), ("щ", "ш"), ("m", "т"), ("b", "ь"), ("u", "и"), ("9", "д"), ("c", "с"), ("e", "е"), ("a", "а"), ("o", "о"), ("p", "р"), ("@", "а"), ("x", "х"), ("y", "у"), ("тт", "п"), ("3", "э"), ("6", "ь"), ("ы", "ьi"), ("ьi", "ы"), ("ьl", "ы"), ("бl", "ы"), ("ä'", "ä"), ("v", "y"), ("v", "u"), ("s", "5")]
_BY: dict[str, list[tuple[str, str]]] = {}
for _w, _r in CONFUSIONS:
    _BY.setdefault(_w[0], []).append((_w, _r))
TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}«»“”„\"…*_<>/|⟦⟧=+#~^&%—–]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_HYPHEN = re.compile(r"([^\W\d_]|[0-9@$])([-¬\xad‐])\s*$")
_PAGE = re.compile(r"^\W*(?:(?:p|pp|pg|pag|pág|página|pagina|page|seite|s|стр|с)\W{1,3})?([0-9lIOoSsBZzgqi|]{1,4})(?:\s*/\s*\d{1,4})?\W*$", re.I)
_ROMAN = re.compile(r"^[\W]*([ivxlc]{1,7})[\W]*$", re.I)
_NUMBERED = re.compile(r"^\W*([0-9lIOSB]{1,4})(?:\s{2,}|\s*[·|•—–\-/]\s*|\s+)(\S.*)$|^(.*\S)(?:\s{2,}|\s*[·|•—–/]\s*|\s+-\s+|\s+)\[?([0-9lIOSB]{1,4})\]?\W*$")
_BLOCK = re.compile(r"^\s*(?:#|\||\$|\\|>?\s*[-*+•]\s|\d{1,3}[.)]\s+\S.{0,60}$|\*\*|©|ISBN|<t|\[\^?\d+\]:|!\[)")
_RULE = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,}|=+)\s*$")
_ENDS = frozenset("0123456789lIOSB]")
_DIGIT = str.maketrans("lIOoSsBZzgqi|", "1100558229911")
#: Capitals inside a word and signs come from wrong decodings, not from scanners.
_INNER = re.compile(r"[a-zà-ÿ][A-ZÀ-Þ]|[а-я][А-Я]")
_SIGN = re.compile(r"[^\w@$|!'’`\-¬\xad‐]|[¹²³ªº]|&#|\\")
_END = re.compile(r"[.!?…:»”\"')]\s*$")
_ODD = re.compile(r"[�\x80-\x9fÃÂ√├╨╤¤]|Ð|Ñ[\x80-\xbf‚ƒ„…†‡ˆ‰Š‹Œ]|â€|&#")


def _fold_table() -> dict[int, str]:
    """One folding table by rule: letters lose their accents, signs vanish, what scanners confuse falls together."""
    same = {x: g[0] for g in ("o0", "l1i|!", "a@", "s5$", "g9q", "ec", "tf", "hb68", "uv", "ни", "шщ", "оo0", "аa@", "еec", "рp", "хx", "уy", "сc") for x in g}
    table: dict[int, str] = {}
    for c in [*map(chr, range(0x21, 0x250)), *map(chr, range(0x400, 0x460)), *"ﬁﬂ’‘“”„–—…•·€™‐"]:
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        table[ord(c)] = "".join(same.get(x, x) for x in base if x.isalnum() or x in same)
    for c in "'’‘`´-.,;:()[]{}<>«»\"“”*_/\\#+=~^&%?…–— \t\xa0\xad¬‐·•":
        table[ord(c)] = ""
    return table


_FOLDED = _fold_table()


def key(s: str) -> str:
    """A text without case, accents and signs, in which what scanners confuse is the same, for fuzzy comparison."""
    s = s.lower()
    if "r" in s or "i" in s or "l" in s or "v" in s or "m" in s:
        s = s.replace("ú", "u").replace("ü", "u").replace("í", "i").replace("ì", "i").replace("iii", "rn").replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("ii", "u").replace("li", "u").replace("ll", "u").replace("vv", "w").replace("nn", "m")
    return s.translate(_FOLDED)


def alike(a: str, b: str, share: float = 0.8) -> bool:
    """Whether two keys agree in most of their letter pairs."""
    if a == b:
        return bool(a)
    if not a or not b or abs(len(a) - len(b)) > 0.3 * max(len(a), len(b)) or not (a[:2] == b[:2] or a[-2:] == b[-2:] or a[1:4] == b[1:4]):
        return False
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) >= share * (len(a) + len(b) - 2)


@dataclass
class Lexicon:
    """Words with their document counts; misread ones (rare beside a frequent word they may stand for) are left out."""

    docs: int
    df: dict[str, int]
    memo: dict[str, str | None] = field(default_factory=dict)
    paths: dict[tuple, list[tuple[int, int, str]] | None] = field(default_factory=dict)
    parts: dict[str, tuple[list[tuple[int, float]], list[tuple[int, float]]]] = field(default_factory=dict)
    links: dict[tuple, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.keys: dict[str, str] = {}
        for w in sorted(self.df, key=lambda w: (self.df[w], w)):
            self.keys[key(w)] = w

        self.words = sorted(self.df)
        self.beginnings = sorted(self.keys)

    def read(self, w: str, extra: dict[str, str]) -> str | None:
        """The known word that w is under confusions: one that folds alike, else the one of fewest single confusions."""
        if w in self.memo:
            got = self.memo[w]
        else:
            got = self.keys.get(key(w))
            if got is None or got == w:
                got = self.search(w)
            if len(self.memo) < 400_000:
                self.memo[w] = got
        return got if got else extra.get(key(w))

    def search(self, w: str, above: float = 0) -> str | None:
        """The known word (counted in more than `above` documents) that w turns into by fewest confusions, one in four
        letters but two at least. Only beginnings of known words are followed, through ranges of the sorted words."""
        bare = w.replace("'", "").replace("`", "")
        if bare != w and self.df.get(bare, 0) > above:
            return bare
        words, most = self.words, max(2, len(w) // 4)
        level = [(0, "", 0, len(words))]
        seen: set[tuple[int, str]] = set()
        for used in range(most + 1):
            later = []
            while level:
                at, done, lo, hi = level.pop()
                while True:
                    # confusions of what comes next wait for the next round, the plain letter goes on at once
                    if used < most and at < len(bare):
                        for wrong, right in _BY.get(bare[at], ()):
                            if bare.startswith(wrong, at) and (at + len(wrong), done + right) not in seen:
                                seen.add((at + len(wrong), done + right))
                                x, y = self._range(done + right, lo, hi)
                                if x < y:
                                    later.append((at + len(wrong), done + right, x, y))
                    if at == len(bare):
                        if used and words[lo] == done and self.df[done] > above:
                            return done
                        break
                    done += bare[at]
                    at += 1
                    lo, hi = self._range(done, lo, hi)
                    if lo >= hi:
                        break
            level = later
        return None

    def _range(self, start: str, lo: int, hi: int) -> tuple[int, int]:
        lo = bisect_left(self.words, start, lo, hi)
        return (lo, bisect_left(self.words, start + "\U0010ffff", lo, hi)) if lo < hi and self.words[lo].startswith(start) else (0, 0)

    def cost(self, w: str) -> float | None:
        """-log of the share of documents that have the word; short words next to nothing tell little."""
        n = self.df.get(w)
        return None if n is None else log((self.docs + 1) / (n + 0.5)) + (3.0 if len(w) < 3 else 0.0)

    def known(self, w: str) -> tuple[float, str] | None:
        """Cost and reading of a known word, as it stands or as one that folds alike."""
        c = self.cost(w)
        if c is not None:
            return c, w
        r = self.keys.get(key(w)) if len(w) > 3 else None
        return (self.cost(r) + CONFUSED, r) if r else None

    def goes_on(self, w: str) -> bool:
        """Whether a known word may begin as w does: the last letters may still fold together with what comes."""
        k = key(w)[:-3]
        i = bisect_left(self.beginnings, k)
        return i < len(self.beginnings) and self.beginnings[i].startswith(k)

    def cut(self, w: str) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """Where known words end from the left, and begin to the right, of a token: (characters before, cost of the words)."""
        if w in self.parts:
            return self.parts[w]
        n = len(w)
        left, right = [0.0] + [INF] * n, [INF] * n + [0.0]
        for a in range(n):
            for z in range(a + 1, n + 1):
                if (got := self.known(w[a:z])) is not None:
                    left[z] = min(left[z], left[a] + got[0] + (BETWEEN if a else 0.0))
                elif not self.goes_on(w[a:z]):
                    break
        for a in range(n - 1, -1, -1):
            for z in range(a + 1, n + 1):
                if right[z] < INF and (got := self.known(w[a:z])) is not None:
                    right[a] = min(right[a], right[z] + got[0] + (BETWEEN if z < n else 0.0))
        out = [(i, c) for i, c in enumerate(left) if c < INF and i < n], [(i, c) for i, c in enumerate(right) if c < INF and i]
        if len(self.parts) < 200_000:
            self.parts[w] = out
        return out

    def linked(self, a: str, b: str, cost: float) -> bool:
        """Whether a known word across the border of two tokens makes a cheaper path than their own `cost`, or may go on
        into a third one."""
        k = (a, b, round(cost, 3))
        if k in self.links:
            return self.links[k]
        got = False
        for i, x in self.cut(a)[0]:
            if self._range(a[i:] + b, 0, len(self.words)) != (0, 0) and a[i:] + b not in self.df:
                got = True
            for j, y in self.cut(b)[1]:
                if not got and x + y + OVER < cost and (w := self.known(a[i:] + b[:j])) is not None:
                    got = x + y + OVER + w[0] + (BETWEEN if i else 0.0) + (BETWEEN if j < len(b) else 0.0) < cost
            if got:
                break
        if len(self.links) < 400_000:
            self.links[k] = got
        return got


#: Costs of the lattice, in nats: an unknown word and each of its letters, a confusion, a space read over,
#: a line's end read over where no hyphen stood, a space put in, a hyphen at a line's end kept as a border of words.
UNKNOWN, PER_LETTER, CONFUSED, OVER, LOST, BETWEEN, KEPT = 9.0, 0.6, 4.0, 7.0, 11.0, 7.0, 3.0
INF = float("inf")


def token_cost(w: str, lex: Lexicon, reading: str | None = None) -> float:
    """Of a token as one word: known, read otherwise, or unknown."""
    c = lex.cost(w)
    if c is not None:
        return c - (3.0 if len(w) < 3 else 0.0)  # a short word that stands by itself is no chance piece
    u = UNKNOWN + PER_LETTER * len(w)
    r = lex.cost(reading) if reading else None
    return u if r is None else min(u, r + CONFUSED)


def decode(tokens: tuple[str, ...], hyphens: frozenset[int], lex: Lexicon, readings: tuple[str | None, ...] = (), broken: frozenset[int] = frozenset()) -> list[tuple[int, int, str]]:
    """The cheapest path through the characters of some tokens in a row, as (first character, behind the last, reading).

    `hyphens` holds the tokens behind which stood a hyphen and a line's end, `broken` a line's end alone; `readings` what a token is read as whole
    under confusions beyond those that fold alike. Positions count the tokens' characters without spaces.
    """
    s = "".join(tokens)
    ends, at = [], 0
    for t in tokens:
        at += len(t)
        ends.append(at)
    border = dict.fromkeys([0, *ends], 0.0)
    inside = {e: 0.0 if i in hyphens else LOST if i in broken else OVER for i, e in enumerate(ends[:-1])}
    border.update({ends[i]: KEPT for i in hyphens if i < len(ends) - 1})
    starts = dict(zip([0, *ends], tokens))
    whole = dict(zip([0, *ends], readings))
    best: list[tuple[float, int, str] | None] = [(0.0, 0, "")] + [None] * len(s)
    for p in range(len(s)):
        if best[p] is None:
            continue
        base = best[p][0] + border.get(p, BETWEEN)
        over = 0.0
        for q in range(p + 1, len(s) + 1):
            w = s[p:q]
            if q - 1 in inside and q - 1 > p:
                over += inside[q - 1]
            c, got = lex.known(w) or (None, w)
            if over and got != w:
                c += CONFUSED  # two errors in one word
            if p in starts and w == starts[p]:
                u = token_cost(w, lex, whole.get(p))
                if c is None or u < c:
                    c, got = u, w if w in lex.df else whole.get(p) or w
            if c is not None and (best[q] is None or base + over + c < best[q][0]):
                best[q] = (base + over + c, p, got)
            # no known word begins so, and the token's own edge lies behind
            if c is None and q - p >= len(starts.get(p, "")) and not lex.goes_on(w):
                break
    out, q = [], len(s)
    while q:
        _, p, w = best[q]
        out.append((p, q, w))
        q = p
    return out[::-1]


def build_lexicon(counts: list[tuple[str, int]], docs: int, least: int | None = None) -> Lexicon:
    """The lexicon from document counts: frequent words that are not misreadings of far more frequent ones."""
    least = least or floor_of(docs)
    df = {w: n for w, n in counts if n >= least}
    lex = Lexicon(docs, df)
    bad = []
    for w, n in df.items():
        if n < 0.02 * docs:
            got = lex.keys.get(key(w), w)
            if df[got] > 40 * n or lex.search(w, 40 * n):
                bad.append(w)
    for w in bad:
        del df[w]
    return Lexicon(docs, df)


def floor_of(docs: int) -> int:
    """Documents that must have a word for the lexicon: so it holds at most a document's mean distinct words / 0.0008."""
    return max(3, round(0.0008 * docs))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    docs = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*n.keys(), ""], pa.string()), pa.array([*n.values(), docs], pa.int64())], ["w", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            docs += 1
            if t:
                n.update(set(_WORD.findall(t.lower())))
        if len(n) > 400_000:
            yield out()
            n.clear()
            docs = 0
    yield out()


def lexicon(df: DataFrame, text_col: str) -> Lexicon:
    """Count the words of all texts by documents and keep those of enough documents (see floor_of, which bounds them)."""
    ship(df.sparkSession)
    arrow_rows(df.sparkSession, 1000)
    n = materialize(df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "sc-words")
    docs = int(n.where("w = ''").agg(F.sum("n")).first()[0] or 0)
    return build_lexicon([(r[0], r[1]) for r in n.where((F.col("w") != "") & (F.col("n") >= floor_of(docs))).orderBy("w").collect()], docs)


def _number(s: str) -> int | None:
    t = s.translate(_DIGIT)
    return int(t) if t.isdigit() and any(c.isdigit() for c in s) else None


_RV = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _roman(s: str) -> int | None:
    v = [_RV[c] for c in s.lower()]
    n = sum(-a if i + 1 < len(v) and a < v[i + 1] else a for i, a in enumerate(v))
    return n if n < 200 else None


def furniture(lines: list[str], title: str | None, author: str | None) -> dict[int, str]:
    """Line index -> header or page."""
    n = len(lines)
    pages: list[tuple[int, int, bool]] = []
    heads: list[tuple[int, str, int | None]] = []
    names = [k for k in (key(title or ""), key(author or "")) if len(k) > 3]
    fenced = False
    around = lambda i: any(_RULE.match(x) for x in lines[max(0, i - 2) : i] + lines[i + 1 : i + 3])
    for i, raw in enumerate(lines):
        s = raw.strip()
        if s.startswith("```"):
            fenced = not fenced
        if not s or fenced or len(s) > 160 or _RULE.match(s) or s[0] in "#|$>`\\" or s.startswith(("**", "©", "ISBN")):
            continue
        m = _PAGE.match(s) if len(s) < 20 else None
        if m and (num := _number(m.group(1))) is not None:
            pages.append((i, num, False))
            continue
        m = _ROMAN.match(s) if len(s) < 12 else None
        if m and (num := _roman(m.group(1))):
            pages.append((i, num, True))
            continue
        if len(s) > 110:
            continue
        core, num = s, None
        m = _NUMBERED.match(s) if s[0] in _ENDS or s[-1] in _ENDS else None
        if m:
            num = _number(m.group(1) or m.group(4))
            core = (m.group(2) or m.group(3)).strip()
        heads.append((i, core, num))
        if num is not None and core != s:
            heads.append((i, s, None))
    # numbers of a sequence: another page close by in the text has a number close by
    numbers = [(i, v, r) for i, v, r in pages] + [(i, v, False) for i, c, v in heads if v is not None]
    out: dict[int, str] = {}

    def follows(i: int, v: int, roman: bool) -> bool:
        return any(j != i and r == roman and 0 < (w - v) * (1 if j > i else -1) <= 4 and abs(j - i) >= 5 for j, w, r in numbers)

    for i, v, roman in pages:
        s = lines[i].strip()
        before = lines[i - 1].strip() if i else ""
        tail = before and not _END.search(before) and s.endswith(".")
        if not follows(i, v, roman) and (roman or tail or s[-1:] in ".)" or not (around(i) or not s.isdigit() or (i > 0 and not before and (i + 1 >= n or not lines[i + 1].strip())))):
            continue
        if tail and not around(i) and not follows(i, v, roman):
            continue
        if s.endswith(")") and "(" not in s:
            continue
        out[i] = "page"
    ks = [(i, key(c), c, v) for i, c, v in heads]
    seen = Counter(k for _, k, *_ in ks if len(k) > 2)
    firm: Counter = Counter()
    hit: dict[int, str] = {}
    for i, k, c, v in ks:
        if i in out or len(k) < 3:
            continue
        edge = i == 0 or around(i) or any(j in out for j in (i - 1, i - 2, i + 1, i + 2)) or i == n - 1
        named = any(alike(k, x) for x in names)
        listed = bool(re.match(r"\s*(?:[-*+•]|\d{1,3}[.)])\s", lines[i]))
        sentence = bool(re.search(r"[.?!…,;]$", c)) and not named
        if named and not listed and (len(k) > 4 or edge):
            hit[i] = k
            firm[k] += 1
        elif v is not None and c[:1].isalpha() and not sentence and not listed and follows(i, v, False) and len(c) < 90 and (c[0].isupper() or edge):
            hit[i] = k
            firm[k] += 1
        elif seen[k] >= 2 and not sentence and not listed and c[:1].isupper() and edge and v is None:
            hit[i] = k
            firm[k] += 1
    for i, k, c, v in ks:
        # misread repetitions of a head, and its repetitions off the page's edge
        if i not in hit and i not in out and len(k) > 5 and c[:1].isalnum() and any(alike(k, f) for f, m in firm.items() if m >= 2):
            hit[i] = k
    for i in hit:
        out[i] = "header"
    return out


def line_kinds(lines: list[str], page: dict[int, str]) -> list[str]:
    """blank, rule, code, block (headings, tables, lists, formulas, front matter), header, page or text."""
    kinds, fenced = [], False
    for i, x in enumerate(lines):
        s = x.strip()
        if s.startswith("```"):
            fenced = not fenced
            kinds.append("code")
        elif fenced:
            kinds.append("code")
        elif i in page:
            kinds.append(page[i])
        elif not s:
            kinds.append("blank")
        elif _RULE.match(s):
            kinds.append("rule")
        elif _BLOCK.match(x):
            kinds.append("block")
        else:
            kinds.append("text")
    return kinds


def analyse(text: str, title: str | None, author: str | None, lex: Lexicon, repair: bool = True) -> tuple[list[tuple[int, str]], str | None]:
    """The noisy lines as (line number, kind), and the text repaired into paragraphs."""
    lines = text.split("\n")
    # a page's line breaks show as lines that follow one another without a blank; else there is no furniture to look for
    broken = text.count("\n") - 2 * text.count("\n\n") > 5
    kinds = line_kinds(lines, furniture(lines, title, author) if broken else {})
    found = [(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page")]
    text_lines = [i for i, k in enumerate(kinds) if k == "text"]
    df = lex.df
    raw_count = Counter(TOKEN.findall("\n".join([lines[i] for i in text_lines])))
    # only words outside the lexicon matter from here on, and the document's own repeated ones among them
    strange = [(r, w, w.lower()) for r in raw_count if (r.lower() not in df) and (w := r.strip("'’‘`-¬\xad‐")) and w.lower() not in df]
    own: Counter = Counter()
    for r, _, low in strange:
        own[low] += raw_count[r]
    for w in _WORD.findall(f"{title or ''} {author or ''}".lower()):
        if w not in df and w not in own:
            own[w] = 2
    mine = {key(w): w for w, c in sorted(own.items(), key=lambda x: x[1]) if c >= 2 and len(w) > 3 and w.isalpha()}
    fixes: dict[str, str] = {}
    for r, w, low in strange:
        if w.isdigit() or (not _LETTER.search(w) and "@" not in w and "$" not in w) or _ODD.search(r):
            continue
        new = _fix(r, low, own, mine, lex)
        if new is not None:
            fixes[r] = new
    nxt = dict(zip(text_lines, text_lines[1:]))
    # misread borders of words are looked for where the page's lines are still there
    paged = any(j == i + 1 for i, j in nxt.items())
    open_ = {r for r, w, low in strange if (r in fixes or own[low] < 2 and low.isalnum() and not low.isdigit()) and not _ODD.search(r)} if paged else set()
    apart, marked = _reparted(lines, kinds, text_lines, open_, fixes, lex)
    fixed: dict[int, str] = {}
    joined_from: dict[int, tuple[str, str]] = {}
    for i in text_lines:
        line = lines[i]
        hyphen = None
        m = _HYPHEN.search(line) if line.rstrip()[-1:] in "-¬\xad‐" and i in nxt else None
        if m:
            left = TOKEN.findall(line)[-1:] or [""]
            right = TOKEN.findall(lines[nxt[i]])[:1] or [""]
            a, b = left[0].rstrip("-¬\xad‐ "), right[0]
            whole = (a + b).lower()
            if b and (b[0].islower() or b[0] in "0123456789@$") or m.group(2) != "-":
                compound = m.group(2) == "-" and f"{a}-{b}".lower() in df and whole not in df
                if not compound and not any(kinds[j] in ("block", "code") for j in range(i + 1, nxt[i])):
                    hyphen = (a, b)
                    found.append((i + 1, "hyphen"))
        moved = apart.get(i, {})
        bad = i in marked
        if moved or fixes and any(r in line for r in fixes):
            out, last = [], 0
            toks = list(TOKEN.finditer(line))
            for q, t in enumerate(toks):
                if t.start() in moved:
                    end, new = moved[t.start()]
                    out += [line[last : t.start()], new]
                    last = end
                elif t.start() < last:
                    continue
                elif t.group() in fixes and not (q == 0 and i in joined_from) and not (hyphen and q == len(toks) - 1) and line.count("`", 0, t.start()) % 2 == 0:
                    bad = True
                    out += [line[last : t.start()], _case(t.group(), fixes[t.group()])]
                    last = t.end()
            line = "".join(out) + line[last:]
        for a, b, here in ([(*joined_from[i], 1)] if i in joined_from else []) + ([(*hyphen, 0)] if hyphen else []):
            whole = (a + b).lower()
            if whole in df or own.get(whole, 0) >= 2 or _ODD.search(whole):
                continue
            new = _fix(a + b, whole, own, mine, lex)
            if new is None and a.isalpha() and b.isalpha() and len(path := decode((a.lower(), b.lower()), frozenset({0}), lex)) == 1:
                new = path[0][2]
            if new is not None:
                # the part that differs tells on which of the two lines the misread character stands
                first = next((z for z, (x, y) in enumerate(zip(whole, new)) if x != y), min(len(whole), len(new)))
                last_same = next((z for z, (x, y) in enumerate(zip(whole[::-1], new[::-1])) if x != y), 0)
                bad |= (first < len(a)) if not here else (len(whole) - last_same > len(a))
        if bad:
            found.append((i + 1, "chars"))
        fixed[i] = line
        if hyphen:
            joined_from[nxt[i]] = hyphen
            fixed[i] = line.rstrip()[:-1] + "\x00"
    return found, _paragraphs(lines, kinds, fixed) if repair else None


def _reparted(lines: list[str], kinds: list[str], text_lines: list[int], strange: set[str], fixes: dict[str, str], lex: Lexicon) -> tuple[dict[int, dict[int, tuple[int, str]]], set[int]]:
    """(line -> (start -> (end, reading)), lines with a misread word) where the cheapest path puts the borders of words
    elsewhere than the page does.

    The stream runs on over spaces, line ends and page furniture. Tokens outside the lexicon, with what each is read as
    under confusions, are decoded together with all neighbours to which a word across the border may lead.
    """
    out: dict[int, dict[int, tuple[int, str]]] = {}
    marked: set[int] = set()
    if not strange:
        return out, marked
    cut: dict[int, list[tuple[str, str, int, int]]] = {}
    at_line = {i: n for n, i in enumerate(text_lines)}

    def toks(i: int) -> list[tuple[str, str, int, int]]:
        if i not in cut:
            cut[i] = [(t.group(), t.group().lower(), t.start(), t.end()) for t in TOKEN.finditer(lines[i])]
        return cut[i]

    def word(t: tuple[str, str, int, int]) -> bool:
        return t[1].isalpha() or t[0] in strange

    def after(i: int, k: int) -> tuple[int, int] | None:
        """The next token of the stream, if only a space or a line's end parts it."""
        own = toks(i)
        if k + 1 < len(own):
            return (i, k + 1) if lines[i][own[k][3] : own[k + 1][2]] == " " else None
        n = at_line[i] + 1
        if lines[i][own[k][3] :].strip() or n >= len(text_lines):
            return None
        j = text_lines[n]
        between = kinds[i + 1 : j]
        if "block" in between or "code" in between or "blank" in between and not ("header" in between or "page" in between):
            return None
        more = toks(j)
        return (j, 0) if more and not lines[j][: more[0][2]].strip() else None

    def before(i: int, k: int) -> tuple[int, int] | None:
        if k:
            return (i, k - 1) if after(i, k - 1) else None
        n = at_line[i] - 1
        return (j, len(toks(j)) - 1) if n >= 0 and toks(j := text_lines[n]) and after(j, len(toks(j)) - 1) == (i, k) else None

    def tail(i: int, k: int) -> bool:
        """Whether a token is the rest of a word that a hyphen parts at the line's end; it is read with its beginning."""
        return not k and at_line[i] > 0 and bool(_HYPHEN.search(lines[text_lines[at_line[i] - 1]]))

    def usable(x: tuple[int, int]) -> bool:
        return word(toks(x[0])[x[1]]) and not tail(*x) and not lines[x[0]].count("`", 0, toks(x[0])[x[1]][2]) % 2

    def linked(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        a, b = ([toks(i)[k] for i, k in x] for x in (left, right))
        return lex.linked("".join(t[1] for t in a), "".join(t[1] for t in b), sum(token_cost(t[1], lex, fixes.get(t[0])) for t in a + b))

    done: set[tuple[int, int]] = set()
    for i in text_lines:
        if not any(u in lines[i] for u in strange):
            continue
        for k, t in enumerate(toks(i)):
            if t[0] not in strange or (i, k) in done or not usable((i, k)):
                continue
            span = [(i, k)]
            # a stretch ends behind the first known word, which no word across two borders may cross
            while (y := after(*span[-1])) and usable(y) and linked(span, [y]):
                span.append(y)
                if toks(y[0])[y[1]][0] not in strange:
                    break
            if (y := before(i, k)) and y not in done and usable(y) and linked([y], span):
                span.insert(0, y)
            done.update(span)
            ts = [toks(a)[b] for a, b in span]
            path = _path(tuple(x[1] for x in ts), tuple(fixes.get(x[0]) for x in ts), frozenset(n for n, (a, b) in enumerate(zip(span, span[1:])) if a[0] != b[0]), lex)
            if path is None:
                continue
            ends, n = [], 0
            for x in ts:
                n += len(x[1])
                ends.append(n)
            begin = [0, *ends[:-1]]
            lives = lambda p: next(q for q, e in enumerate(ends) if p < e)
            said: dict[int, list[str]] = {a: [] for a, _ in span}
            for p, q, w in path:
                m = lives(p)
                raw = ts[m][0]
                said[span[m][0]].append(_case(raw, w) if p == begin[m] or raw.isupper() else w)
                if w != "".join(x[1] for x in ts)[p:q] or p != begin[m]:
                    marked.add(span[m][0])
                for e, a, b in zip(ends, span, span[1:]):
                    if p < e < q and a[0] == b[0]:
                        marked.add(a[0])
            for a in said:
                mine = [x for (c, _), x in zip(span, ts) if c == a]
                out.setdefault(a, {})[mine[0][2]] = (mine[-1][3], " ".join(said[a]))
    return out, marked


def _path(tokens: tuple[str, ...], readings: tuple[str | None, ...], broken: frozenset[int], lex: Lexicon) -> list[tuple[int, int, str]] | None:
    """The decoded path if it parts the characters otherwise than the tokens do and leaves no unknown word in what it changes."""
    k = tokens, readings, broken
    if k in lex.paths:
        return lex.paths[k]
    path = decode(tokens, frozenset(), lex, readings, broken)
    as_is, n = {}, 0
    for t, r in zip(tokens, readings):
        as_is[n, n + len(t)] = (t, r)
        n += len(t)
    moved = any((p, q) not in as_is for p, q, _ in path)
    got = path if moved and all(w in lex.df or w in as_is.get((p, q), ()) for p, q, w in path) else None
    if len(lex.paths) < 200_000:
        lex.paths[k] = got
    return got


def _bare(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def _case(raw: str, new: str) -> str:
    if raw.isupper() and len(raw) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if raw[:1].isupper() else new


def _fix(raw: str, low: str, own: Counter, mine: dict[str, str], lex: Lexicon) -> str | None:
    """What a word outside the lexicon should read, or None if it is no misreading."""
    df = lex.df
    letters = low.isalpha()
    if (letters and len(low) < 4) or _INNER.search(raw) or _SIGN.search(low):
        return None
    parts = re.split(r"[-’']", low)
    if len(parts) > 1 and all(p in df or p.isdigit() or not p or own.get(p, 0) >= 2 for p in parts):
        return None
    if re.fullmatch(r"\d+\W*(?:st|nd|rd|th|er|e|o|a|º|ª|ᵉ|°|x|km|mb|kb|s|de|%|€|£|\$)?|[£€$]\d+|n[.º°]*\d*|[ivxlcdm]+|\w", low):
        return None
    if not letters and re.search(r"\d{2,}", low) and sum(c.isdigit() for c in low) * 2 >= len(low):
        return None
    seen = own.get(low, 0)
    if letters and seen >= 2 and raw[:1].isupper() and mine.get(key(low)) == low and key(low) not in lex.keys:
        return None  # a name that the document repeats
    got = lex.read(low, mine)
    if got is None and len(parts) > 1:
        new = [p if p in df or not p else lex.read(p, mine) for p in parts]
        if all(new):
            seps = re.findall(r"[-’']", low)
            got = "".join(x + y for x, y in zip(new, [*seps, ""]))
            if got == low:
                got = None
    if got is None or got == low or (letters and _bare(got) == _bare(low)):
        return None
    if letters and (seen >= 3 or (seen >= 2 and raw[:1].isupper())) and got not in df:
        return None
    if letters and raw[:1].isupper() and raw[1:].islower() and got in df and seen >= 2:
        return None
    if letters and got not in df and own.get(got, 0) < 2 * seen:
        return None
    return got


LONG = 24  # lines of a paragraph that are told apart


def _paragraphs(lines: list[str], kinds: list[str], fixed: dict[int, str]) -> str:
    """Lines joined into paragraphs: each break costs by how little the lines around it look like an end and a start, and by
    the length of the paragraph that it ends."""
    body = [i for i, k in enumerate(kinds) if k in ("text", "block", "code")]
    if not body:
        return ""
    lens = sorted(len(lines[i]) for i in body if kinds[i] == "text")
    width = lens[int(0.9 * (len(lens) - 1))] if lens else 0
    wrapped = bool(lens) and width < 130 and len(lens) > 5
    # a state is the number of lines of the paragraph so far, LONG for that many or more
    best: list[float] = [0.0, *[INF] * (LONG - 1)]
    back: list[list[int]] = []
    for p, i in zip(body, body[1:]):
        between = kinds[p + 1 : i]
        s = fixed.get(p, lines[p]).rstrip()
        end = bool(_END.search(s))
        if kinds[p] != "text" or kinds[i] != "text":
            join, part = 50.0, 0.0
        else:
            t = fixed[i].lstrip()
            low = t[:1].islower() or s.endswith("\x00")
            blank, page = "blank" in between, any(k in ("header", "page", "rule") for k in between)
            join = (0 if not blank else 2 if page else 6) + (3 if end and len(s) < 0.8 * width else 0) + (0 if wrapped else 4)
            part = (0 if blank and not page else 4) + (0 if end else 4) + (8 if low else 0) + (3 if wrapped and len(s) > 0.9 * width else 0)
            if s.endswith("\x00"):
                part += 50
        # a wrapped paragraph seldom has one line, least one that fills the width; a very long one seldom goes on behind a stop
        alone = 3.0 if wrapped and kinds[p] == "text" and len(s) > 0.6 * width else 0.0
        ends_here = [best[n] + part + (alone if n == 0 else 0.0) for n in range(LONG)]
        first = min(range(LONG), key=ends_here.__getitem__)
        step, new = [first], [ends_here[first]]
        for n in range(1, LONG):
            came = n - 1 if n < LONG - 1 or best[n - 1] <= best[n] else n
            new.append(best[came] + join + (2.0 if came == LONG - 1 and end else 0.0))
            step.append(came)
        best = new
        back.append(step)
    n = min(range(LONG), key=best.__getitem__)
    goes = []
    for step in reversed(back):
        goes.append(n > 0)
        n = step[n]
    back = goes[::-1]
    out = [fixed.get(body[0], lines[body[0]])]
    for (p, i), go in zip(zip(body, body[1:]), back):
        x = fixed.get(i, lines[i])
        if not go:
            same = kinds[p] == kinds[i] and kinds[i] in ("block", "code") and i == p + 1
            out.append(("\n" if same else "\n\n") + x)
        elif out[-1].endswith("\x00"):
            out[-1] = out[-1][:-1]
            out.append(x.lstrip())
        else:
            out[-1] = out[-1].rstrip()
            out.append(" " + x.lstrip())
    return "".join(out).replace("\x00", "")


def _rows(batches: Iterator[pa.RecordBatch], lex: Lexicon, repair: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lists, texts = b.column(0).to_pylist(), [], []
        for t, title, author in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            f, new = analyse(t, title, author, lex, repair) if t else ([], t)
            lists.append([{"line_no": n, "kind": k} for n, k in sorted(set(f))])
            texts.append(new)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lists, pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))), pa.array(texts, pa.string())], ["id", "noise", "text"])


def scan_noise(df: DataFrame, lex: Lexicon, id_col: str, text_col: str, title_col: str | None = None, author_col: str | None = None, repair: bool = True) -> DataFrame:
    """(id, noise array of (line_no, kind), text): noisy lines and repaired text of every row, where it lies.

    Null and empty texts come out unchanged with no noise; repeated rows give repeated results, an empty table none.
    """
    ship(df.sparkSession)
    arrow_rows(df.sparkSession, 500)
    opt = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"), opt(title_col).alias("h"), opt(author_col).alias("a"))
    return src.mapInArrow(lambda it: _rows(it, lex, repair), "id string, noise array<struct<line_no:int,kind:string>>, text string")
