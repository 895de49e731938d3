"""Per-document text statistics and the kind of a text: prose, list, table or junk.

Tables show as a vertical alignment of delimiters: the same number of tabs, bars, commas or semicolons in most lines, or
gaps of spaces that start at the same columns; rows of one padded width have line lengths that go together. Lists show as
lines that are each an entry: item marks, lines broken before their width is used, entries that all hold numbers or
many signs, an indentation that comes back every few lines, line lengths that alternate. Wrapped prose speaks against a
list: the next line's first word would not have fitted. These measures are added up with the word, symbol, digit and
punctuation ratios (fixed weights below). Junk shows in its characters: letters in an order that no language has, signs
instead of letters, letters mixed with digits, or the same thing over and over. No list of known words decides, so prose
of a language without samples remains prose.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import arrow_rows, discard, materialize, ship

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MARK = re.compile(r"\s*(?:[-*•·+‣▪◦●○■□✓→>]+(?=\s)|\d{1,3}(?:\.\d{1,3})*[.)\]]?(?=\s)|[A-Za-zА-Яа-я][.)](?=\s)|\(\w{1,3}\)(?=\s)|[ivxlcIVXLC]+[.)](?=\s)|\[[ xX\d]*\]|#{1,6}(?=\s)|§)")
_SPEECH = re.compile(r"\s*[—–―]")
_ENDS = frozenset(".!?…:»”\"')]")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_STOP = re.compile(r"[.!?…]+[\s»”\"')]*")
STATS = "n_chars long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, digit_ratio double, end_punct_ratio double, common_word_ratio double, distinct_word_ratio double, mark_ratio double, align_ratio double, fill_ratio double, length_autocorr double, repeat_ratio double, indent_period double, number_lines double, sign_lines double, short_lines double, start_ratio double, letter_order double, mixed_ratio double"
NAMES = [x.split()[0] for x in STATS.split(", ")]

#: Letters are told apart without accents; 0 parts words, 1 is any letter of a script without samples.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_LETTERS = _LATIN + _CYRILLIC
#: Classes of characters: blank, letter, digit, sign, end of line.
_BLANK, _LETTER, _DIGIT, _SIGN, _LINE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letter, sort = np.zeros(1 << 16, np.uint8), np.full(1 << 16, _SIGN, np.uint8)
    place = {c: i + 2 for i, c in enumerate(_LETTERS)}
    for o in range(1 << 16):
        c = chr(o)
        if c.isalpha():
            letter[o] = place.get(unicodedata.normalize("NFD", c.lower())[0], 1)
            sort[o] = _LETTER
        elif c.isspace():
            sort[o] = _LINE if c == "\n" else _BLANK
        elif "0" <= c <= "9":
            sort[o] = _DIGIT
    return letter, sort


_TABLE, _SORT = _tables()
_SIZE = 64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-16-le", "replace"), np.uint16)


@dataclass
class Language:
    """What clean samples say of any language: how much likelier than by chance each letter follows another, in bits, and
    the words that are common."""

    order: np.ndarray
    known: np.ndarray
    common: frozenset[str]

    def letter_order(self, codes: np.ndarray) -> float:
        """Mean bits by which the letters of a text follow one another as in language; 0 without known letters."""
        x = _TABLE[codes].astype(np.int16)
        at = x[:-1] * _SIZE + x[1:]
        n = int(np.count_nonzero(self.known[at]))
        return float(self.order[at].sum()) / n if n else 0.0


#: A common word is at least every COMMON-th word of the samples, so there are at most that many, and stands there twice.
COMMON, LEAST = 100_000, 2


def _tally(texts: Iterable[str]) -> tuple[Counter, np.ndarray]:
    """Occurrences of the words of some texts, and of each pair of letters."""
    n: Counter = Counter()
    pair = np.zeros(_SIZE * _SIZE, np.int64)
    for t in texts:
        n.update(WORD.findall(t.lower()))
        x = _TABLE[_codes(t)].astype(np.int64)
        pair += np.bincount(x[:-1] * _SIZE + x[1:], minlength=_SIZE * _SIZE)
    return n, pair


def learn(texts: Iterable[str]) -> Language:
    """Letter order and common words of clean texts."""
    n, pair = _tally(texts)
    least = _floor(sum(n.values()))
    return _language(pair, (w for w, c in n.items() if c >= least))


def _floor(total: int) -> int:
    return max(LEAST, -(-total // COMMON))


def _language(pairs: np.ndarray, common: Iterable[str]) -> Language:
    pair = pairs.reshape(_SIZE, _SIZE).astype(float)
    order, known = np.full((_SIZE, _SIZE), -2.0), np.ones((_SIZE, _SIZE), bool)
    for first, size in ((2, len(_LATIN)), (2 + len(_LATIN), len(_CYRILLIC))):  # by chance among the letters of one script
        own = np.r_[0, first : first + size]
        p = pair[np.ix_(own, own)].copy()
        p[0, 0] = 0
        chance = np.outer(p.sum(1), p.sum(0)) / max(1.0, p.sum())
        order[np.ix_(own, own)] = np.clip(np.log2((p + 0.5 * np.minimum(chance, 1) + 0.02) / (chance + 0.5)), -4, 4)
    known[1] = known[:, 1] = known[0, 0] = False
    known[2 + len(_LETTERS) :] = known[:, 2 + len(_LETTERS) :] = False
    order[~known] = 0
    return Language(order.astype(np.float32).ravel(), known.ravel(), frozenset(common))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, pair, n): counts of words, pair -1, and of pairs of letters, word null."""
    for b in batches:
        n, pair = _tally(b.column(0).to_pylist())
        at = np.flatnonzero(pair)
        yield pa.RecordBatch.from_arrays([pa.array([*n, *[None] * len(at)], pa.string()), pa.array([-1] * len(n) + at.tolist(), pa.int32()), pa.array([*n.values(), *pair[at].tolist()], pa.int64())], ["word", "pair", "n"])


def language(samples: DataFrame, text: str = "text") -> Language:
    """Learn from all rows of a table of clean texts, counted on the cluster; the pairs of letters and the common words, at
    most COMMON, come to the driver."""
    ship(samples.sparkSession)
    arrow_rows(samples.sparkSession, 2000)
    src = samples.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    n = materialize(src.mapInArrow(_tallies, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")), "ql-tally")
    pair = np.zeros(_SIZE * _SIZE, np.int64)
    for r in n.where("word IS NULL").collect():
        pair[r["pair"]] = r["n"]
    least = _floor(n.where("word IS NOT NULL").agg(F.sum("n")).first()[0] or 0)
    common = [r[0] for r in n.where((F.col("word").isNotNull()) & (F.col("n") >= least)).select("word").collect()]
    discard(n)
    return _language(pair, common)


# measures


def alignment(text: str, lines: list[str]) -> float:
    """Share of lines in the best vertical alignment of any delimiter."""
    best, n = 0.0, len(lines)
    if n < 2:
        return float(n == 1 and (lines[0].count("\t") >= 2 or lines[0].count("|") >= 3))
    for d in ("\t", "|", "│", ";", ",", "<td", "&"):
        if d not in text:
            continue
        c: Counter = Counter()
        for x in lines:
            if d in x:
                k = x.count(d)
                if d in ",;":
                    y = x.rstrip(",; ") if d == ";" else x
                    if y.count(d + " ") or (k := y.count(d)) < 1 and d == ";":
                        continue
                c[k] += 1
        if c:
            most, count = c.most_common(1)[0]
            if most >= 1:
                best = max(best, sum(c.values()) / n if d in "\t│|" or d == "<td" else count / n)
    gaps: Counter = Counter()
    with_gap = 0
    for x in lines if "  " in text else []:
        g = [m.end() for m in _GAP.finditer(x)]
        with_gap += bool(g)
        gaps.update(set(g))
    if with_gap >= 2:
        cols = [k for k, v in gaps.items() if v >= 0.3 * with_gap]
        if cols:
            best = max(best, with_gap / n)
    return best


def autocorrelation(v: np.ndarray, lag: int) -> float:
    """Of a series with itself `lag` places on; 1 for a constant series, 0 for one too short."""
    if len(v) < lag + 2:
        return 0.0
    d = v - v.mean()
    var = float((d * d).sum())
    return float((d[:-lag] * d[lag:]).sum() / var * len(v) / (len(v) - lag)) if var else 1.0


def periodicity(text: str) -> float:
    """How regularly the indentation comes back: the best autocorrelation of the lines' indents (blank lines below all)
    over 2 to 6 lines, less that of the next line; 0 where no line is indented."""
    if "\n " not in text and "\n\t" not in text:
        return 0.0
    ind = np.array([len(x) - len(s) if (s := x.lstrip()) else -2 for x in text.split("\n")], float)
    if len(ind) < 6 or ind.max() <= 0 or ind.min() == ind.max():
        return 0.0
    return max(0.0, max(autocorrelation(ind, k) for k in range(2, 7)) - max(0.0, autocorrelation(ind, 1)))


def measure(text: str, lang: Language) -> tuple[list, str]:
    """The statistics in the order of STATS, and the kind."""
    n = len(text)
    found = WORD.findall(text)
    nw = len(found)
    low = [w.lower() for w in found]
    codes = _codes(text)
    sort = _SORT[codes]
    counts = np.bincount(sort, minlength=5).tolist()
    letters, digits, signs = counts[_LETTER], counts[_DIGIT], counts[_SIGN]
    dense = letters + digits + signs
    alnum = (sort == _LETTER) | (sort == _DIGIT)
    runs = int(np.count_nonzero(alnum[1:] & ~alnum[:-1]))
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    nl = len(lines)
    size = np.array([len(x) for x in lines], float)
    width = int(size.max()) if nl else 0
    numbered = signed = 0
    if nl:
        starts = np.r_[0, np.flatnonzero(sort == _LINE)]
        digit_of, sign_of = (np.add.reduceat(sort == k, starts, dtype=np.int32) for k in (_DIGIT, _SIGN))
        full = np.diff(np.r_[starts, len(sort)])
        numbered, signed = int(np.count_nonzero((digit_of > 0) & (full <= ENTRY))), int(np.count_nonzero((sign_of > 0) & (sign_of >= 0.1 * (full - 1))))
    # lines that could not have taken the next line's first word: wrapped at a fixed width
    fits = [s + 1 + len(y.split(None, 1)[0]) > width - 1 for s, y in zip(size.tolist(), lines[1:])] if width >= 30 else []
    marks = [bool(_MARK.match(x)) and not _SPEECH.match(x) for x in lines]
    units = [u for u in (x.strip() for x in (_STOP.split(text) if nl < 4 else lines)) if u]
    marked = 0.0
    if sum(marks) >= 2:
        marked = sum(z for z, m in zip(size, marks) if m) + sum(size[i] for i in range(1, nl) if not marks[i] and any(marks[max(0, i - 3) : i]) and lines[i][:1] == " ")
    s = {
        "n_chars": n,
        "n_words": nw,
        "n_lines": nl,
        "mean_word_length": sum(map(len, found)) / nw if nw else 0.0,
        "symbol_ratio": signs / n if n else 0.0,
        "digit_ratio": digits / n if n else 0.0,
        "end_punct_ratio": sum(x[-1] in _ENDS for x in lines) / nl if nl else 0.0,
        "common_word_ratio": sum(map(lang.common.__contains__, low)) / nw if nw else 0.0,
        "distinct_word_ratio": len(set(low)) / nw if nw else 0.0,
        # by their length, with the unmarked rest that is indented below a mark
        "mark_ratio": float(marked / size.sum()) if nl else 0.0,
        "align_ratio": alignment(text, lines) if nl else 0.0,
        "fill_ratio": sum(fits) / len(fits) if fits else 0.0,  # nothing is set narrower than 30
        "length_autocorr": autocorrelation(size, 1) if nl > 2 else 0.0,
        "repeat_ratio": 1 - len(set(units)) / len(units) if units else 0.0,
        "indent_period": periodicity(text),
        "number_lines": min(1.0, numbered / nl) if nl else 0.0,
        "sign_lines": min(1.0, signed / nl) if nl else 0.0,
        # by their length, so that a short list inside a text is a small share of it
        "short_lines": sum(len(x) for x in lines if len(x) < 64 and x[-1] not in ".!?…" and not _SPEECH.match(x)) / float(size.sum()) if nl else 0.0,
        # beyond the quarter of lines that may open alike by chance
        "start_ratio": max(0.0, max(Counter(x[:4] for x in lines if x[-1] not in ".!?…" or not _SPEECH.match(x)).values(), default=0) / nl - 0.25) / 0.75 if nl > 3 else 0.0,
        "letter_order": lang.letter_order(codes),
        "mixed_ratio": min(1.0, float(np.count_nonzero(alnum[1:] & alnum[:-1] & (sort[1:] != sort[:-1]))) / runs) if runs and digits else 0.0,
    }
    return list(s.values()), kind(s, low, letters / dense if dense else 0.0, digits / dense if dense else 0.0)


#: Weights of the measures in the sum from which on (1) the lines are entries of a list; the second group counts by the
#: share of lines that were not wrapped at a width.
BY_SHAPE = {"mark_ratio": 1.4, "start_ratio": 1.2, "indent_period": 1.1}
BY_LINE = {"short_lines": 1.45, "number_lines": 1.15, "sign_lines": 1.45}
#: A line with a number is an entry up to this length.
ENTRY = 200
NUMBERS_AND_SIGNS, ALTERNATE, ENDS, PADDED = 0.7, 0.3, -0.2, 0.15


def entries(s: dict) -> float:
    """How far the lines are entries: marks, indentation, shortness, numbers and signs, alternating lengths, full stops."""
    if s["n_lines"] < 2:
        return 0.0
    lines = sum(w * s[k] for k, w in BY_LINE.items()) if s["n_lines"] > 2 else 0.0
    if s["n_lines"] > 3:
        lines += ALTERNATE * max(0.0, -s["length_autocorr"])
    both = NUMBERS_AND_SIGNS * min(s["number_lines"], s["sign_lines"]) if s["n_lines"] > 2 else 0.0
    return sum(w * s[k] for k, w in BY_SHAPE.items()) + both + (1 - s["fill_ratio"]) * (lines + ENDS * s["end_punct_ratio"])


def kind(s: dict, low: list[str], letters: float, digits: float) -> str:
    """prose, list, table or junk, from the statistics, the words in lower case and the shares of letters and digits."""
    nw, nl = s["n_words"], s["n_lines"]
    if not nl:
        return "junk"
    # signs instead of letters, or letters mixed with digits
    if letters + digits < 0.3 or s["mixed_ratio"] >= 0.2 or s["symbol_ratio"] >= 0.3 and nw > 2 and s["mean_word_length"] < 2:
        return "junk"
    # the same thing over and over
    if nw >= 8 and s["distinct_word_ratio"] < 0.34:
        three = list(zip(low, low[1:], low[2:]))
        if len(set(three)) < 0.2 * len(three):
            return "junk"
    if s["repeat_ratio"] > 0.7 and nl >= 4 and nw >= 4 and s["distinct_word_ratio"] < 0.3:
        return "junk"
    # columns: aligned delimiters, or rows padded to one length beside loosely aligned ones
    if s["align_ratio"] + PADDED * (nl > 3 and s["length_autocorr"] > 0.99) >= 0.6 and nw >= 2:
        return "table"
    if nw >= 3 and s["letter_order"] < -0.2:
        return "junk"
    return "list" if entries(s) >= 1 else "prose"


def _rows(batches: Iterator[pa.RecordBatch], lang: Language) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [measure(t or "", lang) for t in b.column(1).to_pylist()]
        cols = list(zip(*(g[0] for g in got))) or [[]] * len(NAMES)
        kinds = [pa.int64()] * 3 + [pa.float64()] * (len(NAMES) - 3)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array([g[1] for g in got], pa.string())], ["id", *NAMES, "kind"])


def quality(df: DataFrame, lang: Language, id_col: str, text_col: str) -> DataFrame:
    """(id, statistics of STATS, kind) of every row, where it lies: no shuffle.

    A null or empty text has zero counts and the kind junk; null ids are kept. Repeated rows give repeated results, an
    empty table none; other columns of df are not read.
    """
    ship(df.sparkSession)
    arrow_rows(df.sparkSession, 2000)
    copy = df.sparkSession.sparkContext.broadcast(lang)  # letters and at most COMMON words
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(lambda it: _rows(it, copy.value), f"id {dict(src.dtypes)['id']}, {STATS}, kind string")
