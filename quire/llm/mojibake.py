"""Text read in a wrong character encoding: found and restored as a substitution cipher.

A symbol of the cipher is a character outside ASCII, or a sequence of them that one letter becomes in some code-page
swap. Which letter a symbol stands for, or that it stands for itself, is learned by expectation-maximisation: the E-step
weighs every letter by the bigrams it would form with its neighbours in clean language, the M-step re-estimates each
symbol's letter distribution from the expected counts. Code pages only shape the prior; other mappings are learned from
the data. The statistics are counts of (left, symbol, right) over all rows, bounded by the character inventory. Whole
runs of foreign letters are also weighed as the image of one swap, whose table is then applied with translate().

Swaps that no list holds are learned per source. A source is what was garbled alike: the texts whose most frequent symbol
out of place (one that no clean text has, or a letter of another script within a word) is the same. Each source has its
own byte-to-letter mapping, learned by the same EM from a flat prior and made one-to-one; a text is read through its
source's mapping, applied with translate(), where that makes it likelier than all else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.langid import GARBLES
from quire.session import arrow_rows, ship

#: Right characters of the languages and of book texts beyond those of the clean samples.
RIGHT = "áéíóúüñÁÉÍÓÚÜÑàâçèêëîïôùûœæÀÂÇÈÊËÎÏÔÙÛŒÆäößÄÖãõÃÕìòÌÒ¿¡«»‘’“”„–—…·ºª°©®€£§№•€™×½¼¾±µ" + "".join(map(chr, range(0x410, 0x450))) + "ёЁ"
#: What stays out of the search: quoted code and markers of unreadable glyphs.
QUOTED = r"`[^`\n]*`|⟦\?[^⟧]*⟧"
#: A run of characters outside ASCII with its neighbours; soft hyphens and no-break spaces alone are typography.
RUN = r"[\x21-\x7E]?[^\x00-\x7F]+(?:[\x21-\x7E][^\x00-\x7F]+)*[\x21-\x7E]?"
_QUOTED, _RUN, _FOREIGN = re.compile(QUOTED), re.compile(RUN), re.compile(r"[^\x00-\x7F]")
_CYRILLIC = re.compile("[а-яё]{3}")
_ENTITY = re.compile(r"&#(1[2-9]\d|2\d\d|\d{4,5});")
_PLAIN = frozenset("\xa0\xad‐ ​﻿")


def _class(c: str) -> int:
    if c in " \n\t\xa0\xad":
        return 0
    if c.isdigit():
        return 1
    if c.isalpha() and c not in "ªº":
        o = ord(c)
        if o < 0x250:
            return 2 if c.islower() else 3
        if 0x410 <= o <= 0x44F or c in "ёЁ":
            return 4 if c.islower() else 5
        return 6
    if c in ".,;:!?)]}»”’…":
        return 7
    if c in "([{«“‘¿¡—–-'\"/*_#|`":
        return 8
    return 9


def _wrong(c: str, was: str, read: str) -> str | None:
    try:
        raw = c.encode(was)
    except UnicodeEncodeError:
        return None
    out = "".join((bytes([b]).decode(read, "ignore") or chr(b)) for b in raw)
    return out if out != c else None


@dataclass
class Cipher:
    """A bigram model of clean text and, per symbol, the learned letter distribution (column 0: it stands for itself)."""

    letters: list[str]
    logb: np.ndarray
    table: dict[str, dict[str, float]]
    swaps: list[dict[int, str]]
    known: frozenset[str]
    index: dict[str, int] = field(default_factory=dict)
    units: dict[str, int] = field(default_factory=dict)
    logpi: np.ndarray | None = None
    memo: dict[str, tuple[bool, str]] = field(default_factory=dict)
    odd: dict[str, str] = field(default_factory=dict)
    sources: dict[str, dict[int, str]] = field(default_factory=dict)
    mappings: list[dict[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.longest = max((len(u) for u in self.table), default=1)

    def at(self, c: str) -> int:
        """Row of a character in the bigram table; characters never seen share their class's row."""
        return self.index.get(c, len(self.index) + _class(c))

    def segment(self, run: str) -> list[str]:
        out, i = [], 0
        while i < len(run):
            if run[i] < "\x80":
                out.append(run[i])
                i += 1
                continue
            for n in range(min(self.longest, len(run) - i), 0, -1):
                u = run[i : i + n]
                if n == 1 or u in self.table:
                    out.append(u)
                    i += n
                    break
        return out

    def prior(self, u: str) -> np.ndarray:
        p = np.full(len(self.letters) + 1, 1e-7)
        own = 0.9998 if u in self.known else 0.5 if len(u) == 1 else 0.05
        if u == "�" or len(u) == 1 and "\x80" <= u < "\xa0":
            own = 1e-9
        hints = self.table.get(u, {})
        p[0] = own
        for c, w in hints.items():
            if c in self.known:
                p[1 + self.index[c]] += (1 - own) * 0.9 * w / sum(hints.values())
        # a right character may only stand for what a code page makes of it, any other symbol for every letter
        if u in self.known or len(u) > 1 and hints:
            p[1:] = np.where(p[1:] > 2e-7, p[1:], 1e-40)
        else:
            p[1:] += (1 - own) * (0.001 if hints else 0.1) / len(self.letters)
        return p / p.sum()

    def open(self, left: str, u: str, right: str) -> bool:
        """Whether a symbol can be in question where it stands: signs between words and letters of whole foreign runs cannot."""
        if len(u) > 1 or "\x80" <= u < "\xa0":
            return True
        k = _class(u)
        if k in (4, 5, 6):
            return False
        if k == 3 and u in self.known and not left.isalpha():
            return False  # a capital that opens a word
        if k in (2, 3):
            return left.isalpha() or right.isalpha()
        return left.isalpha() and right.isalpha() and u not in "’‘…—–" and not left.isdigit()

    def self_score(self, left: str, u: str, right: str) -> float:
        s = left + u + right
        return float(sum(self.logb[self.at(a), self.at(b)] for a, b in zip(s, s[1:])))

    def weigh(self, left: str, u: str, right: str) -> np.ndarray:
        """log weights of (itself, each letter) for a symbol between two characters."""
        n = len(self.letters)
        w = np.empty(n + 1)
        w[0] = self.self_score(left, u, right)
        w[1:] = self.logb[self.at(left), :n] + self.logb[:n, self.at(right)]
        return w + (self.logpi[self.units[u]] if u in self.units else np.log(self.prior(u)))

    def fit(self, triples: Iterable[tuple[str, str, str, int]], rounds: int = 5) -> None:
        """EM over the counted (left, symbol, right) of all sources."""
        rows = [t for t in triples if t[1]]
        self.units = {u: i for i, u in enumerate(sorted({t[1] for t in rows}))}
        self.logpi = self._em(rows, self.units, np.stack([self.prior(u) for u in self.units]), rounds, 20.0) if rows else np.zeros((0, len(self.letters) + 1))

    def _em(self, rows: list[tuple[str, str, str, int]], units: dict[str, int], prior: np.ndarray, rounds: int, weight: float) -> np.ndarray:
        logpi = np.log(prior)
        n = len(self.letters)
        u = np.array([units[t[1]] for t in rows])
        count = np.array([t[3] for t in rows], float)
        own = np.array([self.self_score(t[0], t[1], t[2]) for t in rows])
        for _ in range(rounds):
            best = logpi.argmax(1)
            name = {s: (s[-1] if best[i] == 0 else self.letters[best[i] - 1]) for s, i in units.items()}
            left = np.array([self.at(name.get(t[0], t[0])) for t in rows])
            right = np.array([self.at(name.get(t[2], t[2])) for t in rows])
            stat = np.zeros_like(prior)
            for i in range(0, len(rows), 20_000):
                s = slice(i, i + 20_000)
                w = np.empty((len(u[s]), n + 1))
                w[:, 0] = own[s]
                w[:, 1:] = self.logb[left[s], :n] + self.logb[:n, right[s]].T
                w += logpi[u[s]]
                w = np.exp(w - w.max(1, keepdims=True))
                np.add.at(stat, u[s], w / w.sum(1, keepdims=True) * count[s, None])
            pi = stat + weight * prior
            logpi = np.log(pi / pi.sum(1, keepdims=True))
        return logpi

    def out_of_place(self, left: str, c: str, right: str) -> bool:
        """Whether no clean text has the symbol, or not where it stands: another script's letter beside an ASCII one, a sign
        within a word."""
        if not c.isalpha():
            return c not in self.known and left.isalpha() and right.isalpha() or "\x80" <= c < "\xa0"
        if c not in self.known:
            return True
        return _class(c) in (4, 5) and (left.isascii() and left.isalpha() or right.isascii() and right.isalpha())

    def alone(self, run: str) -> list[tuple[str, str, str]]:
        """(left, character, right) of the characters that are no part of a sequence which a listed swap makes of one letter."""
        units = [" ", *self.segment(run), " "]
        out = [(a[-1], c, b[0]) for a, c, b in zip(units, units[1:], units[2:]) if len(c) == 1 and c >= "\x80" and c not in _PLAIN]
        # letters of other scripts among themselves are running text, or a case for whole runs
        return [x for x in out if _class(x[1]) not in (4, 5, 6) or self.out_of_place(*x)]

    def source(self, runs: list[str]) -> str:
        """The most frequent symbol out of place in a text's runs; '' if there is none."""
        n: Counter = Counter()
        for k in runs:
            odd = self.odd.get(k)
            if odd is None:
                odd = "".join(c for a, c, b in self.alone(k) if self.out_of_place(a, c, b))
                if len(self.odd) < 300_000:
                    self.odd[k] = odd
            if odd:
                n.update(odd)
        return max(n, key=lambda c: (n[c], c)) if n else ""

    def fit_sources(self, counts: Iterable[tuple[str, str, str, str, int]]) -> None:
        """The mapping of each source, from its own counts of (source, left, character, right). Sources whose mappings agree
        were garbled by one swap (the leading symbol differs by language): they are pooled and learned again."""
        by: dict[str, list[tuple[str, str, str, int]]] = {}
        for src, left, c, right, n in counts:
            by.setdefault(src, []).append((left, c, right, n))
        groups = [([src], by[src], self._mapping(by[src])) for src in sorted(by, key=lambda s: (-sum(r[3] for r in by[s]), s))]
        merged = True
        while merged:
            merged, kept = False, []
            for names, rows, table in groups:
                for g in kept:
                    same = sum(g[2].get(c) == x for c, x in table.items())
                    if same > 1 and same >= 3 * sum(c in g[2] and g[2][c] != x for c, x in table.items()):
                        g[0].extend(names)
                        g[1].extend(rows)
                        merged = True
                        break
                else:
                    kept.append((names, list(rows), table))
            if merged:
                kept = [(names, rows, self._mapping(rows)) for names, rows, _ in kept]
            groups = kept
        # a swap puts more than one symbol out of place; one alone may be a sign of its own
        sure = [(names, table) for names, _, table in groups if sum(chr(c) not in self.known or _class(chr(c)) in (4, 5) for c in table) > 1]
        self.sources = {s: table for names, table in sure for s in names}
        self.mappings = [table for _, table in sure]

    def _mapping(self, rows: list[tuple[str, str, str, int]], rounds: int = 12, least: int = 2) -> dict[int, str]:
        units = {c: i for i, c in enumerate(sorted({t[1] for t in rows}))}
        size = len(self.letters)
        seen: Counter = Counter()
        for t in rows:
            seen[t[1]] += t[3]
        # flat over all letters: only what stands beside a symbol speaks for one
        prior = np.full((len(units), size + 1), 0.5 / size)
        prior[:, 0] = 0.5
        p = np.exp(self._em(rows, units, prior, rounds, 1.0))
        # one-to-one: the surest symbols choose first, and a letter is taken once
        best: dict[int, str] = {}
        taken: set[int] = set()
        for c in sorted(units, key=lambda c: (-seen[c] * p[units[c], 1:].max(), c)):
            k = next((int(j) for j in p[units[c]].argsort()[::-1] if j == 0 or int(j) not in taken), 0)
            if k and seen[c] >= least and p[units[c], k] > 0.3:
                taken.add(k)
                best[ord(c)] = self.letters[k - 1]
        return best

    def judge(self, key: str) -> tuple[bool, str]:
        """Whether a run with its neighbours is garbled, and what it was; where that is lost, the run stays."""
        if key in self.memo:
            return self.memo[key]
        got = self._judge(key)
        if len(self.memo) < 300_000:
            self.memo[key] = got
        return got

    def _judge(self, key: str) -> tuple[bool, str]:
        if "�" in key:
            return True, key
        if all(c < "\x80" or c in _PLAIN for c in key):
            return False, key
        units = self.segment(key)
        out, bad, many = [], False, False
        for i, u in enumerate(units):
            if u < "\x80" or u in _PLAIN:
                out.append(u)
                continue
            left = out[-1][-1] if out and out[-1] else " "
            nxt = units[i + 1] if i + 1 < len(units) else " "
            right = max(self.table[nxt], key=self.table[nxt].get) if len(nxt) > 1 and nxt in self.table else nxt[0]
            hit, k = False, 0
            if self.open(left, u, right):
                w = self.weigh(left, u, right)
                k = int(w.argmax())
                hit = bool(k) and w[0] - w[k] < -3
            if hit:
                many |= len(u) > 1
                out.append(self.letters[k - 1])
            else:
                out.append(u)
            bad |= hit or len(u) == 1 and "\x80" <= u < "\xa0"
        new = "".join(out)
        if many or bad and new != key and key.count("�") == 0 and sum(c >= "\x80" for c in key) < 3:
            return bad, new
        # the whole run as the image of one swap: its table is applied at once
        text = " " + key + " "
        own = self.line(text)
        foreign = sum(c >= "\x80" and c not in _PLAIN for c in key)
        best, gain = key, 0.0
        if foreign >= 3:
            for m in self.swaps:
                other = key.translate(m)
                if other != key and (g := self.line(" " + other + " ") - own) > gain:
                    best, gain = other, g
            if gain > 6 + 0.6 * foreign:
                return True, best
        return bad, new

    def line(self, t: str) -> float:
        return float(sum(self.logb[self.at(a), self.at(b)] for a, b in zip(t, t[1:])))


def pair_counts(texts: Iterable[str]) -> Counter:
    """Weighted counts of the pairs of characters in clean texts, as written and in capitals."""
    big: Counter = Counter()
    for t in texts:
        for form, w in ((t, 6), (t.upper(), 1), (t.title(), 1)):
            s = " " + form + " "
            for pair, n in Counter(zip(s, s[1:])).items():
                big[pair] += w * n
    return big


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        big = pair_counts(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in big], pa.string()), pa.array([p[1] for p in big], pa.string()), pa.array(big.values(), pa.int64())], ["a", "b", "n"])


def clean_model(samples: Iterable[str], garbles: list[tuple[str, str]] = GARBLES) -> Cipher:
    """The bigram model of clean texts and the code-page prior of the symbols."""
    return model_of(pair_counts(samples), garbles)


def model_of(big: dict[tuple[str, str], int], garbles: list[tuple[str, str]] = GARBLES) -> Cipher:
    """The same from the counts of the pairs."""
    chars = sorted({c for ab in big for c in ab} | set(RIGHT))
    letters = [c for c in chars if c >= "\x80"]
    names = letters + [c for c in chars if c < "\x80"]
    n = len(names)
    idx = {c: i for i, c in enumerate(names)}
    c2, k2 = np.zeros((n, n)), np.full((10, 10), 0.5)
    for (a, b), w in big.items():
        c2[idx[a], idx[b]] += w
        k2[_class(a), _class(b)] += w
    cls = np.array([_class(c) for c in names])
    for a, b in ((9, 9), (9, 0), (0, 9), (1, 9), (9, 1), (9, 2), (2, 9)):
        k2[a, b] += 200
    kp = k2 / k2.sum(1, keepdims=True)
    uni = c2.sum(0) + 1
    in_class = uni / np.array([uni[cls == k].sum() for k in cls])
    own = c2.sum(1, keepdims=True)
    lam = own / (own + 40)
    by_class = kp[cls][:, cls] * in_class
    p = lam * np.divide(c2, own, out=np.zeros_like(c2), where=own > 0) * 0.97 + (1 - lam * 0.97) * by_class
    # rows and columns of unseen characters, by class
    full = np.full((n + 10, n + 10), 1e-7)
    full[:n, :n] = p
    for k in range(10):
        full[n + k, :n] = kp[k][cls] * in_class
        full[:n, n + k] = kp[cls, k] * 0.01
        full[n + k, n:] = kp[k] * 0.01
    table: dict[str, dict[str, float]] = {}
    swaps: list[dict[int, str]] = []
    for was, read in garbles:
        single: dict[int, str] = {}
        for ch in letters:
            once = _wrong(ch, was, read)
            if once is None:
                continue
            forms = [once]
            if was == "utf-8" and read in ("cp1252", "latin-1"):
                twice = "".join(_wrong(x, was, read) or x for x in once)
                forms += [twice, "".join(_wrong(x, was, read) or x for x in twice)]
            for f in forms:
                if any(x >= "\x80" for x in f):
                    table.setdefault(f, {})[ch] = table.get(f, {}).get(ch, 0) + 1
            if len(once) == 1 and once >= "\x80":
                single[ord(once)] = ch
        if len(single) > 20:
            swaps.append(single)
    return Cipher(letters, np.log(np.maximum(full, 1e-9)), table, swaps, frozenset(letters), idx)


def _unquoted(text: str) -> list[str]:
    return _QUOTED.split(text) if "`" in text or "⟦" in text else [text]


def _counts(batches: Iterator[pa.RecordBatch], model: Cipher) -> Iterator[pa.RecordBatch]:
    """(source, left, symbol, right, n); without source: symbols as the listed code pages make them."""
    keys: Counter = Counter()
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        for key, count in keys.items():
            units = model.segment(key)
            for i, u in enumerate(units):
                if u >= "\x80" and u not in _PLAIN and model.open(units[i - 1][-1] if i else " ", u, units[i + 1][0] if i + 1 < len(units) else " "):
                    n[None, units[i - 1] if i else " ", u, units[i + 1] if i + 1 < len(units) else " "] += count
        rows = list(n.items())
        keys.clear(), n.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0][i] for r in rows], pa.string()) for i in range(4)] + [pa.array([r[1] for r in rows], pa.int64())], ["s", "l", "u", "r", "n"])

    for b in batches:
        for col in b.columns:
            for t in col.to_pylist():
                if not t or t.isascii():
                    continue
                runs = [k for part in _unquoted(t) for k in _RUN.findall(part)]
                keys.update(runs)
                src = model.source(runs)
                if src:
                    for k in runs:
                        n.update((src, *x) for x in model.alone(k))
        if len(keys) + len(n) > 400_000:
            yield out()
    yield out()


def fit(df: DataFrame, fields: list[str], samples: DataFrame, text: str = "text") -> Cipher:
    """Learn clean language from all rows of `samples`, which hold clean text, and the ciphers from all rows of df.

    Only counts come to the driver, summed on the cluster: of pairs of characters in `samples`; in df of (left, symbol,
    right), and of the same per source. Their number is bounded by the inventory of the characters that
    can be in question, not by rows: letters of other scripts among themselves, such as running Chinese, are not counted.
    """
    spark = df.sparkSession
    ship(spark)
    arrow_rows(spark, 1000)
    clean = samples.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).mapInArrow(_pairs, "a string, b string, n long")
    model = model_of({(r[0], r[1]): r[2] for r in clean.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()})
    src = df.select(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    counts = src.mapInArrow(lambda it: _counts(it, model), "s string, l string, u string, r string, n long").groupBy("s", "l", "u", "r").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for r in counts.collect()]
    model.fit([r[1:] for r in rows if r[0] is None])
    model.fit_sources([r for r in rows if r[0] is not None])
    return model


def repair(text: str | None, model: Cipher) -> tuple[int, str | None]:
    """(garbled runs, restored text); quoted code and glyph markers stay as they are."""
    if text is None or (text.isascii() and "&#" not in text):
        return 0, text
    plain = _ENTITY.sub(lambda m: chr(int(m.group(1))), text) if "&#" in text else text
    if plain != text:
        # garbled characters may have been written as numeric references
        n, new = repair(plain, model)
        return (n, new) if n else (0, text)
    spans: list[tuple[int, int]] = []
    at = 0
    for a, b in [m.span() for m in _QUOTED.finditer(text)] + [(len(text), len(text))] if "`" in text or "⟦" in text else [(len(text), len(text))]:
        spans += [m.span() for m in _RUN.finditer(text, at, a)]
        at = b
    runs = [text[a:b] for a, b in spans]
    read = [model.judge(k) for k in runs]
    bad = sum(hit for hit, _ in read)
    own = model.sources.get(model.source(runs)) if model.sources else None
    line = lambda k: model.line(f" {k} ")
    judged = sum(line(new) - line(k) for (hit, new), k in zip(read, runs) if hit) if bad else 0.0
    # symbol by symbol the likeliest letters always look well; the source's own mapping need only come near them
    if own and _CYRILLIC.search(text) and any(_class(chr(c)) in (4, 5) for c in own):
        own = None  # a mapping of letters that this text also has of its own
    best, gained = None, 0.75 * judged if own else judged + 3
    for table in [own] if own else model.mappings if bad else []:
        other = [k.translate(table) for k in runs]
        gain = sum(line(o) - line(k) for k, o in zip(runs, other) if k != o)
        if gain > gained and gain > 8 + 2 * sum(c != z for k, o in zip(runs, other) for c, z in zip(k, o)):
            best, gained = other, gain
    if best:
        read = [(k != o, o) for k, o in zip(runs, best)]
        bad = sum(hit for hit, _ in read)
    if not bad:
        return 0, text
    out, last = [], 0
    for (a, b), (hit, new) in zip(spans, read):
        if hit:
            out += [text[last:a], new]
            last = b
    return bad, "".join(out) + text[last:]


def _rows(batches: Iterator[pa.RecordBatch], model: Cipher, fields: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_pylist()
        rows = []
        for j, f in enumerate(fields, 1):
            for i, t in enumerate(b.column(j).to_pylist()):
                n, new = repair(t, model)
                if n:
                    rows.append((ids[i], f, n, new))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["id", "field", "runs", "restored"])


def garbled(df: DataFrame, model: Cipher, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, runs, restored): each field that holds garbled text, with the text restored as far as it can be.

    Every row is judged whole where it lies, without a shuffle. Null, empty and ASCII texts give no row; U+FFFD counts as
    garbled and stays. Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    ship(df.sparkSession)
    arrow_rows(df.sparkSession, 1000)
    src = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return src.mapInArrow(lambda it: _rows(it, model, fields), "id string, field string, runs int, restored string")
