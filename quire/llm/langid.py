"""Language of documents and of their paragraphs by prediction by partial matching.

For each language a variable-order byte context tree (orders 0 to ORDER) is counted on labelled sample texts and frozen.
The code length of a byte is exact PPM with escape method C: count / (n + distinct) where the context knows the byte,
else the escape distinct / (n + distinct) and the next shorter context, down to 1/256. As statistics are frozen, a byte's
cost depends on its last ORDER + 1 bytes only, so the costs of all known windows are tabulated once and a text is scored
by table look-ups, whole, in numpy. The sample texts are counted as they are and as wrong decodings garble them, so that
garbled text counts as the language it was written in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import arrow_rows, ship

ORDER = 4
#: Fixed values: (encoding the text was in, encoding it was read in).
GARBLES = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1251")]
#: Notations of the language codes, by code.
NOTATIONS = {
    "es": "es spa esp spanish espanol español castellano castilian spagnolo espagnol spanisch",
    "en": "en eng english ingles inglés anglais englisch inglese",
    "fr": "fr fra fre french frances francés français francais französisch francese",
    "de": "de deu ger german aleman alemán deutsch allemand tedesco",
    "pt": "pt por portuguese portugues portugués português portugiesisch portoghese",
    "it": "it ita italian italiano italien italienisch",
    "ru": "ru rus russian ruso russo russe russisch русский",
}
_CODE = {n: c for c, names in NOTATIONS.items() for n in names.split()}
_LETTER, _LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"(?:[^\W\d_][\W\d_]*){30}")
_MARKUP = re.compile(r"^\s*(?:```|~~~|\||\$|\\begin|<t[rdh]|#|\*\*|©|ISBN)")
_FOLD = bytes.maketrans(b"\t\n\r\x0b\x0c123456789", b"     000000000")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label denotes in any usual notation (case, region, three letters, name); else None."""
    p = re.split(r"[-_\s]", (label or "").strip().lower(), maxsplit=1)[0]
    return _CODE.get(p)


def _read_wrongly(text: str, was: str, read: str) -> str:
    raw = text.encode(was, "replace")
    try:
        return raw.decode(read)
    except UnicodeDecodeError:
        # bytes the code page leaves open pass as the controls of the same number
        return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)


def _clean(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


@dataclass
class Ppm:
    """Frozen code-length tables: per order the known windows, the bits of each by language, and the escape bits."""

    languages: list[str]
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    escape: list[np.ndarray]

    def __post_init__(self) -> None:
        self.slots = [self._slots(k) for k in self.keys]

    @staticmethod
    def _hash(x: np.ndarray, shift: int) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, int]:
        log = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        slots, todo, at = np.full(2**log, -1, np.int32), np.arange(len(keys), dtype=np.int32), self._hash(keys, 64 - log)
        while len(todo):
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            lost = slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (2**log - 1)
        return slots, log

    def find(self, order: int, w: np.ndarray) -> np.ndarray:
        """Row of each window in the table of an order, -1 where it is unknown."""
        slots, log = self.slots[order]
        keys = self.keys[order]
        at = self._hash(w, 64 - log)
        row = slots[at]
        bad = np.flatnonzero((row >= 0) & (keys[row] != w))
        while len(bad):
            at[bad] = (at[bad] + 1) & (2**log - 1)
            r = slots[at[bad]]
            row[bad] = r
            bad = bad[(r >= 0) & (keys[r] != w[bad])]
        return row

    def cost(self, data: np.ndarray) -> np.ndarray:
        """(bytes, languages): bits of every byte given the bytes before it."""
        n = len(data)
        x = np.concatenate([np.full(ORDER, 32, np.uint8), data]).astype(np.uint64)
        two = (x[:-1] << np.uint64(8)) | x[1:]
        w = (((two[:-2] << np.uint64(16)) | two[2:])[:-1] << np.uint64(8)) | x[4:]
        row = self.find(ORDER, w)
        out = self.bits[ORDER].take(row, 0, mode="wrap")
        left = np.flatnonzero(row < 0)
        if len(left):
            acc = np.zeros((len(left), len(self.languages)), np.float32)
            idx = np.arange(len(left))
            v = w[left]
            for order in range(ORDER, -1, -1):
                # the context of this order, known or not, is escaped from; then the next shorter window is tried
                if order:
                    ctx = self.find(order - 1, (v >> np.uint64(8)) & np.uint64(256**order - 1))
                    acc[idx] += np.where((ctx >= 0)[:, None], self.escape[order - 1][ctx], 0)
                else:
                    acc[idx] += self.root + 8
                    break
                sub = self.find(order - 1, v & np.uint64(256**order - 1))
                got = sub >= 0
                acc[idx[got]] += self.bits[order - 1][sub[got]]
                idx, v = idx[~got], v[~got]
                if not len(idx):
                    break
            out[left] = acc
        return out

    @property
    def root(self) -> np.ndarray:
        return self.escape[-1]


def fit_ppm(samples: Iterable[tuple[str, str]], garbles: list[tuple[str, str]] = GARBLES) -> Ppm:
    """Count the context trees of the labelled samples (language, text)."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    languages = sorted(by)
    data = []
    for lang in languages:
        text = "\n".join(by[lang])
        forms = [text, text]
        for was, read in garbles:
            if any(c > "\x7f" for c in text):
                for t in (text, text.upper()):
                    once = _read_wrongly(t, was, read)
                    if once.count("?") <= t.count("?") + len(t) // 50:
                        forms.append(once)
                        if was == "utf-8" and read in ("cp1252", "latin-1"):
                            forms.append(_read_wrongly(once, was, read))
        data.append(np.frombuffer(b" " * (ORDER + 1) + _clean("\n".join(forms)), np.uint8))
    keys, bits, escape = [], [], []
    n_lang = len(languages)
    prev_keys = prev_bits = None
    tot = np.array([[len(d)] for d in data], float)
    root_esc = None
    for order in range(ORDER + 1):
        wins = []
        for d in data:
            x = np.concatenate([np.full(order, 32, np.uint8), d]).astype(np.uint64)
            w = np.zeros(len(d), np.uint64)
            for i in range(order + 1):
                w = (w << np.uint64(8)) | x[i : i + len(d)]
            wins.append(np.unique(w, return_counts=True))
        k = np.unique(np.concatenate([u for u, _ in wins]))
        c = np.zeros((len(k), n_lang))
        for j, (u, n) in enumerate(wins):
            c[np.searchsorted(k, u), j] = n
        ctx, inv = np.unique(k >> np.uint64(8), return_inverse=True)
        n_ctx, d_ctx = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(n_ctx, inv, c)
        np.add.at(d_ctx, inv, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(n_ctx > 0, -np.log2(d_ctx / (n_ctx + d_ctx)), 0.0)
            own = -np.log2(c / (n_ctx + d_ctx)[inv])
        if order == 0:
            shorter = np.full((len(k), n_lang), 8.0)
            root_esc = esc[0]
        else:
            shorter = prev_bits[np.searchsorted(prev_keys, k & np.uint64(256**order - 1))]
            # escape bits of this order's contexts, lined up with the windows of the order below
            e = np.zeros((len(prev_keys), n_lang))
            at = np.searchsorted(prev_keys, ctx)
            ok = (at < len(prev_keys)) & (prev_keys[np.minimum(at, len(prev_keys) - 1)] == ctx)
            e[at[ok]] = esc[ok]
            escape.append(e.astype(np.float32))
        b = np.where(c > 0, own, esc[inv] + shorter)
        keys.append(k), bits.append(b.astype(np.float32))
        prev_keys, prev_bits = k, b
    escape.append(root_esc.astype(np.float32))
    return Ppm(languages, keys, bits, escape)


def score_texts(model: Ppm, texts: list[str]) -> np.ndarray:
    """(texts, languages): the code length of each text in bits."""
    out = np.zeros((len(texts), len(model.languages)), np.float64)
    enc = [b" " + _clean(t) for t in texts]
    i = 0
    while i < len(enc):
        j, size = i, 0
        while j < len(enc) and (j == i or size + len(enc[j]) <= 400_000):
            size += len(enc[j])
            j += 1
        starts = np.r_[0, np.cumsum([len(e) for e in enc[i:j]])[:-1]]
        out[i:j] = np.add.reduceat(model.cost(np.frombuffer(b"".join(enc[i:j]), np.uint8)), starts, axis=0)
        i = j
    return out


def running_text(paragraph: str) -> bool:
    """Whether a paragraph holds words enough to tell a language, and is no code, formula or table row."""
    return not _MARKUP.match(paragraph) and "```" not in paragraph and len(paragraph.split(None, 6)) > 5 and _LETTERS.search(paragraph) is not None


def _segments(batches: Iterator[pa.RecordBatch], model: Ppm, margin: float) -> Iterator[pa.RecordBatch]:
    names = model.languages
    for b in batches:
        paras, owner, number, short = [], [], [], []
        texts = b.column(1).to_pylist()
        for i, t in enumerate(texts):
            code = False
            for no, p in enumerate((t or "").split("\n\n"), 1):
                fence = p.count("```") % 2
                if not code and not fence:
                    if running_text(p):
                        paras.append(p), owner.append(i), number.append(no)
                    elif _LETTER.search(p):
                        short.append((i, no, p))
                code ^= bool(fence)
        rows: list[tuple] = []
        held = set(owner)
        whole = [i for i, t in enumerate(texts) if t and i not in held and _LETTER.search(t)]
        # texts with no paragraph of running text are judged as a whole
        bits = score_texts(model, paras + [texts[i] for i in whole] + [p for _, _, p in short])
        best = bits.argmin(1) if len(bits) else np.empty(0, int)
        conf = 1 / np.exp2(np.clip(bits.min(1, initial=1e30)[:, None] - bits, -60, 0)).sum(1) if len(bits) else best
        vote = np.zeros((len(texts), len(names)))
        np.add.at(vote, (np.array(owner, int), best[: len(paras)]), [len(p) for p in paras])
        main = vote.argmax(1)
        for q, i in enumerate(whole, len(paras)):
            main[i] = best[q]
        share = vote.max(1) / np.maximum(vote.sum(1), 1)
        share[whole] = conf[len(paras) : len(paras) + len(whole)]
        told = held | set(whole)
        for i in range(len(texts)):
            rows.append((i, 0, names[main[i]], float(share[i]), names[main[i]]) if i in told else (i, 0, None, 0.0, None))
        if paras:
            m = main[np.array(owner)]
            at = np.arange(len(paras))
            pick = np.where(bits[at, m] - bits[at, best[: len(paras)]] >= margin, best[: len(paras)], m)
            # the confidence is that of the language given, also where the lead of another one is too small
            sure = conf[at] * np.exp2(np.clip(bits[at, best[at]] - bits[at, pick], -60, 0))
            rows += [(i, no, names[k], float(c), names[h]) for i, no, k, c, h in zip(owner, number, pick, sure, m)]
        for q, (i, no, _) in enumerate(short, len(paras) + len(whole)):
            # too short to tell, or no running text: the document's language, with its own weight
            rows.append((i, no, names[main[i]], float(conf[q] * np.exp2(max(-60.0, bits[q, best[q]] - bits[q, main[i]]))), names[main[i]]))
        ids = b.column(0).to_pylist()
        label = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([min(1.0, r[3]) for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.string()), pa.array([label_code(label[r[0]]) for r in rows], pa.string())],
            ["id", "para_no", "language", "confidence", "main", "label"],
        )


def fit_from(seed: DataFrame, language: str = "language", text: str = "text", max_rows: int = 2000) -> Ppm:
    """Fit on a labelled table; at most max_rows of its rows (documented bound) come to the driver, in a fixed order."""
    rows = seed.select(language, text).where(F.col(language).isNotNull() & F.col(text).isNotNull()).orderBy(F.xxhash64(text), language).limit(max_rows).collect()
    return fit_ppm([(r[0], r[1]) for r in rows])


def languages(df: DataFrame, model: Ppm, id_col: str, text_col: str, label_col: str | None = None, margin: float = 12.0) -> DataFrame:
    """(id, para_no, language, confidence, main, label): para_no 0 is the document, >= 1 its paragraphs with letters.

    No shuffle: each document is scored whole where it lies. A paragraph counts as deviating only if another language's
    code is shorter by `margin` bits; other paragraphs with letters (headings, tables, lines of a few words) have the
    document's language, with the confidence that their own code lengths give it. A text without letters, or null, has a row 0 with null language and confidence 0;
    `label` is the two-letter code that the given label denotes, or null. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    arrow_rows(df.sparkSession, 1000)
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"), label.alias("l"))
    return src.mapInArrow(lambda it: _segments(it, model, margin), "id string, para_no int, language string, confidence double, main string, label string")
