"""The steps that need Unicode tables the JVM functions do not offer, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quire.functions import text as tx

def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def _reread(s: str) -> str:
    try:
        raw = s.encode("cp1252")
    except UnicodeEncodeError:
        try:
            raw = b"".join(map(_byte, s))
        except UnicodeEncodeError:
            return s
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        return s
    return t if len(t) < len(s) else s


_ODD = re.compile(r"[^\x00-\x7f]{2,}")


def _repair(s: str | None) -> str | None:
    """The whole string read again, else each run of characters outside ASCII for itself."""
    if not s or s.isascii():
        return s
    whole = _reread(s)
    return whole if whole != s else _ODD.sub(lambda m: _reread(m.group()), s)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _mojibake(s: pd.Series) -> pd.Series:
    return s.map(_repair)


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def mojibake(c: Column) -> Column:
    """A string, or runs in it, read as Windows-1252 or Latin-1 instead of UTF-8, re-read where that round-trips and shortens it."""
    return _mojibake(c)


_SPACES, _ENDS, _LINES = re.compile(r"[ \t]+"), re.compile(r" +\n"), re.compile(r"\n{3,}")
_HYPHEN = re.compile(r"([^\W\d_])-[ \t]*\n[ \t]*([^\W\d_])")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_RUN = re.compile(f"[{tx.SUPER}]+|[{tx.SUB}]+")
_LINE = {**dict(zip(tx.SUPER, tx.SUPER_PLAIN)), **dict(zip(tx.SUB, tx.SUB_PLAIN))}


_TABLE = {**tx.LIGATURES, **tx.ONE_TO_ONE, **dict.fromkeys(tx.DROPPED, "")}
_RAISED = frozenset(tx.SUPER + tx.SUB)


@lru_cache(maxsize=None)
def _unwanted(c: str) -> bool:
    """Control, format, surrogate, private and unassigned characters, but for tab, line feed and return."""
    return c not in "\t\n\r" and unicodedata.category(c)[0] == "C"


def _swap(s: str, present: set[str]) -> str:
    """The table applied by the few of its characters that a text has."""
    for c in present & _TABLE.keys():
        s = s.replace(c, _TABLE[c])
    return s


def _script(m: re.Match) -> str:
    run = m.group()
    plain = "".join(map(_LINE.__getitem__, run))
    return ("^" if run[0] in tx.SUPER else "_") + (plain if len(plain) == 1 and run not in tx.WIDE else "{" + plain + "}")


def clean(s: str | None, repair: bool = True, compatible: bool = True) -> str | None:
    """One text through all cleaning steps in their order: wrong decoding, typography, scripts, compatibility form,
    typography again, hyphens at line ends, unwanted characters, white space."""
    if not s:
        return s
    if not s.isascii():
        if repair:
            s = unicodedata.normalize("NFC", _repair(s))
        s = _swap(s, set(s))
        if not _RAISED.isdisjoint(s):
            s = _RUN.sub(_script, s)
        if compatible:
            s = unicodedata.normalize("NFKC", s)
            s = _swap(s, set(s))
    elif _CONTROL.search(s):
        s = _swap(s, set(s))
    if "-" in s:
        s = _HYPHEN.sub(lambda m: m.group(1) + m.group(2) if m.group(2).islower() else m.group(), s)
    if not s.isascii():
        for c in set(s):
            if c > "\x7e" and _unwanted(c):
                s = s.replace(c, "")
    if "  " in s or "\t" in s:
        s = _SPACES.sub(" ", s)
    if " \n" in s:
        s = _ENDS.sub("\n", s)
    if "\n\n\n" in s:
        s = _LINES.sub("\n\n", s)
    return s.strip(" \t\n\r\x0b\x0c")


@F.pandas_udf(T.StringType())
def _clean(s: pd.Series) -> pd.Series:
    return s.map(clean)


@F.pandas_udf(T.StringType())
def _clean_plain(s: pd.Series) -> pd.Series:
    return s.map(lambda x: clean(x, repair=False, compatible=False))


def normalize(c: Column, plain: bool = False) -> Column:
    """A text through all cleaning steps, in one Arrow batch function; `plain` leaves out the repair of wrong decodings and
    the compatibility form, so that the result is that of text.normalize_text. Null stays null."""
    return _clean_plain(c) if plain else _clean(c)
