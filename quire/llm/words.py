"""Words of texts as bytes, cut by table, for the operators that only count them."""

from __future__ import annotations

#: Everything that is no letter becomes a blank, but for the mark \x01 between texts: ASCII by a table, the signs of Latin-1 and of book texts by name.
_BLANK = bytes(1 if c == 1 else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SIGNS = [c.encode() for c in "\xa0¡«·»¿–—‘’“”„…•"]


def words(text: str) -> list[bytes]:
    """The words of a text in lower case, as UTF-8; signs beyond the usual ones stay with their word."""
    b = text.lower().encode("utf-8", "replace").translate(_BLANK)
    if not text.isascii():
        for c in _SIGNS:
            b = b.replace(c, b" ")
    return b.split()
