"""Code pages as Column expressions.

A single-byte page is read as ISO-8859-1, which maps each byte to the character of its number, and
then translated; so decoding stays inside whole-stage code generation. UTF-8 uses Spark's own checks.
"""

from __future__ import annotations

import codecs
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"ebcdic-cp037": "cp037", "ebcdic": "cp037"}
SUPPORTED = ("utf-8", "cp850", "cp1252", "latin-1", "ebcdic-cp037")
LOST = "�"


@cache
def canonical(page: str) -> str:
    """The codec's usual name; LookupError for a page that does not exist."""
    return codecs.lookup(ALIASES.get(page, page)).name


@cache
def byte_table(page: str) -> str:
    """The character of each of the 256 bytes; U+FFFD for bytes that the page does not define."""
    out = []
    for b in range(256):
        c = bytes([b]).decode(canonical(page), errors="replace")
        if len(c) != 1:
            raise LookupError(f"{page} is not a single-byte code page")
        out.append(c)
    return "".join(out)


def is_utf8(page: str) -> bool:
    return canonical(page) == "utf-8"


def decode(raw: Column, page: str) -> Column:
    """Text of binary data; what cannot be decoded becomes U+FFFD."""
    if is_utf8(page):
        return F.make_valid_utf8(raw.cast("string"))
    moved = [(chr(b), c) for b, c in enumerate(byte_table(page)) if chr(b) != c]
    text = F.decode(raw, "ISO-8859-1")
    if not moved:
        return text
    changed = F.translate(text, "".join(a for a, _ in moved), "".join(c for _, c in moved))
    # ASCII alone has as many bytes in UTF-8 as it had; most records of most pages need no translation.
    return F.when(F.octet_length(text) == F.length(raw), text).otherwise(changed) if min(moved)[0] > "\x7f" else changed


def undecodable(raw: Column, page: str) -> Column:
    """Whether strict decoding would fail."""
    if is_utf8(page):
        return ~F.is_valid_utf8(raw.cast("string"))
    holes = [b for b, c in enumerate(byte_table(page)) if c == LOST]
    if not holes:
        return F.lit(False)
    return F.decode(raw, "ISO-8859-1").rlike("[" + "".join(f"\\x{b:02x}" for b in holes) + "]")


def encode(text: Column, page: str) -> Column:
    """Bytes of text whose characters the page has; used to make fixtures."""
    if is_utf8(page):
        return F.encode(text, "UTF-8")
    moved = [(c, chr(b)) for b, c in enumerate(byte_table(page)) if chr(b) != c and c != LOST]
    if not moved:
        return F.encode(text, "ISO-8859-1")
    changed = F.translate(text, "".join(a for a, _ in moved), "".join(c for _, c in moved))
    plain = min(moved)[0] > "\x7f" and min(b for _, b in moved) > "\x7f"
    return F.encode(F.when(F.octet_length(text) == F.length(text), text).otherwise(changed) if plain else changed, "ISO-8859-1")
