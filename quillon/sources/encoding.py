"""Bytes to text: byte-order marks, size limits, signature probes, a legacy two-byte string form, and typed warnings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest raw stream that is read, and the prefix a signature probe looks at.
MOST_BYTES, PROBE = 256 << 20, 64 << 10


def sniff(content: Column) -> Column:
    """utf-8, utf-16le or utf-16be by byte-order mark; utf-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").otherwise("utf-8")


def decoded(content: Column) -> Column:
    """Text without its mark; null where the bytes are not what they say."""
    kind = sniff(content)
    cut = lambda n: F.substring(content, F.lit(n + 1), F.length(content))
    bom8 = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    utf8 = F.when(bom8, cut(3)).otherwise(content)
    return F.when(kind == "utf-16le", F.decode(cut(2), "UTF-16LE")).when(kind == "utf-16be", F.decode(cut(2), "UTF-16BE")).otherwise(F.try_validate_utf8(utf8.cast("string")))


def oversize(length: Column, most: int = MOST_BYTES) -> Column:
    """An error for streams over the cap, before anything is decoded; null for the rest."""
    return F.when(length > most, F.concat(F.lit("stream of "), length.cast("string"), F.lit(" bytes is over the limit")))


def has_root(content: Column, name: str) -> Column:
    """Whether the first bytes hold this root element."""
    # where the probe ends within a character, its first bytes are left out
    cut = [F.when(F.length(content) > PROBE, decoded(F.substring(content, 1, PROBE - n))) for n in (1, 2, 3)]
    return F.coalesce(decoded(F.substring(content, 1, PROBE)), *cut, F.lit("")).rlike(rf"^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<{name}[\s>/]")


def legacy_text(raw: bytes) -> str:
    """Two-byte strings: NUL ends, bytes below 0x80 are ASCII, pairs are Johab, a lone lead byte is '?'."""
    out, at = [], 0
    while at < len(raw) and raw[at]:
        b = raw[at]
        if b < 0x80:
            out.append(chr(b))
            at += 1
        elif at + 1 < len(raw):
            out.append(raw[at : at + 2].decode("johab", "replace"))
            at += 2
        else:
            out.append("?")
            at += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def legacy_decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else legacy_text(bytes(b)))


def warnings(content: Column) -> Column:
    """Codes of what is odd but not fatal."""
    text = decoded(content)
    return F.array_compact(F.array(F.when(F.length(content) == 0, "empty"), F.when(text.isNull(), "bad-encoding"), F.when(text.contains("\ufffd"), "replacement-character"), F.when(text.contains("\x00"), "nul"), F.when(sniff(content) != "utf-8", "not-utf-8")))


#: How files of each format begin, as hexadecimal digits: fixed values.
SIGNATURES = {"hwp5": "D0CF11E0A1B11AE1", "hwpx": "504B0304", "hwp3": "48575020446F63756D656E742046696C65"}


def file_format(content):
    """hwp5, hwpx, hwp3 or hml by how a file begins, else unknown."""
    head = F.hex(F.substring(content, 1, 64))
    out = None
    for name, mark in SIGNATURES.items():
        hit = head.startswith(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(has_root(content, "HWPML"), "hml").otherwise("unknown")
