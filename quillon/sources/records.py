"""Binary record streams: fixed headers (type and size as little-endian 32-bit numbers), decoded in Arrow batches."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.shipping import ship

#: Most records of one stream that become rows of one batch at a time.
STEP = 10_000


def records(blob: bytes | None):
    """(ordinal, type, size, error): a size under 8, or past the end, ends the stream with an error."""
    at, n = 0, 0
    blob = blob or b""
    while at + 8 <= len(blob):
        kind, size = struct.unpack_from("<II", blob, at)
        if size < 8 or at + size > len(blob):
            yield n, kind, size, "bad size"
            return
        yield n, kind, size, None
        at, n = at + size, n + 1
    if at < len(blob):
        yield n, None, len(blob) - at, "truncated header"


def decode(blobs: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """A row for each record of each stream."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for key, blob in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for r in records(blob):
                    rows.append((key.as_py(), *r))
                    if len(rows) >= STEP:
                        yield batch(b.column(0).type, rows)
                        rows = []
            yield batch(b.column(0).type, rows)

    def batch(kind, rows):
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int32(), pa.int64(), pa.int64(), pa.string()))], [id_col, "ordinal", "type", "size", "error"])

    kind = blobs.schema[id_col].dataType.simpleString()
    ship(blobs.sparkSession)
    return blobs.select(id_col, blob_col).mapInArrow(run, f"{id_col} {kind}, ordinal int, type long, size long, error string")


#: Names of metafile records by their codes, as published: fixed values.
WMF_NAMES = {0x0000: "EOF", 0x0102: "SETBKMODE", 0x0106: "SETPOLYFILLMODE", 0x0103: "SETMAPMODE", 0x020B: "SETWINDOWORG", 0x020C: "SETWINDOWEXT", 0x012D: "SELECTOBJECT", 0x01F0: "DELETEOBJECT", 0x02FA: "CREATEPENINDIRECT", 0x02FC: "CREATEBRUSHINDIRECT", 0x0213: "LINETO", 0x0214: "MOVETO", 0x0324: "POLYGON", 0x0325: "POLYLINE", 0x041B: "RECTANGLE", 0x0418: "ELLIPSE", 0x0521: "TEXTOUT", 0x0A32: "EXTTEXTOUT"}
EMF_NAMES = {1: "HEADER", 2: "POLYBEZIER", 3: "POLYGON", 4: "POLYLINE", 9: "SETWINDOWEXTEX", 10: "SETWINDOWORGEX", 14: "EOF", 17: "SETMAPMODE", 18: "SETBKMODE", 27: "MOVETOEX", 37: "SELECTOBJECT", 38: "CREATEPEN", 39: "CREATEBRUSHINDIRECT", 40: "DELETEOBJECT", 42: "ELLIPSE", 43: "RECTANGLE", 54: "LINETO", 84: "EXTTEXTOUTW"}
_PLACEABLE = 0x9AC6CDD7


def wmf_records(blob: bytes | None):
    """(ordinal, name, bytes, error) of a Windows metafile: an optional placeable header, a header of 18 bytes, then
    records whose sizes count 16-bit words. It ends with its EOF record."""
    blob = blob or b""
    at = 22 if len(blob) >= 22 and struct.unpack_from("<I", blob)[0] == _PLACEABLE else 0
    if len(blob) < at + 18 or struct.unpack_from("<HH", blob, at)[1] != 9:
        if blob:
            yield 0, None, len(blob), "bad header"
        return
    at, n = at + 18, 0
    while at + 6 <= len(blob):
        size, code = struct.unpack_from("<IH", blob, at)
        if size < 3 or at + 2 * size > len(blob):
            yield n, WMF_NAMES.get(code, f"0x{code:04X}"), 2 * size, "bad size"
            return
        yield n, WMF_NAMES.get(code, f"0x{code:04X}"), 2 * size, None
        if code == 0:
            return
        at, n = at + 2 * size, n + 1
    yield n, None, len(blob) - at, "no end"


def emf_records(blob: bytes | None):
    """(ordinal, name, bytes, error) of an enhanced metafile."""
    for n, code, size, error in records(blob):
        yield n, EMF_NAMES.get(code, None if code is None else f"0x{code:04X}"), size, error


def metafiles(blobs: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """(id, format, ordinal, record, bytes, error): EMF where the first record is a header of one, else WMF."""
    ship(blobs.sparkSession)
    kind = blobs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                emf = len(blob or b"") >= 44 and struct.unpack_from("<I", blob)[0] == 1 and blob[40:44] == b" EMF"
                rows += [(key, "emf" if emf else "wmf", *r) for r in (emf_records if emf else wmf_records)(blob)]
            for lo in range(0, max(1, len(rows)), STEP):
                cols = list(zip(*rows[lo : lo + STEP])) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()))], [id_col, "format", "ordinal", "record", "bytes", "error"])

    return blobs.select(id_col, blob_col).mapInArrow(run, f"{id_col} {kind}, format string, ordinal int, record string, bytes long, error string")
