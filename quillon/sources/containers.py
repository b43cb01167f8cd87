"""Document containers: ZIP archives and compound files, read and written in Arrow batches, and the record trees inside.

A container is one binary value, as binaryFile gives it; its entries come out as rows. Damage is data: what can't be read gives
a row with a typed error, and the entries before it stay. Archives are written so that equal entries give equal bytes:
entries in a fixed order, a fixed time, no extra fields, the type entry first and stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.shipping import bounded, ship

#: Bytes that one entry may have after decompression; more is an error.
LIMIT = 256 << 20
#: The entry that comes first and is stored.
TYPE_ENTRY = "mimetype"
#: Fixed values of the formats: signatures, the time 1980-01-01 00:00, special sector numbers, sizes.
ZIP_LOCAL, ZIP_ENTRY, ZIP_END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
ZIP_DATE = (0 << 9) | (1 << 5) | 1
CFB_SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT, DIFAT, NO_STREAM = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
MINI_SECTOR, MINI_CUTOFF, HEADER_FAT = 64, 4096, 109


class Damaged(Exception):
    """What is wrong with a container, by one of a few codes."""


def inflate(data: bytes, limit: int = LIMIT) -> bytes:
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error as e:
        raise Damaged("bad_data") from e
    if len(out) > limit:
        raise Damaged("too_large")
    if not d.eof:
        raise Damaged("bad_data")
    return out


def deflate(data: bytes) -> bytes:
    d = zlib.compressobj(6, zlib.DEFLATED, -15)
    return d.compress(data) + d.flush()


def zip_write(entries: Iterable[tuple[str, bytes]]) -> bytes:
    """An archive of (name, data): the type entry first, the rest by name; no clock, no owner, no extra field."""
    body, directory = bytearray(), bytearray()
    n = 0
    for name, data in sorted(entries, key=lambda e: (e[0] != TYPE_ENTRY, e[0])):
        packed, method = (data, 0) if name == TYPE_ENTRY else (deflate(data), 8)
        raw = name.encode()
        if max(len(data), len(packed), len(body)) > 0xFFFFFFF0 or len(raw) > 0xFFFF or n == 0xFFFE:
            raise Damaged("too_large")
        about = struct.pack("<HHHHHIIIHH", 20, 0x800, method, 0, ZIP_DATE, zlib.crc32(data), len(packed), len(data), len(raw), 0)
        directory += ZIP_ENTRY + struct.pack("<H", 20) + about + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + raw
        body += ZIP_LOCAL + about + raw + packed
        n += 1
    return bytes(body + directory + ZIP_END + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), len(body), 0))


def zip_read(blob: bytes, limit: int = LIMIT) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(name, data, error) by the central directory, in its order."""
    end = blob.rfind(ZIP_END, max(0, len(blob) - 65_557))
    if end < 0 or end + 22 > len(blob):
        raise Damaged("no_directory")
    n, _, at = struct.unpack_from("<HII", blob, end + 10)
    for _ in range(n):
        if blob[at : at + 4] != ZIP_ENTRY or at + 46 > end:
            raise Damaged("bad_directory")
        flags, method, _, _, crc, packed, size, names, extra, note = struct.unpack_from("<HHHHIIIHHH", blob, at + 8)
        (local,) = struct.unpack_from("<I", blob, at + 42)
        name = blob[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        at += 46 + names + extra + note
        try:
            if flags & 1:
                raise Damaged("encrypted")
            if method not in (0, 8):
                raise Damaged("unknown_method")
            if size > limit:
                raise Damaged("too_large")
            if blob[local : local + 4] != ZIP_LOCAL or local + 30 > len(blob):
                raise Damaged("bad_entry")
            skip, more = struct.unpack_from("<HH", blob, local + 26)
            data = blob[local + 30 + skip + more :][:packed]
            if len(data) < packed:
                raise Damaged("bad_entry")
            data = inflate(data, limit) if method else data
            if len(data) != size or zlib.crc32(data) != crc:
                raise Damaged("bad_checksum")
            yield name, data, None
        except Damaged as e:
            yield name, None, str(e)


def cfb_write(streams: Iterable[tuple[str, bytes]]) -> bytes:
    """A compound file (version 3) of (path, data), paths with / between storages."""
    size = 512
    nodes: list[dict] = [{"name": "Root Entry", "kind": 5, "kids": {}, "data": b""}]
    for path, data in sorted(streams):
        at = 0
        *folders, name = path.split("/")
        for f in folders:
            if f not in nodes[at]["kids"]:
                nodes.append({"name": f, "kind": 1, "kids": {}, "data": b""})
                nodes[at]["kids"][f] = len(nodes) - 1
            at = nodes[at]["kids"][f]
        nodes.append({"name": name, "kind": 2, "kids": {}, "data": data})
        nodes[at]["kids"][name] = len(nodes) - 1
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first = len(fat)
        n = -(-len(data) // size)
        for i in range(n):
            sectors.append(data[i * size : (i + 1) * size].ljust(size, b"\0"))
            fat.append(first + i + 1 if i < n - 1 else END)
        return first if n else END

    mini, mini_fat = bytearray(), []
    for x in nodes:
        if x["kind"] == 2 and 0 < len(x["data"]) < MINI_CUTOFF:
            n = -(-len(x["data"]) // MINI_SECTOR)
            x["first"] = len(mini_fat)
            mini_fat += [x["first"] + i + 1 if i < n - 1 else END for i in range(n)]
            mini += x["data"].ljust(n * MINI_SECTOR, b"\0")
        else:
            x["first"] = put(x["data"]) if x["kind"] == 2 else 0
    nodes[0]["first"], nodes[0]["data"] = put(bytes(mini)), bytes(mini)
    mini_first = put(b"".join(struct.pack("<I", v) for v in mini_fat).ljust(-(-len(mini_fat) * 4 // size) * size, b"\xff"))
    rights = [NO_STREAM] * len(nodes)
    for x in nodes:  # siblings in the order of the format: shorter names first, then by upper case
        order = sorted(x["kids"], key=lambda k: (len(k), k.upper()))
        x["child"] = x["kids"][order[0]] if order else NO_STREAM
        for a, b in zip(order, order[1:], strict=False):
            rights[x["kids"][a]] = x["kids"][b]
    directory = bytearray()
    for i, x in enumerate(nodes):
        name = x["name"].encode("utf-16-le") + b"\0\0"
        if len(name) > 64:
            raise Damaged("bad_name")
        directory += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name), x["kind"], 1, NO_STREAM, rights[i], x["child"]) + bytes(36) + struct.pack("<IQ", x["first"], len(x["data"]))
    directory_first = put(bytes(directory).ljust(-(-len(directory) // size) * size, b"\0"))
    per = size // 4
    tables = extra = 0
    while True:  # the table describes itself, and beyond the header's places the sectors that list it
        need = -(-(len(fat) + tables + extra) // per)
        more = max(0, -(-(need - HEADER_FAT) // (per - 1)))
        if (need, more) == (tables, extra):
            break
        tables, extra = need, more
    at = len(fat)
    places = list(range(at, at + tables))
    fat += [FAT] * tables + [DIFAT] * extra
    whole = b"".join(struct.pack("<I", v) for v in fat).ljust(tables * size, b"\xff")
    sectors += [whole[i * size : (i + 1) * size] for i in range(tables)]
    rest = places[HEADER_FAT:]
    for i in range(extra):
        own = rest[i * (per - 1) : (i + 1) * (per - 1)]
        sectors.append(struct.pack(f"<{per}I", *own, *[FREE] * (per - 1 - len(own)), at + tables + i + 1 if i < extra - 1 else END))
    head = CFB_SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, tables, directory_first, 0, MINI_CUTOFF, mini_first, -(-len(mini_fat) * 4 // size), at + tables if extra else END, extra, 0)[:52]
    listed = (places + [FREE] * HEADER_FAT)[:HEADER_FAT]
    return head + struct.pack(f"<{HEADER_FAT}I", *listed) + b"".join(sectors)


def cfb_read(blob: bytes, limit: int = LIMIT) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(path, data, error) of all streams by their directory."""
    if len(blob) < 512 or blob[:8] != CFB_SIGNATURE:
        raise Damaged("bad_header")
    shift, mini_shift = struct.unpack_from("<HH", blob, 30)
    tables, first_dir, _, cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<IIIIIIII", blob, 44)
    if shift not in (9, 12) or mini_shift != 6:
        raise Damaged("bad_header")
    size = 1 << shift

    def sector(i: int) -> bytes:
        got = blob[(i + 1) * size : (i + 2) * size]
        if i >= DIFAT or not got:
            raise Damaged("bad_chain")
        return got.ljust(size, b"\0")

    numbers = lambda b: struct.unpack(f"<{len(b) // 4}I", b)
    listed = list(numbers(blob[76:512]))
    at, seen = first_difat, set()
    while at < DIFAT:
        if at in seen:
            raise Damaged("looping_chain")
        seen.add(at)
        *own, at = numbers(sector(at))
        listed += own
    fat: list[int] = []
    for i in [x for x in listed if x < DIFAT][:tables]:
        fat += numbers(sector(i))

    def chain(first: int, table: list[int], piece, most: int) -> bytes:
        """The pieces of a chain, which may not return to one of its own nor be longer than asked for."""
        out, at, n, seen = [], first, 0, set()
        while at < DIFAT and n < most:
            if at in seen:
                raise Damaged("looping_chain")
            seen.add(at)
            if at >= len(table):
                raise Damaged("bad_chain")
            out.append(piece(at))
            n += len(out[-1])
            at = table[at]
        return b"".join(out)

    whole = chain(first_dir, fat, sector, len(blob))
    entries = []
    for i in range(0, len(whole) - 127, 128):
        length, kind = struct.unpack_from("<HB", whole, i + 64)
        left, right, child = struct.unpack_from("<III", whole, i + 68)
        first, n = struct.unpack_from("<IQ", whole, i + 116)
        entries.append((whole[i : i + max(0, min(64, length) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, first, n & 0xFFFFFFFF if shift == 9 else n))
    if not entries or entries[0][1] != 5:
        raise Damaged("bad_directory")
    root = entries[0]
    mini_fat = list(numbers(chain(first_mini, fat, sector, len(blob)))) if first_mini < DIFAT else []
    mini = chain(root[5], fat, sector, root[6])[: root[6]] if root[6] else b""
    todo, seen, found = [(root[4], "")], set(), []
    while todo:
        i, above = todo.pop()
        if i == NO_STREAM:
            continue
        if i in seen or i >= len(entries):
            raise Damaged("looping_directory" if i in seen else "bad_directory")
        seen.add(i)
        name, kind, left, right, child, first, n = entries[i]
        todo += [(left, above), (right, above)]
        if kind == 1:
            todo.append((child, f"{above}{name}/"))
        elif kind == 2:
            found.append((f"{above}{name}", first, n))
    for path, first, n in sorted(found):
        try:
            if n > limit:
                raise Damaged("too_large")
            small = n < cutoff
            piece = (lambda j: mini[j * MINI_SECTOR : (j + 1) * MINI_SECTOR]) if small else sector
            data = chain(first, mini_fat if small else fat, piece, n)[:n] if n else b""
            if len(data) < n:
                raise Damaged("short_chain")
            yield path, data, None
        except Damaged as e:
            yield path, None, str(e)


def read(blob: bytes | None, limit: int = LIMIT) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
    """(format, path, data, error) of a container by its signature; a container that breaks off ends with an error row."""
    blob = blob or b""
    kind = "compound" if blob[:8] == CFB_SIGNATURE else "zip" if blob[:4] in (ZIP_LOCAL, ZIP_END) else None
    if kind is None:
        yield "unknown", None, None, "empty" if not blob else "unknown_format"
        return
    try:
        for row in (cfb_read if kind == "compound" else zip_read)(blob, limit):
            yield kind, *row
    except Damaged as e:
        yield kind, None, None, str(e)
    except struct.error:
        yield kind, None, None, "truncated"


def tree_records(data: bytes) -> Iterator[tuple[int, int, int, int | None, bytes | None, str | None]]:
    """(ordinal, tag, level, parent, payload, error) of a record stream: a header of 32 bits has 10 of the tag, 10 of the level
    and 12 of the size; a size of all ones stands in the next 32. A record's parent is the last one with a lower level."""
    at, n = 0, 0
    open_: list[tuple[int, int]] = []
    while at < len(data):
        if at + 4 > len(data):
            yield n, 0, 0, None, None, "truncated"
            return
        (head,) = struct.unpack_from("<I", data, at)
        tag, level, size = head & 0x3FF, head >> 10 & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            if at + 4 > len(data):
                yield n, tag, level, None, None, "truncated"
                return
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        while open_ and open_[-1][0] >= level:
            open_.pop()
        parent = open_[-1][1] if open_ else None
        if at + size > len(data):
            yield n, tag, level, parent, None, "truncated"
            return
        yield n, tag, level, parent, data[at : at + size], None
        open_.append((level, n))
        at, n = at + size, n + 1


def tree_record(tag: int, level: int, payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<I", tag | level << 10 | min(n, 0xFFF) << 20) + (struct.pack("<I", n) if n >= 0xFFF else b"") + payload


def _rows(df: DataFrame, id_col: str, blob_col: str, each, schema: list[tuple[str, str, pa.DataType]], step: int = 16 << 20) -> DataFrame:
    """A row for whatever each(blob) yields; batches end after step bytes of payloads."""
    bounded(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(n for n, _, _ in schema)]

    def run(batches):
        def out(ids, at, rows):
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, _, t) in zip(cols, schema, strict=True))], names)

        for b in batches:
            at, rows, held = [], [], 0
            for i in range(b.num_rows):
                for row in each(b.column(1)[i].as_py()):
                    at.append(i)
                    rows.append(row)
                    held += 64 + sum(len(x) for x in row if isinstance(x, bytes))
                    if held > step:
                        yield out(b.column(0), at, rows)
                        at, rows, held = [], [], 0
            yield out(b.column(0), at, rows)

    return df.select(id_col, blob_col).mapInArrow(run, ", ".join([f"{id_col} {kind}", *(f"{n} {t}" for n, t, _ in schema)]))


def entries(blobs: DataFrame, id_col: str, blob_col: str, limit: int = LIMIT) -> DataFrame:
    """id_col, format, entry, content, error: the entries of each container. Empty and null ones, unknown formats and damage give
    error rows; repeated ids give the entries of each."""
    return _rows(blobs, id_col, blob_col, lambda b: read(b, limit), [("format", "string", pa.string()), ("entry", "string", pa.string()), ("content", "binary", pa.binary()), ("error", "string", pa.string())])


def record_trees(streams: DataFrame, id_col: str, blob_col: str, compressed: bool = False) -> DataFrame:
    """id_col, ordinal, tag, level, parent, payload, error: the records of each stream with links to their parents."""

    def each(blob):
        try:
            data = inflate(blob or b"") if compressed and blob else blob or b""
        except Damaged as e:
            yield 0, None, None, None, None, str(e)
            return
        yield from tree_records(data)

    return _rows(streams, id_col, blob_col, each, [("ordinal", "int", pa.int32()), ("tag", "int", pa.int32()), ("level", "int", pa.int32()), ("parent", "int", pa.int32()), ("payload", "binary", pa.binary()), ("error", "string", pa.string())])


def archives(parts: DataFrame, id_col: str, name: str, data: str, write=zip_write) -> DataFrame:
    """id_col, archive: one container of the entries (name, data) of each id, with equal bytes for equal entries however
    rows were dealt. An archive is a value, so its entries fit one; a task holds one archive. Of entries that share a name the one
    whose bytes come first stays; null ids are an archive of their own, null data is empty, rows without a name are left out."""
    ship(parts.sparkSession)
    kind = parts.schema[id_col].dataType.simpleString()
    rows = parts.filter(F.col(name).isNotNull()).select(F.struct(F.col(id_col).alias("id")).alias("k"), F.col(name).cast("string").alias("name"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))

    def run(batches):
        now, held = None, {}
        for b in batches:
            out = []
            for k, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and k != now:
                    out.append((now["id"], write(list(held.items()))))
                    held = {}
                now = k
                held.setdefault(n, d)
            yield made(out, b)
            last = b
        if now is not None:
            yield made([(now["id"], write(list(held.items())))], last)

    def made(out, b):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field(0).type.field(0).type), pa.array([x[1] for x in out], pa.binary())], [id_col, "archive"])

    return rows.repartition(F.xxhash64("k")).sortWithinPartitions("k", "name", "data").mapInArrow(run, f"{id_col} {kind}, archive binary")


#: Record tags of a paragraph's header and text, and the entry that holds a document's body.
PARA_HEADER, PARA_TEXT, BODY = 66, 67, "BodyText/Section0"


def body_records(text: str | None) -> bytes:
    """A text as a record stream: for each line a header with its length, and below it the line in UTF-16."""
    lines = [] if text is None else text.split("\n")
    return b"".join(tree_record(PARA_HEADER, 0, struct.pack("<I", len(x))) + tree_record(PARA_TEXT, 1, x.encode("utf-16-le", "surrogatepass")) for x in lines)


def packed(docs: DataFrame, id_col: str, text_col: str, compound: str) -> DataFrame:
    """id_col, content: each text as a container, a compound file where the condition compound holds, else an archive. The body
    is a deflated record stream in either."""
    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a container a batch: texts may be long
                body = [(BODY, deflate(body_records(b.column(1)[i].as_py()))), ("FileHeader", b"quillon\0" + struct.pack("<I", 1)), (TYPE_ENTRY, b"application/x-quillon")]
                blob = (cfb_write if b.column(2)[i].as_py() else zip_write)(body)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([blob], pa.binary())], [id_col, "content"])

    return docs.select(id_col, text_col, F.coalesce(F.expr(compound), F.lit(False))).mapInArrow(run, f"{id_col} {kind}, content binary")
