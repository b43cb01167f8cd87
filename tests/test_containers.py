"""Containers: round trips, archives that a library reads, damage as typed errors, record trees."""

import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.sources import containers as C

SIZES = [0, 1, 63, 64, 65, 500, 4095, 4096, 5000, 70_000]


def streams(rnd):
    return [(p, rnd.randbytes(rnd.choice(SIZES))) for p in rnd.sample(["A", "B/x", "B/y", "C/D/e", "LongName12", "z", "Ünïcode/é"], rnd.randrange(6))]


def test_round_trips():
    rnd = random.Random(1)
    for _ in range(60):
        s = streams(rnd)
        assert list(C.cfb_read(C.cfb_write(s))) == [(p, d, None) for p, d in sorted(s)]
        packed = C.zip_write(s)
        assert list(C.zip_read(packed)) == [(p, d, None) for p, d in sorted(s)]
        with zipfile.ZipFile(io.BytesIO(packed)) as z:
            assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == sorted(s)


def test_tables_beyond_the_header():
    big = random.Random(2).randbytes(9_000_000)
    assert list(C.cfb_read(C.cfb_write([("big", big), ("s", b"x" * 10)]))) == [("big", big, None), ("s", b"x" * 10, None)]


def test_archives_of_others_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 in a comment"[4:]
        z.writestr("stored", b"abc", zipfile.ZIP_STORED)
        z.writestr("dir/deflated é", b"abc" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("other", b"abc", zipfile.ZIP_BZIP2)
    assert list(C.zip_read(out.getvalue())) == [("stored", b"abc", None), ("dir/deflated é", b"abc" * 1000, None), ("other", None, "unknown_method")]


def test_archive_has_no_clock_and_a_fixed_order():
    a = C.zip_write([("b", b"1"), ("mimetype", b"t"), ("a", b"2")])
    assert a == C.zip_write([("a", b"2"), ("b", b"1"), ("mimetype", b"t")])
    infos = zipfile.ZipFile(io.BytesIO(a)).infolist()
    assert [i.filename for i in infos] == ["mimetype", "a", "b"] and infos[0].compress_type == zipfile.ZIP_STORED
    assert {i.date_time for i in infos} == {(1980, 1, 1, 0, 0, 0)} and a[26:30] == struct.pack("<HH", 8, 0)


def errors(blob, limit=C.LIMIT):
    return [(p, e) for _, p, _, e in C.read(blob, limit)]


def test_damage_has_codes():
    z = C.zip_write([("a", b"x" * 5000), ("b", b"y")])
    at = z.index(C.ZIP_ENTRY)
    broken = lambda b, i, v: b[:i] + v + b[i + len(v) :]
    assert errors(b"") == [(None, "empty")] == errors(None) and errors(b"%PDF") == [(None, "unknown_format")]
    assert errors(z[:-22]) == [(None, "no_directory")] and errors(broken(z, at, b"XX")) == [(None, "bad_directory")]
    assert errors(broken(z, at + 8, b"\x01")) == [("a", "encrypted"), ("b", None)] and errors(broken(z, at + 16, b"\0\0\0\0")) == [("a", "bad_checksum"), ("b", None)]
    assert errors(broken(z, 40, b"\xff\xff\xff\xff"))[0] in {("a", "bad_data"), ("a", "bad_checksum")} and errors(z, limit=100) == [("a", "too_large"), ("b", None)]
    c = C.cfb_write([("a", bytes(9000)), ("s", b"y" * 10)])
    assert errors(broken(c, 30, b"\xff")) == [(None, "bad_header")] and errors(c[:40]) == [(None, "bad_header")]
    assert errors(broken(c, 48, struct.pack("<I", 9999))) == [(None, "bad_chain")]
    fat = 512 * (1 + struct.unpack_from("<I", c, 76)[0])
    assert errors(broken(c, fat, struct.pack("<I", 0))) == [("a", "looping_chain"), ("s", None)]
    assert errors(broken(c, fat + 4, struct.pack("<I", C.END))) == [("a", "short_chain"), ("s", None)]
    assert errors(c, limit=100) == [("a", "too_large"), ("s", None)]
    first_dir = 512 * (1 + struct.unpack_from("<I", c, 48)[0])
    assert errors(broken(c, first_dir + 128 + 68, struct.pack("<I", 1))) == [(None, "looping_directory")]


def test_any_damage_gives_rows():
    """Whatever bytes are changed or cut off, reading ends with rows."""
    rnd = random.Random(3)
    for _ in range(1500):
        s = [(p, rnd.randbytes(rnd.choice(SIZES[:8]))) for p in ("A", "B/x", "c")]
        blob = bytearray(rnd.choice([C.cfb_write, C.zip_write])(s))
        for _ in range(rnd.randrange(4)):
            blob[rnd.randrange(8, len(blob))] = rnd.randrange(256)
        for row in C.read(bytes(blob[: rnd.choice([len(blob), rnd.randrange(len(blob))])])):
            assert (row[2] is None) == (row[3] is not None)


def test_record_trees():
    rnd = random.Random(4)
    for _ in range(200):
        want, data, open_ = [], b"", {}
        level = 0
        for n in range(rnd.randrange(12)):
            level = rnd.randrange(level + 2)
            payload = rnd.randbytes(rnd.choice([0, 3, 4094, 4095, 5000]))
            open_ = {k: v for k, v in open_.items() if k < level}
            want.append((n, 60 + n, level, open_[max(open_)] if open_ else None, payload, None))
            open_[level] = n
            data += C.tree_record(60 + n, level, payload)
        assert list(C.tree_records(data)) == want
        if data:
            assert list(C.tree_records(data[:-1]))[-1][-1] in ("truncated", None)
    assert [r[-1] for r in C.tree_records(b"\x01")] == ["truncated"] and list(C.tree_records(b"")) == []


def test_frames(spark):
    rows = [(1, "mimetype", b"t"), (1, "b", b"2"), (1, "a", None), (1, "a", None), (None, "x", b"n"), (2, None, b"lost")]
    df = spark.createDataFrame(rows, "id long, name string, data binary").withColumn("k", F.lit("clash")).withColumn("archive", F.lit("clash"))
    got = {r["id"]: bytes(r["archive"]) for r in C.archives(df, "id", "name", "data").collect()}
    assert got == {1: C.zip_write([("mimetype", b"t"), ("a", b""), ("b", b"2")]), None: C.zip_write([("x", b"n")])}
    assert got == {r["id"]: bytes(r["archive"]) for r in C.archives(df.repartition(5).orderBy(F.desc("name")), "id", "name", "data").collect()}
    blobs = spark.createDataFrame([(1, got[1]), (1, got[1]), (2, None), (3, b"")], "id long, b binary").withColumn("entry", F.lit("clash"))
    assert sorted((r["id"], r["entry"] or "", r["error"] or "") for r in C.entries(blobs, "id", "b").collect()) == [(1, "a", ""), (1, "a", ""), (1, "b", ""), (1, "b", ""), (1, "mimetype", ""), (1, "mimetype", ""), (2, "", "empty"), (3, "", "empty")]
    assert C.archives(df.limit(0), "id", "name", "data").count() == C.entries(blobs.limit(0), "id", "b").count() == 0


@pytest.mark.parametrize("compound", ["true", "false"])
def test_long_texts(spark, compound):
    text = "\n".join(f"line {i} é퟿" * 20 for i in range(20_000))
    c = C.packed(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text", compound)
    body = C.entries(c, "id", "content").filter(F.col("entry") == C.BODY)
    got = C.record_trees(body, "id", "content", compressed=True).filter(F.col("tag") == C.PARA_TEXT).select("id", "ordinal", F.decode("payload", "UTF-16LE").alias("t")).collect()
    assert "\n".join(r["t"] for r in sorted(got, key=lambda r: r["ordinal"]) if r["id"] == 1) == text and [r["t"] for r in got if r["id"] == 3] == [""] and not [r for r in got if r["id"] == 2]
    assert zlib.crc32(text.encode()) != 0
