import gzip
import hashlib
import io
import json
import os
from collections import Counter

import pytest

from sigloom.llm.shared import new_path
from sigloom.llm.warc import from_pages, normalise, normalise_files, op7_warc, read_at, record

from .common import clashing

ROWS = [(1, "http://a/1", "<p>ü</p>"), (2, None, None), (None, "http://a/\r\n2", ""), (4, "http://a/4", "x" * 3_000_000), (4, "http://a/4", "WARC/1.1\r\n\r\n"), (5, "http://a/5", "\r\n\r\n")]


@pytest.mark.parametrize("cut", ["one", "each", "mixed"])
def test_round_trip_in_memory(cut, tmp_path):
    raw = [record(*r) for r in ROWS]
    source = {"one": gzip.compress(b"".join(raw)), "each": b"".join(map(gzip.compress, raw)), "mixed": gzip.compress(b"".join(raw[:2])) + gzip.compress(b"".join(raw[2:]))}[cut]
    out = io.BytesIO()
    rows = normalise(io.BytesIO(source), out, "f")
    assert gzip.decompress(out.getvalue()) == b"".join(raw)
    (tmp_path / "f").write_bytes(out.getvalue())
    for r, (_, url, html) in zip(rows, ROWS, strict=True):
        fields, body = read_at(str(tmp_path / "f"), r["offset"], r["length"])
        assert body.decode() == (html or "") and r["uri"] == (url and url.replace("\r\n", "%0D%0A")) == fields.get("warc-target-uri")
    assert rows[-1]["offset"] + rows[-1]["length"] == len(out.getvalue())


def test_damage_keeps_the_records_before_it():
    raw = gzip.compress(record(1, "http://a", "ok")) + gzip.compress(record(2, "http://b", os.urandom(200_000).hex()))
    out = io.BytesIO()
    assert [r["type"] for r in normalise(io.BytesIO(raw[:-9000]), out, "f")] == ["resource", "damaged"]
    assert gzip.decompress(out.getvalue()) == record(1, "http://a", "ok")
    assert normalise(io.BytesIO(raw[:-200] + b"\0" * 200), io.BytesIO(), "f")[-1]["type"] == "damaged"
    assert normalise(io.BytesIO(b""), io.BytesIO(), "f") == []
    assert [r["type"] for r in normalise(io.BytesIO(gzip.compress(b"junk\r\n\r\n")), io.BytesIO(), "f")] == ["damaged"]


def read_plainly(data: bytes) -> list[tuple[bytes | None, bytes]]:
    """URI and payload of every record of an uncompressed WARC file, by the standard's grammar alone."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        size = int(fields[b"Content-Length"])
        out.append((fields.get(b"WARC-Target-URI"), data[end + 4 : end + 4 + size]))
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    return out


def test_query_equals_a_plain_reader(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "x" * (i * 37 % 501) + "é\r\n\r\nWARC/1.1\r\n") for i in range(300)] + [(None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_warc(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.uri, r.payload_bytes, r.sha1) for r in got) == Counter((i, u, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h in rows)
    by = {}
    for r in got:
        by.setdefault(r.file, []).append(r)
    for members in by.values():  # members lie end to end, in order
        members.sort(key=lambda r: r.record)
        assert [m.record for m in members] == list(range(len(members)))
        assert all(a.offset + a.length == b.offset for a, b in zip(members, members[1:]))
    raw, out = new_path(spark, "raw"), new_path(spark, "out")
    (path,) = from_pages(spark.read.parquet(f"{tmp_path}/pages.parquet").coalesce(1), raw)
    normalise_files(spark, [path], out)
    source, target = (open(f"{f.removeprefix('file://')}/{path.rsplit('/', 1)[1]}", "rb").read() for f in (raw, out))
    plain = read_plainly(gzip.decompress(source))
    assert plain == read_plainly(gzip.decompress(target)) and Counter(plain) == Counter((u and u.encode(), (h or "").encode()) for _, u, h in rows)


def test_records_after_damage_are_found_again():
    members = [gzip.compress(record(i, f"http://a/{i}", os.urandom(3000).hex())) for i in range(6)]
    for hurt, chunk in ((1, None), (3, None), (3, 7)):
        broken = bytearray(members[hurt])
        broken[200:260] = b"\xff" * 60
        whole = b"".join([*members[:hurt], bytes(broken), *members[hurt + 1 :]])
        source = io.BytesIO(whole)
        if chunk:
            read = source.read
            source.read = lambda n: read(chunk)
        out = io.BytesIO()
        rows = normalise(source, out, "f")
        assert [r["uri"] for r in rows if r["type"] != "damaged"] == [f"http://a/{i}" for i in range(6) if i != hurt]
        assert sum(r["type"] == "damaged" for r in rows) == 1
        assert gzip.decompress(out.getvalue()) == b"".join(gzip.decompress(m) for i, m in enumerate(members) if i != hurt)
    text = record(1, "http://a/1", "ok") + b"WARC/1.1\r\nno length\r\n\r\nlost\r\n\r\n" + record(2, "http://a/2", "ok")
    assert [r["type"] for r in normalise(io.BytesIO(gzip.compress(text)), io.BytesIO(), "f")] == ["resource", "damaged", "resource"]


def test_a_url_of_megabytes_takes_no_other_record_with_it():
    rows = [(1, "http://a/1", "a"), (2, "http://a/" + "x" * 5_000_000, "b"), (3, "http://a/3", "c")]
    found = normalise(io.BytesIO(gzip.compress(b"".join(record(*r) for r in rows))), io.BytesIO(), "f")
    assert [r["uri"] for r in found] == [r[1] for r in rows]


def test_files_and_sidecars(spark):
    pages = clashing(spark.createDataFrame(ROWS, "page_id long, url string, html string")).repartition(3)
    raw, out = new_path(spark, "raw"), new_path(spark, "out")
    index = normalise_files(spark, from_pages(pages, raw), out).collect()
    assert len(index) == len(ROWS)
    for _ in range(2):  # again: the same bytes
        folder = out.removeprefix("file://")
        files = {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if not f.startswith(".")}
        for r in index:
            assert json.loads(files[f"{r.file}.idx"].splitlines()[r.record])["offset"] == r.offset
            assert gzip.decompress(files[r.file][r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\n")
        again = {tuple(r) for r in normalise_files(spark, sorted(f"{raw}/{f}" for f in files if not f.endswith(".idx")), out).collect()}
        assert again == {tuple(r) for r in index}


def test_empty_table(spark):
    paths = from_pages(spark.createDataFrame([], "page_id long, url string, html string"), new_path(spark, "raw"))
    assert paths == [] and normalise_files(spark, paths, new_path(spark, "out")).count() == 0
