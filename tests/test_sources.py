import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.sources import catalogs, wav
from sigloom.storage import new_folder
from sigloom.streaming import sinks, stateful


def test_wav_codec():
    t = np.arange(1000) / 11025
    stereo = np.stack([np.sin(2 * np.pi * 440 * t), np.cos(2 * np.pi * 440 * t)], 1) * 0.9
    rate, x = wav.decode(wav.encode(stereo, 11025))
    assert rate == 11025 and x.shape == (1000, 2) and np.abs(x - stereo).max() < 1e-4
    assert wav.decode(b"") is None and wav.decode(b"OggS" + b"\0" * 50) is None
    for bits, dtype, scale in ((8, "u1", 128), (32, "<i4", 2**31)):
        data = (np.array([0, 64, -64]) + (128 if bits == 8 else 0)).astype(dtype).tobytes()
        content = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 0, 0, bits) + b"data" + struct.pack("<I", len(data)) + data
        assert wav.decode(content)[1][:, 0] == pytest.approx(np.array([0, 64, -64]) / scale)


def test_files_chunks_and_metadata(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(np.linspace(-0.5, 0.5, 100_000), 22050))
    (tmp_path / "b.txt").write_bytes(b"text")
    files = wav.files(spark, str(tmp_path))
    meta = {r.uri.rsplit("/", 1)[-1]: r for r in wav.metadata(files).collect()}
    assert (meta["a.wav"].samplerate, meta["a.wav"].samples, meta["b.txt"].samplerate) == (22050, 100_000, None)
    chunks = wav.samples(files)
    assert [r.ix for r in chunks.orderBy("ix").collect()] == [0, wav.CHUNK] and wav.long_form(chunks).count() == 100_000
    assert one_of(spark, wav.chunk_bytes(F.lit(30 * 10**12), 22675736, 16, 2)) == int(30 * 10**12 / 22675736) * 4


def one_of(spark, c):
    return spark.range(1).select(c).first()[0]


def test_catalogs(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in (("x/examples.json", json.dumps({"n1": {"pitch": 3}}).encode()), ("x/n1.wav", b"1"), ("x/n2.wav", b"2")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = {r.stem: r for r in catalogs.archive(spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary")).collect()}
    assert json.loads(rows["n1"].meta) == {"pitch": 3} and rows["n2"].meta is None and bytes(rows["n2"].content) == b"2"
    f = lambda h: one_of(spark, catalogs.range_request(F.lit(h)))
    assert tuple(f("bytes=10-")) == ("bytes", 10.0, None) and tuple(f("bytes=10-100")) == ("bytes", 10.0, 100.0) and f("nonsense") is None
    with pytest.raises(Exception, match="unsupported range unit"):
        f("hours=1-2")
    with pytest.raises(Exception, match="needs a URI"):
        catalogs.metadata(spark.createDataFrame([(None,)], "u string"), "u").collect()
    pages = spark.createDataFrame([(1, '<a href="/x">x</a><a href="y">'), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.position, r.url) for r in catalogs.links(pages).collect()] == [(1, 0, "/x"), (1, 1, "y")]
    path = new_folder(spark, "store")
    assert catalogs.ingest(spark.range(3), path, "id").count() == 3 and catalogs.ingest(spark.range(5), path, "id").count() == 5
    (tmp_path / "m.csv").write_text("id,title\n1,a\n")
    assert catalogs.looked_up(spark.range(3), catalogs.csv(spark, str(tmp_path / "m.csv"), "id long, title string"), "id").count() == 1


def chunked(spark, rows, schema, sizes):
    """A stream whose files come one after another."""
    path = new_folder(spark, "chunks")
    at = 0
    for n in sizes:
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(path)
        at += n
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_frames_equal_batch(spark):
    from sigloom.operators import framing

    rows = [(1, i, float(i), i == 22) for i in range(23)]
    schema = "k int, ix long, value double, last boolean"
    got = sinks.drained(stateful.framed(chunked(spark, rows, schema, [8, 1, 10, 4]), ["k"], 8, 4)).collect()
    batch = framing.sliding_window(spark.createDataFrame(rows, schema), ["k"], 8, 4).collect()
    assert {r.frame: r.samples for r in got} == {r.frame: r.samples for r in batch} and len(got) == len(batch)


def test_streamed_flux_and_segments(spark):
    rows = [(1, i, [float(i * i)], i == 9) for i in range(10)]
    got = sinks.drained(stateful.flux(chunked(spark, rows, "k int, ix long, coeffs array<double>, last boolean", [3, 3, 4]), ["k"])).collect()
    assert {r.ix: r.flux for r in got} == {i: float(i * i - (i - 1) ** 2) if i else 0.0 for i in range(10)}
    rows = [(1, i, i in (3, 7), i == 9) for i in range(10)]
    got = sinks.drained(stateful.segments(chunked(spark, rows, "k int, ix long, peak boolean, last boolean", [5, 5]), ["k"], 10)).collect()
    assert sorted((r.start_ps, r.duration_ps) for r in got) == [(0, 30), (30, 40), (70, 30)]


def test_merged_streams_and_late_rows(spark):
    import datetime as dt

    t = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    rows = [(1, i, t(i), [float(i)]) for i in range(6)]
    schema = "k int, ix long, ts timestamp, coeffs array<double>"
    a, b = chunked(spark, rows, schema, [3, 3]), chunked(spark, rows[:4], schema, [2, 2])
    got = sinks.drained(stateful.merged(a, b, ["k"], "ts", "10 hours")).collect()
    assert {r.ix: r.coeffs for r in got} == {i: [i, i] for i in range(4)}
    late = [(t(0), 1.0), (t(30), 1.0), (t(31), 1.0), (t(1), 5.0)]
    stream = chunked(spark, late, "ts timestamp, value double", [1, 1, 1, 1])
    got = sinks.drained(stateful.event_windows(stream, "ts", "value", "1 hour", "1 hour")).collect()
    assert {r.start: r.total for r in got} == {t(0): 1.0}


def test_index_follows_a_stream_once(spark):
    schema = "index_id string, code array<long>"
    path, checkpoint, source = new_folder(spark, "index"), new_folder(spark, "offsets"), new_folder(spark, "entries")
    for ids in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(i, [1]) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
        sinks.follow(spark.readStream.schema(schema).parquet(source), path, checkpoint).awaitTermination()
    assert sorted(r.index_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
