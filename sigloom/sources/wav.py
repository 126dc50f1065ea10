"""PCM WAV files as sources and sinks; other codecs stay bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples in a decoded row.
CHUNK = 1 << 16

META = "uri string, samplerate int, channels int, bits int, samples long"


def header(content: bytes) -> dict | None:
    """Format of a RIFF file and where its samples are; None if it isn't PCM WAV."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, found = 12, {}
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and size >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels:
                return None
            found |= {"samplerate": rate, "channels": channels, "bits": bits}
        elif name == b"data" and found:
            size = min(size, len(content) - at - 8)
            width = found["channels"] * found["bits"] // 8
            return found | {"at": at + 8, "samples": size // width}
        at += 8 + size + size % 2
    return None


def decode(content: bytes) -> tuple[int, np.ndarray] | None:
    """Sample rate and samples (rows) by channels in [-1, 1)."""
    h = header(content)
    if h is None:
        return None
    raw = np.frombuffer(content, np.uint8, h["samples"] * h["channels"] * h["bits"] // 8, h["at"])
    if h["bits"] == 8:
        x = (raw.astype(float) - 128) / 128
    elif h["bits"] == 24:
        b = raw.reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    else:
        x = raw.view(f"<i{h['bits'] // 8}").astype(float) / float(1 << (h["bits"] - 1))
    return h["samplerate"], x.reshape(-1, h["channels"])


def encode(x: np.ndarray, samplerate: int) -> bytes:
    """Samples by channels as 16-bit PCM."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    data = np.clip(np.rint(x * 32767), -32768, 32767).astype("<i2").tobytes()
    channels = x.shape[1]
    fmt = struct.pack("<HHIIHH", 1, channels, samplerate, samplerate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files under a path."""
    return spark.read.format("binaryFile").load(path)


def metadata(binary: DataFrame) -> DataFrame:
    """uri, samplerate, channels, bits, samples of each WAV file; other files have null formats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *(h.get(k) for k in ("samplerate", "channels", "bits", "samples"))) for p, c in zip(b.path, b.content, strict=True) for h in [header(bytes(c)) or {}]]
            yield pd.DataFrame(rows, columns=["uri", "samplerate", "channels", "bits", "samples"], dtype=object)

    return binary.select("path", "content").mapInPandas(run, META)


def samples(binary: DataFrame, mono: bool = False) -> DataFrame:
    """clip, samplerate, channel, ix (of the chunk's first sample), samples: decoded files in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                got = decode(bytes(content))
                if got is None:
                    continue
                rate, x = got
                x = x.mean(1, keepdims=True) if mono else x
                for at in range(0, len(x), CHUNK):
                    part = x[at : at + CHUNK]
                    yield pd.DataFrame({"clip": path, "samplerate": rate, "channel": range(x.shape[1]), "ix": at, "samples": list(part.T)})

    return binary.select("path", "content").mapInPandas(run, "clip string, samplerate int, channel int, ix long, samples array<double>")


def long_form(chunks: DataFrame) -> DataFrame:
    """clip, channel, ix, value: one row a sample."""
    made = chunks.select("clip", "channel", F.col("ix").alias("__at"), F.posexplode("samples").alias("__p", "value"))
    return made.select("clip", "channel", (F.col("__at") + F.col("__p")).alias("ix"), "value")


def encoded(df: DataFrame, by: list[str], samplerate: int, ix: str = "ix", value: str = "value") -> DataFrame:
    """by, content: each mono series as a WAV file's bytes."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ix)[value].to_numpy(float)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "content": [encode(x, samplerate)]})

    return df.groupBy(*by).applyInPandas(run, f"{keys}, content binary")


def chunk_bytes(duration_ps: Column, frequency: int, bit_depth: int, channels: int) -> Column:
    """Bytes of a stretch of PCM."""
    return F.floor(duration_ps / frequency) * (bit_depth // 8) * channels
