"""Companding, units and pitch as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def log_modulus(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def inverse_log_modulus(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def decibel(x: Column) -> Column:
    return F.when(x > 0, 20 * F.log10(x))


def mu_law(x: Column, mu: float = 255.0) -> Column:
    return F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(float(mu)))


def inverse_mu_law(y: Column, mu: float = 255.0) -> Column:
    return F.signum(y) * F.expm1(F.abs(y) * F.log1p(F.lit(float(mu)))) / mu


def safe_log(x: Column, epsilon: float = 1e-12) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("the logarithm of a negative number"))).otherwise(F.log(x + epsilon))


def hz_to_bark(hz: Column) -> Column:
    return 6 * F.asinh(hz / 600)


def bark_to_hz(bark: Column) -> Column:
    return 600 * F.sinh(bark / 6)


def hz_to_mel(hz: Column) -> Column:
    return 1127 * F.log1p(hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * F.expm1(mel / 1127)


def erb(hz: Column) -> Column:
    return hz * 0.108 + 24.7


def semitones(hz: Column, concert: float = 440.0) -> Column:
    return 12 * F.log2(hz / concert)


def midi_to_note(n: Column) -> Column:
    names = F.array(*map(F.lit, NOTES))
    return F.concat(F.element_at(names, F.pmod(n, F.lit(12)).cast("int") + 1), F.floor(n / 12).cast("string"))


def note_to_midi(note: Column) -> Column:
    """Null for what is not a note."""
    name = F.regexp_extract(note, r"^([A-G]#?)(\d+)$", 1)
    octave = F.regexp_extract(note, r"^([A-G]#?)(\d+)$", 2)
    at = F.array_position(F.array(*map(F.lit, NOTES)), name)
    return F.when(at > 0, octave.cast("long") * 12 + at - 1)


def feature_map_size(n: Column, kernel: int, stride: int = 1, padding: int = 0) -> Column:
    return F.floor((n - kernel + 2 * padding) / stride) + 1


def content_range(unit: str, start: Column, stop: Column, total: Column) -> Column:
    return F.format_string(f"{unit} %d-%d/%d", start, stop, total)
