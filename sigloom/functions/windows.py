"""Window functions as constant arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from .arrays import times


def oggvorbis(n: int) -> np.ndarray:
    """The power-complementary window of the Vorbis I specification, its greatest value 1."""
    w = np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(n) + 0.5) / n) ** 2)
    return w / w.max()


def hann(n: int) -> np.ndarray:
    return np.hanning(n)


def periodic_hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def identity(n: int) -> np.ndarray:
    return np.ones(n)


def windowed(a: Column, n: int, window=None) -> Column:
    """A frame of n samples times a window; None leaves it as it is."""
    return a if window is None else times(a, window(n))
