"""Onset functions and segments over the frames of each series."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def _over(by: list[str], ix: str):
    return Window.partitionBy(*by).orderBy(ix)


def flux(df: DataFrame, by: list[str], ix: str = "ix", value: str = "coeffs", unit: bool = False) -> DataFrame:
    """Distance from the frame before; 0 for the first."""
    a = A.unit_norm(F.col(value)) if unit else F.col(value)
    made = df.withColumn("__a", a)
    before = F.coalesce(F.lag("__a").over(_over(by, ix)), F.col("__a"))
    return made.withColumn("__b", before).withColumn("flux", A.euclidean(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def transience(df: DataFrame, by: list[str], ix: str = "ix", value: str = "coeffs") -> DataFrame:
    """Growth of the high-frequency content times its ratio to the energy."""
    made = df.withColumns({"__e": A.energy(F.col(value)), "__h": A.high_frequency_content(F.col(value))})
    before = F.coalesce(F.lag("__h").over(_over(by, ix)), F.col("__h"))
    return made.withColumn("transience", F.col("__h") / before * (F.col("__h") / F.col("__e"))).drop("__e", "__h")


def complex_domain(df: DataFrame, by: list[str], ix: str = "ix", magnitude: str = "magnitude", phase: str = "phase") -> DataFrame:
    """Distance of each frame from the one that the two before predict; 0 for the first two."""
    w = _over(by, ix)
    made = df.withColumns({"__m1": F.lag(magnitude).over(w), "__p1": F.lag(phase).over(w), "__p2": F.lag(phase, 2).over(w)})
    turn = F.zip_with(F.zip_with(F.col(phase), F.col("__p1"), lambda a, b: a - 2 * b), F.col("__p2"), lambda a, b: a + b)
    turn = F.transform(turn, lambda t: F.atan2(F.sin(t), F.cos(t)))
    off = F.zip_with(F.arrays_zip(F.col(magnitude).alias("m"), F.col("__m1").alias("n")), turn, lambda s, t: F.sqrt(F.greatest(s["m"] * s["m"] + s["n"] * s["n"] - 2 * s["m"] * s["n"] * F.cos(t), F.lit(0.0))))
    return made.withColumn("onset", F.when(F.col("__p2").isNotNull(), A.total(off)).otherwise(0.0)).drop("__m1", "__p1", "__p2")


def _at(value: str, offset: int, w) -> Column:
    c = F.col(value)
    return F.coalesce(c if offset == 0 else F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w), F.lit(0.0))


def peaks(df: DataFrame, by: list[str], window: int = 11, before: int = 5, threshold: float = 1.25, how: str = "mean", ix: str = "ix", value: str = "value") -> DataFrame:
    """df with ``peak``: the row before is a local maximum and the row exceeds a multiple of the moving mean or median.

    The frame holds ``before`` rows before and fills up with zeros outside of the
    series, as a padded stream does.
    """
    w = _over(by, ix)
    cells = F.array(*[_at(value, o, w) for o in range(-before, window - before)])
    made = df.withColumn("__f", cells)
    c = window // 2
    x = lambda k: F.element_at("__f", c + 1 + k)
    ordered = F.array_sort("__f")
    middle = F.element_at(ordered, window // 2 + 1) if window % 2 else (F.element_at(ordered, window // 2) + F.element_at(ordered, window // 2 + 1)) / 2
    # the threshold goes before the division: rows that equal it exactly are decided by the last bit
    least = threshold * A.total(F.col("__f")) / window if how == "mean" else threshold * middle
    found = (x(-1) - x(-2) > 0) & (x(0) - x(-1) < 0) & (x(0) > least)
    return made.withColumn("peak", found).drop("__f")


def segments(df: DataFrame, by: list[str], frequency: int, ix: str = "ix", peak: str = "peak") -> DataFrame:
    """by, start_ps, duration_ps: the stretches that the peaks cut each series into, from its beginning to its end."""
    ends = df.groupBy(*by).agg(((F.max(ix) + 1) * frequency).alias("__end"))
    cuts = df.where(F.col(peak)).select(*by, (F.col(ix) * frequency).alias("start_ps")).unionByName(ends.select(*by, F.lit(0).cast("long").alias("start_ps"))).distinct()
    w = Window.partitionBy(*by).orderBy("start_ps")
    return cuts.join(ends, by).select(*by, "start_ps", (F.coalesce(F.lead("start_ps").over(w), F.col("__end")) - F.col("start_ps")).alias("duration_ps"))


def phase_accumulated(df: DataFrame, by: list[str], ix: str = "ix", value: str = "value") -> DataFrame:
    """Running sum of each series."""
    return df.withColumn("phase", F.sum(value).over(_over(by, ix).rowsBetween(Window.unboundedPreceding, 0)))


def unwrapped(df: DataFrame, by: list[str], ix: str = "ix", value: str = "phase") -> DataFrame:
    """Phases without jumps of more than half a turn, and their central difference."""
    w = _over(by, ix)
    turn = 2 * 3.141592653589793
    jump = F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value))
    made = df.withColumn("__k", -F.round(jump / turn))
    made = made.withColumn("unwrapped", F.col(value) + turn * F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__k")
    return made.withColumn("gradient", _slope(w))


def rainbowgram(df: DataFrame, by: list[str], ix: str = "ix", re: str = "re", im: str = "im") -> DataFrame:
    """by, ix, colors: red, green and blue of every bin, flat; hue is the phase's change in time, brightness the log magnitude.

    Both are scaled to [0, 1] over the whole series (constant ones are 0).  The hue's
    scale has 256 steps from violet to red.
    """
    bins = df.select(*by, ix, F.posexplode(F.arrays_zip(F.col(re).alias("re"), F.col(im).alias("im"))).alias("__bin", "z"))
    made = bins.select(*by, ix, "__bin", F.log1p(F.abs(F.col("z.re")) * 1000).alias("__m"), F.atan2("z.im", "z.re").alias("phase"))
    made = unwrapped(made, [*by, "__bin"], ix)
    ends = made.groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in ("__m", "gradient") for n, f in (("low", F.min), ("high", F.max))])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = made.alias("a").join(ends.alias("b"), functools.reduce(lambda p, q: p & q, same, F.lit(True)))
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__low_{c}"), F.col(f"__high_{c}") - F.col(f"__low_{c}")), F.lit(0.0))
    hue = F.least(F.floor(unit("gradient") * 256), F.lit(255)) / 255
    rgb = F.array(*[F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * unit("__m") for x in (F.abs(2 * hue - 0.5), F.sin(hue * math.pi), F.cos(hue * math.pi / 2))])
    cells = both.select(*[F.col(f"a.{c}").alias(c) for c in by], ix, F.struct("__bin", rgb.alias("rgb")).alias("cell"))
    return cells.groupBy(*by, ix).agg(F.flatten(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["rgb"])).alias("colors"))


def _slope(w) -> Column:
    last, nxt = F.lag("unwrapped").over(w), F.lead("unwrapped").over(w)
    return F.when(last.isNull() & nxt.isNull(), 0.0).when(last.isNull(), nxt - F.col("unwrapped")).when(nxt.isNull(), F.col("unwrapped") - last).otherwise((nxt - last) / 2)
