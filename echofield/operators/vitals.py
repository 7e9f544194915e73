"""Vital signs: phase along slow time, displacement, spectra, and the reductions behind the usual figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.complexes import cabs, pair
from ..plans.contracts import require
from .cube import Cube


def unwrap_phase(df: DataFrame, series: list[str], order: str, phase: str, out: str = "value") -> DataFrame:
    """Jumps above pi (below -pi) take 2 pi off (add it) from there on."""
    w = Window.partitionBy(*series).orderBy(order)
    jump = F.col(phase) - F.lag(phase).over(w)
    turn = F.when(jump > math.pi, -2 * math.pi).when(jump < -math.pi, 2 * math.pi).otherwise(0.0)
    rows = df.withColumn("__turn", turn)
    total = F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.col(phase) + total).drop("__turn")


def extract_phase(df: DataFrame, series: list[str], order: str, remove_mean: bool = True) -> DataFrame:
    """(series..., order, value) from slow-time rows with re and im."""
    rows = unwrap_phase(df.withColumn("__phase", F.atan2("im", "re")), series, order, "__phase")
    if remove_mean:
        rows = rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*series)))
    return rows.select(*series, order, "value")


def extract_vital_sign_phase(cube: Cube, range_bin: int, selectors: dict[str, int], slow_axis: str = "frame", remove_mean: bool = True) -> DataFrame:
    """Phase of one range bin along slow time; every other axis of more than one bin needs a selector."""
    free = [a for a, n in cube.shape.items() if a not in ("range_bin", slow_axis) and n > 1]
    require(set(free) <= set(selectors), f"no selector for {sorted(set(free) - set(selectors))}")
    rows = cube.df.filter(F.col("range_bin") == range_bin)
    for axis, at in selectors.items():
        require(0 <= at < cube.shape[axis], f"{axis} has no bin {at}")
        rows = rows.filter(F.col(axis) == at)
    series = [k for k in cube.keys if k != slow_axis]
    return extract_phase(rows, series, slow_axis, remove_mean)


def phase_to_displacement(wave: DataFrame, wavelength_m: float) -> DataFrame:
    """phase * wavelength / (4 pi)."""
    require(wavelength_m > 0, "wavelength must be positive")
    return wave.withColumn("value", F.col("value") * F.lit(wavelength_m / (4 * math.pi)))


def amplitude_spectrum(wave: DataFrame, series: list[str], order: str) -> DataFrame:
    """(series..., bin, amplitude): Hann spectrum of the mean-free wave, one-sided.

    Scaled by 2 / sum of weights; the first bin, and the last of an even length, count half.
    """
    w = Window.partitionBy(*series)
    rows = wave.withColumns({
        "__i": F.row_number().over(w.orderBy(order)) - 1,
        "__n": F.count(F.lit(1)).over(w),
        "__x": F.col("value") - F.avg("value").over(w),
    })
    weight = F.when(F.col("__n") > 1, 0.5 - 0.5 * F.cos(2 * math.pi * F.col("__i") / (F.col("__n") - 1))).otherwise(1.0)
    rows = rows.withColumn("__w", weight).withColumn("bin", F.explode(F.sequence(F.lit(0), F.floor(F.col("__n") / 2).cast("int"))))
    angle = 2 * math.pi * ((F.col("bin") * F.col("__i")) % F.col("__n")) / F.col("__n")
    sums = rows.groupBy(*series, "bin").agg(
        F.first("__n").alias("n"),
        F.sum("__w").alias("w"),
        F.sum(F.col("__x") * F.col("__w") * F.cos(angle)).alias("c"),
        F.sum(F.col("__x") * F.col("__w") * F.sin(angle)).alias("s"),
    )
    half = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == F.col("n")), 0.5).otherwise(1.0)
    return sums.select(*series, "bin", (2 * half * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("w")).alias("amplitude"))


def display_scale(magnitude: Column, scale: str = "db") -> Column:
    """magnitude, power, or 20 log10 of the magnitude above the smallest positive double."""
    require(scale in ("magnitude", "power", "db"), f"unknown scale {scale}")
    if scale == "magnitude":
        return magnitude
    if scale == "power":
        return magnitude * magnitude
    return 20 * F.log10(F.greatest(magnitude, F.lit(2.2250738585072014e-308)))


def mean_magnitude_map(cube: Cube, *axes: str) -> DataFrame:
    """(axes..., magnitude): mean absolute value over everything else."""
    return cube.df.groupBy(*axes).agg(F.avg(cabs(pair())).alias("magnitude"))


def waveform_axis(rate_hz: float, start_s: float, order: Column) -> Column:
    """Time of a sample."""
    require(rate_hz > 0, "sample rate must be positive")
    return F.lit(start_s) + order / F.lit(rate_hz)
