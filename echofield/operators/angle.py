"""Angles of arrival, and Cartesian points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.complexes import cabs, pair
from ..plans.contracts import Fft, Projection, Subarray, require
from .cube import Cube, fft_axis, select_virtual_subarray


def spacing_of(positions: list[tuple[float, float, float]], axis: int) -> float:
    """The uniform, positive spacing of a linear array along x (0) or z (2); other coordinates are constant."""
    require(len(positions) > 1, "one antenna has no spacing")
    for other in {0, 1, 2} - {axis}:
        require(all(abs(p[other] - positions[0][other]) <= 1e-8 + 1e-5 * abs(positions[0][other]) for p in positions), "the array is not a line")
    steps = [b[axis] - a[axis] for a, b in zip(positions, positions[1:])]
    require(steps[0] > 0 and all(abs(s - steps[0]) <= 1e-8 + 1e-5 * abs(steps[0]) for s in steps), "the spacing is not uniform and positive")
    return steps[0]


def frequency_of_bin(bin_: Column, n: int, shifted: bool) -> Column:
    """DFT frequency in cycles per antenna."""
    k = bin_ - n // 2 if shifted else F.when(bin_ < (n + 1) // 2, bin_).otherwise(bin_ - n)
    return k / F.lit(float(n))


def angle_of_bin(bin_: Column, n: int, spacing: float, shifted: bool = True) -> Column:
    """asin(frequency / spacing); a bin beyond the visible region is an error."""
    s = frequency_of_bin(bin_, n, shifted) / F.lit(spacing)
    return F.when(F.abs(s) <= 1, F.asin(s)).otherwise(F.raise_error(F.lit("a bin beyond the visible angles")).cast("double"))


def angle_bins(spark: SparkSession, n: int, positions: list[tuple[float, float, float]], axis: str = "azimuth", shifted: bool = True) -> DataFrame:
    """(bin, angle_rad) of every bin."""
    spacing = spacing_of(positions, 0 if axis == "azimuth" else 2)
    bins = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    return bins.select("bin", angle_of_bin(F.col("bin"), n, spacing, shifted).alias("angle_rad"))


def candidate_cells(cube: Cube, detections: DataFrame) -> Cube:
    """The cube's cells at detections only, the small side first: transforms then run on candidates alone."""
    cells = detections.select(*cube.keys, "range_bin", "doppler_bin").distinct()
    df = cube.df.join(cells, [*cube.keys, "range_bin", "doppler_bin"], "left_semi")
    return Cube(df, cube.shape, cube.keys)


def estimate_candidate_azimuths(cube: Cube, detections: DataFrame, spec: Fft, azimuth: Subarray) -> DataFrame:
    """Adds azimuth_bin, azimuth_rad and angle_magnitude: the first strongest bin of each detection's antennas."""
    cut = [*cube.keys, "range_bin", "doppler_bin"]
    lines = select_virtual_subarray(candidate_cells(cube, detections), azimuth)
    spectrum = fft_axis(lines, "virtual_rx", "azimuth_bin", spec)
    n = spectrum.shape["azimuth_bin"]
    spacing = spacing_of(list(azimuth.positions), 0)
    # NaN sorts first, as the strongest; ties go to the lower bin
    strongest = Window.partitionBy(*cut).orderBy(F.desc("angle_magnitude"), "azimuth_bin")
    best = (
        spectrum.df.withColumn("angle_magnitude", cabs(pair()))
        .withColumn("__rank", F.row_number().over(strongest))
        .filter(F.col("__rank") == 1)
        .select(*cut, "azimuth_bin", "angle_magnitude")
    )
    rad = angle_of_bin(F.col("azimuth_bin"), n, spacing, spec.fftshift)
    extra = [c for c in detections.columns if c not in cut]
    return detections.join(best, cut).select(*cut, "azimuth_bin", rad.alias("azimuth_rad"), *extra, "angle_magnitude")


def estimate_candidate_elevations(cube: Cube, detections: DataFrame, spec: Fft, azimuth: Subarray, elevation: Subarray) -> DataFrame:
    """Adds elevation_rad and elevation_magnitude from the phase between two horizontal rows.

    The phase of the elevation row against the azimuth row, both at the azimuth bin, less the part from their
    horizontal offset, is a vertical direction cosine modulo 1 / |dz|; detections without a real angle go.
    """
    cut = [*cube.keys, "range_bin", "doppler_bin"]
    a, e = azimuth.positions, elevation.positions
    dx, dz = e[0][0] - a[0][0], e[0][2] - a[0][2]
    step_a, step_e = spacing_of(list(a), 0), spacing_of(list(e), 0)
    require(abs(step_a - step_e) <= 1e-8 + 1e-5 * abs(step_a), "both rows need one spacing")
    require(abs(a[0][1] - e[0][1]) <= 1e-8 and dz != 0 and abs(dz) <= 0.5, "rows need the same y and a height of at most half a wavelength")
    candidates = candidate_cells(cube, detections)
    rows = {}
    for name, row in (("a", azimuth), ("e", elevation)):
        spectrum = fft_axis(select_virtual_subarray(candidates, row), "virtual_rx", "azimuth_bin", Fft(spec.n_fft or len(azimuth.indices), spec.window, spec.fftshift))
        rows[name] = spectrum.df.select(*cut, "azimuth_bin", F.col("re").alias(f"{name}_re"), F.col("im").alias(f"{name}_im"))
    both = detections.join(rows["a"], [*cut, "azimuth_bin"]).join(rows["e"], [*cut, "azimuth_bin"])
    cross = F.col("e_im") * F.col("a_re") - F.col("e_re") * F.col("a_im")
    dot = F.col("e_re") * F.col("a_re") + F.col("e_im") * F.col("a_im")
    phase = F.atan2(cross, dot) / F.lit(2 * math.pi)
    lateral = F.sin("azimuth_rad")
    period = 1.0 / abs(dz)
    vertical = F.pmod((phase - F.lit(dx) * lateral) / F.lit(dz) + F.lit(period / 2), F.lit(period)) - F.lit(period / 2)
    out = both.withColumn("__v", vertical)
    real = (F.abs("__v") <= 1 + 1e-6) & (lateral * lateral + F.col("__v") * F.col("__v") <= 1 + 1e-6)
    angle = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__v"))))
    strength = F.sqrt(F.col("e_re") * F.col("e_re") + F.col("e_im") * F.col("e_im"))
    return out.filter(real).select(*detections.columns, angle.alias("elevation_rad"), strength.alias("elevation_magnitude"))


def doppler_velocity(bin_: Column, spec: Projection) -> Column:
    """Velocity of a (fractional) Doppler bin."""
    b = bin_.cast("double")
    if spec.center_doppler:
        n = float(spec.doppler_bins)
        b = b - float(spec.doppler_bins // 2) if spec.doppler_fftshifted else F.pmod(b + F.lit(n / 2), F.lit(n)) - F.lit(n / 2)
    return b * F.lit(spec.doppler_resolution_mps)


def detections_to_points(detections: DataFrame, spec: Projection = Projection(), keys: tuple[str, ...] = ("capture_id", "frame")) -> DataFrame:
    """x, y, z, velocity, range, angles and magnitude of each detection.

    x = R sin(az), z = R sin(el), y = R sqrt(1 - lateral^2 - vertical^2); below -1e-5 the angles contradict
    each other, which is an error.
    """
    names = detections.columns
    lateral = F.sin("azimuth_rad")
    vertical = F.sin("elevation_rad") if "elevation_rad" in names else F.lit(0.0)
    rows = detections.withColumns({
        "__r": F.col("range_bin") * F.lit(spec.range_resolution_m),
        "__lat": lateral,
        "__ver": vertical,
    }).withColumn("__fwd", 1 - F.col("__lat") * F.col("__lat") - F.col("__ver") * F.col("__ver"))
    forward = F.when(F.col("__fwd") >= -1e-5, F.sqrt(F.greatest(F.col("__fwd"), F.lit(0.0)))).otherwise(
        F.raise_error(F.lit("azimuth and elevation contradict each other")).cast("double")
    )
    extra = [c for c in ("elevation_rad", "elevation_magnitude", "noise", "snr", "angle_magnitude") if c in names]
    return rows.select(
        *keys,
        (F.col("__r") * F.col("__lat")).alias("x"),
        (F.col("__r") * forward).alias("y"),
        (F.col("__r") * F.col("__ver")).alias("z"),
        doppler_velocity(F.col("doppler_bin"), spec).alias("velocity"),
        F.col("__r").alias("range_m"),
        "range_bin",
        "doppler_bin",
        "azimuth_rad",
        "magnitude",
        *extra,
    )
