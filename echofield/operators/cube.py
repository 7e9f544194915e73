"""Complex radar cubes in long form, and the operators on them.

A cube is one row per cell: key columns, one integer column per axis, ``re`` and ``im``. Axis sizes are known from
the contract, so plans are built without looking at data. ``partitioned`` places all cells of a key in one
partition; grouping and windows by the key and any axes then need no further exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.complexes import cabs, cexp, cmul, pair, window_weight
from ..plans.contracts import Fft, PlanarAperture, Subarray, require

#: Native transforms multiply each line by a twiddle table of so many entries at most (a broadcast bound).
MAX_TWIDDLES = 1 << 16


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    shape: dict[str, int]
    keys: tuple[str, ...] = ("capture_id", "frame")

    @property
    def axes(self) -> list[str]:
        return list(self.shape)

    def others(self, *axes: str) -> list[str]:
        return [*self.keys, *[a for a in self.shape if a not in axes]]

    def cells(self) -> list[str]:
        return [*self.keys, *self.shape, "re", "im"]


def partitioned(raw: DataFrame, keys: tuple[str, ...], fixed: bool = False) -> DataFrame:
    """All rows of a key in one partition, the one exchange of a chain; moved before frames are expanded.

    ``fixed`` keeps all shuffle partitions: adaptive execution joins them by the bytes moved, which tell little of what
    a chain of many sorts holds.
    """
    return raw.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if fixed else raw.repartition(*keys)


def in_order(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """Rows for a step in Python, with ``__place``: those of a key follow each other in one partition, sorted.

    Numbering makes both a need of the plan. A plain repartition is none: Spark leaves it out where the sides of a join
    or union are partitioned alike, and may then coalesce or split these sides each in its own way.
    """
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# --- transforms


def fft_axis(cube: Cube, axis: str, out_axis: str, spec: Fft = Fft()) -> Cube:
    """Forward DFT e^(-2 pi j k n / N) along an axis, not normalised.

    Mean and window are over the input length even if the transform is shorter. ``fftshift`` rotates left by
    ceil(N / 2); ``one_sided`` keeps the first N / 2 + 1 bins after that.
    """
    length = cube.shape[axis]
    n = spec.n_fft or length
    used = min(length, n)
    require(used * n <= MAX_TWIDDLES, "too long for the native transform; use the dense one")
    others = cube.others(axis)
    re, im = pair()
    df = cube.df
    if spec.remove_dc:
        w = Window.partitionBy(*others)
        df = df.withColumns({"re": re - F.avg(re).over(w), "im": im - F.avg(im).over(w)})
    weight = window_weight(spec.window, F.col(axis), length)
    df = df.filter(F.col(axis) < used).select(*others, axis, (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    spark = df.sparkSession
    kept = n // 2 + 1 if spec.one_sided else n
    k = (F.col("__bin") + ((n + 1) // 2 if spec.fftshift else 0)) % n
    twiddles = (
        spark.range(used * kept)
        .select((F.col("id") % used).cast("int").alias(axis), (F.col("id") / used).cast("int").alias("__bin"))
        .withColumn("__angle", F.lit(2.0 * math.pi) * ((k * F.col(axis)) % n) / F.lit(float(n)))
        .select(axis, "__bin", F.cos("__angle").alias("__c"), F.sin("__angle").alias("__s"))
    )
    out = (
        df.join(F.broadcast(twiddles), axis)  # at most MAX_TWIDDLES rows
        .groupBy(*others, "__bin")
        .agg(
            F.sum(F.col("re") * F.col("__c") + F.col("im") * F.col("__s")).alias("re"),
            F.sum(F.col("im") * F.col("__c") - F.col("re") * F.col("__s")).alias("im"),
        )
        .withColumnRenamed("__bin", out_axis)
    )
    shape = {out_axis if a == axis else a: kept if a == axis else s for a, s in cube.shape.items()}
    return Cube(out.select(*cube.keys, *shape, "re", "im"), shape, cube.keys)


def range_fft(cube: Cube, spec: Fft = Fft()) -> Cube:
    require(not spec.fftshift, "a range FFT is never shifted")
    return fft_axis(cube, "sample", "range_bin", spec)


def doppler_fft(cube: Cube, spec: Fft = Fft(fftshift=True)) -> Cube:
    return fft_axis(cube, "loop" if "loop" in cube.shape else "chirp", "doppler_bin", spec)


def angle_fft(cube: Cube, spec: Fft = Fft(fftshift=True), axis: str | None = None) -> Cube:
    return fft_axis(cube, axis or ("virtual_rx" if "virtual_rx" in cube.shape else "rx"), "azimuth_bin", spec)


def planar_angle_fft(cube: Cube, azimuth: Fft = Fft(fftshift=True), elevation: Fft = Fft(fftshift=True)) -> Cube:
    half = fft_axis(cube, "azimuth_aperture", "azimuth_bin", azimuth)
    return fft_axis(half, "elevation_aperture", "elevation_bin", elevation)


# --- cube algebra


def remove_static_clutter(cube: Cube, axis: str = "chirp") -> Cube:
    """Subtract the complex mean along an axis."""
    w = Window.partitionBy(*cube.others(axis))
    re, im = pair()
    return replace(cube, df=cube.df.withColumns({"re": re - F.avg(re).over(w), "im": im - F.avg(im).over(w)}))


def map_tdm_virtual_array(cube: Cube, num_tx: int) -> Cube:
    """chirp = loop * T + slot and virtual = slot * R + rx; a projection."""
    chirps, rx = cube.shape["chirp"], cube.shape["rx"]
    require(chirps % num_tx == 0, "chirps must be whole loops")
    shape: dict[str, int] = {}
    for a, s in cube.shape.items():
        if a == "chirp":
            shape["loop"] = chirps // num_tx
        elif a == "rx":
            shape["virtual_rx"] = num_tx * rx
        else:
            shape[a] = s
    df = cube.df.withColumns({
        "loop": F.floor(F.col("chirp") / num_tx).cast("int"),
        "virtual_rx": ((F.col("chirp") % num_tx) * rx + F.col("rx")).cast("int"),
    })
    return Cube(df.select(*cube.keys, *shape, "re", "im"), shape, cube.keys)


def signed_bin(bin_: Column, n: int, shifted: bool) -> Column:
    """Signed Doppler bin of a (shifted) spectrum of n bins."""
    if shifted:
        return bin_ - n // 2
    return F.pmod(bin_ + n // 2, F.lit(n)) - n // 2


def compensate_tdm_doppler_phase(cube: Cube, num_tx: int, num_rx: int, shifted: bool = True) -> Cube:
    """Turn each transmitter's cells back by the motion between its slot and the first."""
    n = cube.shape["doppler_bin"]
    slot = F.floor(F.col("virtual_rx") / num_rx)
    angle = F.lit(-2.0 * math.pi) * signed_bin(F.col("doppler_bin"), n, shifted) * slot / F.lit(float(n * num_tx))
    re, im = cmul(pair(), cexp(angle))
    return replace(cube, df=cube.df.withColumns({"re": re, "im": im}))


def _table(cube: Cube, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of antennas or coefficients; its size is that of the contract."""
    return F.broadcast(cube.df.sparkSession.createDataFrame(rows, schema))


def map_planar_aperture(cube: Cube, layout: PlanarAperture) -> Cube:
    """Scatter channels to an (elevation, azimuth) grid; empty grid cells are 0, the first of a doubled cell wins."""
    require(len(layout.grid) == cube.shape["virtual_rx"], "one grid cell for each channel")
    rows, cols = layout.shape
    source: dict[tuple[int, int], int] = {}
    for i, cell in enumerate(layout.grid):
        source.setdefault(cell, i)
    grid = _table(cube, [(r, c, source.get((r, c), -1)) for r in range(rows) for c in range(cols)], "elevation_aperture int, azimuth_aperture int, source int")
    # every line has a channel 0 cell, from which the empty grid cells are made
    places = grid.withColumn("virtual_rx", F.greatest("source", F.lit(0)))
    filled = F.col("source") >= 0
    df = cube.df.join(F.broadcast(places), "virtual_rx").withColumns({
        "re": F.when(filled, F.col("re")).otherwise(0.0),
        "im": F.when(filled, F.col("im")).otherwise(0.0),
    })
    shape: dict[str, int] = {}
    for a, s in cube.shape.items():
        if a == "virtual_rx":
            shape |= {"elevation_aperture": rows, "azimuth_aperture": cols}
        else:
            shape[a] = s
    return Cube(df.select(*cube.keys, *shape, "re", "im"), shape, cube.keys)


def select_virtual_subarray(cube: Cube, spec: Subarray) -> Cube:
    """An ordered gather of channels, numbered anew."""
    require(max(spec.indices) < cube.shape["virtual_rx"], "a channel beyond the array")
    chosen = _table(cube, list(zip(spec.indices, range(len(spec.indices)))), "virtual_rx int, __new int")
    df = cube.df.join(chosen, "virtual_rx").drop("virtual_rx").withColumnRenamed("__new", "virtual_rx")
    shape = {a: len(spec.indices) if a == "virtual_rx" else s for a, s in cube.shape.items()}
    return Cube(df.select(*cube.keys, *shape, "re", "im"), shape, cube.keys)


def apply_virtual_channel_calibration(cube: Cube, coefficients: list[complex]) -> Cube:
    """Multiply each channel by its coefficient."""
    require(len(coefficients) == cube.shape["virtual_rx"], "one coefficient for each channel")
    table = _table(cube, [(i, float(c.real), float(c.imag)) for i, c in enumerate(map(complex, coefficients))], "virtual_rx int, __cr double, __ci double")
    re, im = cmul(pair(), pair("__cr", "__ci"))
    df = cube.df.join(table, "virtual_rx").withColumns({"re": re, "im": im})
    return replace(cube, df=df.select(*cube.cells()))


def apply_time_domain_calibration(cube: Cube, frequency: dict[tuple[int, int], float], correction: dict[tuple[int, int], complex], num_rx: int) -> Cube:
    """Multiply by correction[tx, rx] * e^(j frequency[tx, rx] * sample), over (virtual_rx, sample)."""
    rows = [(t * num_rx + r, float(f), complex(correction[t, r]).real, complex(correction[t, r]).imag) for (t, r), f in sorted(frequency.items())]
    require(len(rows) == cube.shape["virtual_rx"], "one correction for each channel")
    table = _table(cube, rows, "virtual_rx int, __f double, __cr double, __ci double")
    joined = cube.df.join(table, "virtual_rx")
    re, im = cmul(cmul(pair(), pair("__cr", "__ci")), cexp(F.col("__f") * F.col("sample")))
    return replace(cube, df=joined.withColumns({"re": re, "im": im}).select(*cube.cells()))


def range_doppler_magnitude(cube: Cube, aggregate: str = "max") -> DataFrame:
    """(keys, doppler_bin, range_bin, magnitude) over all receiver channels; NaN propagates."""
    how = {"max": F.max, "sum": F.sum, "mean": F.avg}[aggregate]
    return cube.df.groupBy(*cube.keys, "doppler_bin", "range_bin").agg(how(cabs(pair())).alias("magnitude"))
