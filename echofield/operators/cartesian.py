"""Cartesian volumes: projection of a planar array's cube onto a metric grid, and sparse points from a volume."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.complexes import cabs, pair
from ..plans.contracts import PlanarAperture, Sparsification, require
from .cube import Cube, partitioned
from .dense import DenseCube

#: The projection's weights are broadcast up to this many rows (about 40 bytes each), beyond it joined by shuffle.
BROADCAST_WEIGHTS = 1_000_000
EPS32 = 1.1920928955078125e-07


@dataclass(frozen=True)
class PlanarProjector:
    """Geometry of a projection: source axes, target velocities, grid, and the zero-padded angle transforms."""

    aperture: PlanarAperture
    range_resolution_m: float
    range_bins: int
    doppler_bins: int
    velocity_start_mps: float
    velocity_step_mps: float
    target_doppler_bins: int
    target_velocity_start_mps: float
    target_velocity_step_mps: float
    shape_zyx: tuple[int, int, int]
    origin_xyz_m: tuple[float, float, float]
    voxel_xyz_m: tuple[float, float, float]
    azimuth_n_fft: int = 128
    elevation_n_fft: int = 32
    spacing_wavelengths: float = 0.5

    def __post_init__(self):
        require(min(self.range_resolution_m, self.velocity_step_mps, self.target_velocity_step_mps, self.spacing_wavelengths, *self.voxel_xyz_m) > 0, "steps must be positive")
        require(self.range_bins > 0 and self.doppler_bins > 1 and self.target_doppler_bins > 0, "axes must not be empty")
        require(min(self.azimuth_n_fft, self.elevation_n_fft) > 1 and min(self.shape_zyx) > 0, "transforms and grid must not be empty")

    @property
    def voxels(self) -> int:
        z, y, x = self.shape_zyx
        return z * y * x

    def grid(self, spark: SparkSession) -> DataFrame:
        """(z, y, x, z_m, y_m, x_m) of every voxel."""
        _, ny, nx = self.shape_zyx
        ids = spark.range(self.voxels).select(
            F.floor(F.col("id") / (ny * nx)).cast("int").alias("z"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x")
        )
        return ids.withColumns({f"{c}_m": F.lit(o) + F.col(c) * F.lit(s) for c, o, s in zip("xyz", self.origin_xyz_m, self.voxel_xyz_m)})

    def samples(self, spark: SparkSession) -> DataFrame:
        """Fractional (range, azimuth, elevation) index of the visible voxels: x >= 0 is forward, y lateral."""
        na, ne = self.azimuth_n_fft, self.elevation_n_fft
        r = F.sqrt(F.col("x_m") * F.col("x_m") + F.col("y_m") * F.col("y_m") + F.col("z_m") * F.col("z_m"))
        g = self.grid(spark).withColumn("r", r).filter((F.col("r") > EPS32) & (F.col("x_m") >= 0))
        g = g.withColumns({"__a": F.col("y_m") / F.col("r"), "__e": F.col("z_m") / F.col("r")})
        g = g.filter(F.col("__a") * F.col("__a") + F.col("__e") * F.col("__e") <= 1 + 1e-6)
        g = g.select(
            "z", "y", "x",
            (F.col("r") / F.lit(self.range_resolution_m)).alias("ri"),
            (F.col("__a") * F.lit(self.spacing_wavelengths * na) + na / 2).alias("ai"),
            (F.col("__e") * F.lit(self.spacing_wavelengths * ne) + ne / 2).alias("ei"),
        )
        return g.filter(
            F.col("ri").between(0, self.range_bins - 1) & F.col("ai").between(0, na - 1) & F.col("ei").between(0, ne - 1)
        )

    def weights(self, spark: SparkSession) -> DataFrame:
        """(z, y, x, virtual_rx, range_bin, wr, wi): complex weight of a channel's range cell in a voxel.

        An angle sample is a sum of channels times twiddles and a voxel a sum of 8 angle samples times trilinear
        weights; both sums are taken here once, so that a frame needs one join and no transform.
        """
        na, ne = self.azimuth_n_fft, self.elevation_n_fft
        first: dict[tuple[int, int], int] = {}
        for channel, (row, col) in enumerate(self.aperture.grid):
            first.setdefault((row, col), channel)
        used = [(c, col, row) for (row, col), c in sorted(first.items()) if col < na and row < ne]
        rows = self.samples(spark)
        for c in ("ri", "ai", "ei"):
            rows = rows.withColumn(f"{c}0", F.floor(c).cast("int")).withColumn(f"{c}f", F.col(c) - F.col(f"{c}0"))

        def sides(c: str, top: int) -> Column:
            low, frac = F.col(f"{c}0"), F.col(f"{c}f")
            return F.explode(F.array(
                F.struct(low.alias("i"), (1 - frac).alias("w")), F.struct(F.least(low + 1, F.lit(top)).alias("i"), frac.alias("w"))
            ))

        rows = rows.withColumn("__r", sides("ri", self.range_bins - 1)).withColumn("__a", sides("ai", na - 1)).withColumn("__e", sides("ei", ne - 1))
        channels = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"), F.lit(e).alias("e")) for c, a, e in used]))
        rows = rows.withColumn("__c", channels)
        ka = (F.col("__a.i") + (na + 1) // 2) % na
        ke = (F.col("__e.i") + (ne + 1) // 2) % ne
        angle = F.lit(-2 * math.pi) * (((ka * F.col("__c.a")) % na) / F.lit(float(na)) + ((ke * F.col("__c.e")) % ne) / F.lit(float(ne)))
        w = F.col("__r.w") * F.col("__a.w") * F.col("__e.w")
        return rows.groupBy("z", "y", "x", F.col("__c.c").alias("virtual_rx"), F.col("__r.i").alias("range_bin")).agg(
            F.sum(w * F.cos(angle)).alias("wr"), F.sum(w * F.sin(angle)).alias("wi")
        )

    def doppler_rows(self) -> list[tuple[int, int, float]]:
        """(d, doppler_bin, w): linear interpolation of source bins at the target velocities inside the source axis."""
        rows = []
        for d in range(self.target_doppler_bins):
            at = (self.target_velocity_start_mps + self.target_velocity_step_mps * d - self.velocity_start_mps) / self.velocity_step_mps
            if 0 <= at <= self.doppler_bins - 1:
                low = min(int(at), self.doppler_bins - 1)
                high = min(low + 1, self.doppler_bins - 1)
                parts = {low: 1 - (at - low)}
                parts[high] = parts.get(high, 0.0) + (at - low)
                rows += [(d, b, w) for b, w in parts.items()]
        require(bool(rows), "no target velocity lies on the source axis")
        return rows

    def doppler_weights(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.doppler_rows(), "d int, doppler_bin int, w double")

    def project(self, cube: Cube) -> DataFrame:
        """(keys..., d, z, y, x, magnitude) over the whole grid; 0 where the source has no support."""
        require(cube.shape["doppler_bin"] == self.doppler_bins and cube.shape["range_bin"] == self.range_bins, "cube and projector differ")
        require(cube.shape["virtual_rx"] == len(self.aperture.grid), "cube and aperture differ")
        spark = cube.df.sparkSession
        weights = self.weights(spark)
        if self.voxels * len(self.aperture.grid) * 2 <= BROADCAST_WEIGHTS:
            weights = F.broadcast(weights)
        re, im = pair()
        beams = (
            cube.df.join(weights, ["virtual_rx", "range_bin"])
            .groupBy(*cube.keys, "doppler_bin", "z", "y", "x")
            .agg(F.sum(re * F.col("wr") - im * F.col("wi")).alias("re"), F.sum(re * F.col("wi") + im * F.col("wr")).alias("im"))
            .select(*cube.keys, "doppler_bin", "z", "y", "x", cabs(pair()).alias("m"))
        )
        seen = beams.join(F.broadcast(self.doppler_weights(spark)), "doppler_bin").groupBy(*cube.keys, "d", "z", "y", "x").agg(F.sum(F.col("m") * F.col("w")).alias("magnitude"))
        frames = cube.df.select(*cube.keys).distinct()
        everywhere = self.grid(spark).select("z", "y", "x").join(F.broadcast(spark.range(self.target_doppler_bins).select(F.col("id").cast("int").alias("d"))))
        every = frames.join(F.broadcast(everywhere)) if self.voxels * self.target_doppler_bins <= BROADCAST_WEIGHTS else frames.join(everywhere)
        return every.join(seen, [*cube.keys, "d", "z", "y", "x"], "left").withColumn("magnitude", F.coalesce("magnitude", F.lit(0.0)))


def _sampled(p: PlanarProjector) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voxels with support, and for each the 8 cells (elevation, azimuth, range) around it and their weights."""
    z, y, x = (i.reshape(-1) for i in np.indices(p.shape_zyx))
    at = [o + c * s for c, o, s in zip((x, y, z), p.origin_xyz_m, p.voxel_xyz_m)]
    r = np.sqrt(at[0] ** 2 + at[1] ** 2 + at[2] ** 2)
    seen = np.flatnonzero((r > EPS32) & (at[0] >= 0))
    na, ne = p.azimuth_n_fft, p.elevation_n_fft
    across, up = at[1][seen] / r[seen], at[2][seen] / r[seen]
    index = np.stack([up * (p.spacing_wavelengths * ne) + ne / 2, across * (p.spacing_wavelengths * na) + na / 2, r[seen] / p.range_resolution_m])
    tops = np.array([ne, na, p.range_bins])[:, None] - 1
    inside = (across**2 + up**2 <= 1 + 1e-6) & ((index >= 0) & (index <= tops)).all(axis=0)
    seen, index = seen[inside], index[:, inside]
    low = np.floor(index).astype(int)
    part = index - low
    cells, weights = [], []
    for corner in np.ndindex(2, 2, 2):
        side = np.array(corner)[:, None]
        cells.append(np.minimum(low + side, tops))
        weights.append(np.where(side == 1, part, 1 - part).prod(axis=0))
    return seen, np.stack(cells), np.stack(weights)


def project_dense(cube: DenseCube, projector: PlanarProjector) -> DataFrame:
    """The same volume as ``project``, from frames as arrays: angle transforms and gathers in one Arrow stage.

    A Doppler bin is transformed at a time, so a task holds one frame and one (elevation, azimuth, range) block.
    """
    p, axes = projector, list(cube.shape)
    require(set(axes) == {"doppler_bin", "virtual_rx", "range_bin"}, "a cube over Doppler, channels and range is needed")
    require(cube.shape["doppler_bin"] == p.doppler_bins and cube.shape["range_bin"] == p.range_bins, "cube and projector differ")
    require(cube.shape["virtual_rx"] == len(p.aperture.grid), "cube and aperture differ")
    order = tuple(axes.index(a) for a in ("doppler_bin", "virtual_rx", "range_bin"))
    na, ne = p.azimuth_n_fft, p.elevation_n_fft
    first: dict[tuple[int, int], int] = {}
    for channel, cell in enumerate(p.aperture.grid):
        first.setdefault(cell, channel)
    used = [(channel, row, col) for (row, col), channel in first.items() if row < ne and col < na]
    mix = np.zeros((p.target_doppler_bins, p.doppler_bins))
    for d, b, w in p.doppler_rows():
        mix[d, b] = w
    seen, cells, weights = _sampled(p)

    def make(x):
        out = np.zeros((p.target_doppler_bins, p.voxels))
        for b, one in enumerate(x.transpose(order)):
            if not mix[:, b].any():
                continue
            grid = np.zeros((ne, na, p.range_bins), complex)
            for channel, row, col in used:
                grid[row, col] = one[channel]
            beams = np.fft.fftshift(np.fft.fft2(grid, axes=(0, 1)), axes=(0, 1))
            out[:, seen] += mix[:, b, None] * np.abs((beams[cells[:, 0], cells[:, 1], cells[:, 2]] * weights).sum(axis=0))
        return [pa.array([out.reshape(-1)], pa.list_(pa.float64()))]

    volumes = cube._map(make, "v array<double>", [pa.field("v", pa.list_(pa.float64()))])
    rows = volumes.select("capture_id", "frame", F.posexplode("v").alias("i", "magnitude"))
    _, ny, nx = p.shape_zyx
    i = F.col("i")
    return rows.select(
        "capture_id", "frame", F.floor(i / p.voxels).cast("int").alias("d"), (F.floor(i / (ny * nx)) % p.shape_zyx[0]).cast("int").alias("z"),
        (F.floor(i / nx) % ny).cast("int").alias("y"), (i % nx).cast("int").alias("x"), "magnitude",
    )


# --- sparse points


def _ranked(rows: DataFrame, keys: list[str], shape: tuple[int, int, int, int], spec: Sparsification, velocity: Column, suppressed: int | None) -> DataFrame:
    """Every voxel with its flags: positive, Doppler peak, valid, spatial peak, noise, snr_db."""
    _, nz, ny, nx = shape
    m = spec.boundary_margin_voxels
    require(all(2 * m < n for n in (nz, ny, nx)), "the margin leaves no voxel")
    inside = F.col("z").between(m, nz - 1 - m) & F.col("y").between(m, ny - 1 - m) & F.col("x").between(m, nx - 1 - m)
    if "mask" in rows.columns:
        inside = inside & F.col("mask")
    seen = F.when(F.col("d") == suppressed, F.lit(0.0)).otherwise(F.col("magnitude")) if suppressed is not None else F.col("magnitude")
    flat = (F.col("z") * ny + F.col("y")) * nx + F.col("x")
    out = rows.withColumns({"valid": inside, "seen": seen, "flat": flat, "velocity": velocity})
    slab = Window.partitionBy(*keys, "d")
    log = F.avg(F.when(F.col("valid") & (F.col("seen") > 0), F.log("seen"))).over(slab)
    out = out.withColumn("noise", F.coalesce(F.exp(log) * F.lit(spec.noise_floor_scale), F.lit(0.0)))
    r = spec.doppler_peak_radius
    peak = F.lit(True)
    if r:
        line = Window.partitionBy(*keys, "flat").orderBy("d")
        out = out.withColumns({"__lo": F.max("seen").over(line.rowsBetween(-r, -1)), "__hi": F.max("seen").over(line.rowsBetween(1, r))})
        peak = (F.col("__lo").isNull() | (F.col("seen") > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("seen") >= F.col("__hi")))
    out = out.withColumn("doppler_peak", peak)
    s = spec.spatial_peak_radius
    top = F.lit(True)
    if s:
        # the strongest voxel of the box, of equal ones the first; a maximum along one axis after the other
        out = out.withColumn("__own", F.struct("magnitude", (-F.col("flat")).alias("order")))
        best = "__own"
        for axis, others in (("x", ("z", "y")), ("y", ("z", "x")), ("z", ("y", "x"))):
            w = Window.partitionBy(*keys, "d", *others).orderBy(axis).rowsBetween(-s, s)
            out = out.withColumn(f"__{axis}", F.max(best).over(w))
            best = f"__{axis}"
        top = F.col("__own") == F.col(best)
    out = out.withColumn("spatial_peak", top)
    ratio = F.when((F.col("seen") > 0) & (F.col("noise") > 0), 20 * F.log10(F.col("seen") / F.col("noise"))).otherwise(F.lit(float("-inf")))
    return out.withColumn("snr_db", ratio).select(*keys, "d", "z", "y", "x", "flat", "velocity", "magnitude", "seen", "valid", "noise", "doppler_peak", "spatial_peak", "snr_db")


def sparsify_volume(
    volume: DataFrame,
    shape: tuple[int, int, int, int],
    velocity: Column,
    spec: Sparsification = Sparsification(),
    suppressed: int | None = None,
    keys: tuple[str, ...] = ("capture_id", "frame"),
) -> tuple[DataFrame, DataFrame]:
    """(points, counters) of volumes (keys..., d, z, y, x, magnitude[, mask]); ``velocity`` is a function of d.

    points: (keys..., d, z, y, x, velocity, snr_db, rank). counters: one row a frame.
    """
    k = list(keys)
    # the one exchange: every window and aggregate below is within a frame
    cells = _ranked(partitioned(volume, tuple(k), fixed=True), k, shape, spec, velocity, suppressed)
    frame = Window.partitionBy(*k)
    positive = F.col("seen") > 0
    peak = positive & F.col("valid") & F.col("doppler_peak") & F.col("spatial_peak")
    candidate = peak & (F.col("snr_db") >= spec.min_snr_db)
    allowed = F.col("valid") & (F.col("d") != suppressed if suppressed is not None else F.lit(True))
    cells = cells.withColumns({"index": F.col("d") * (shape[1] * shape[2] * shape[3]) + F.col("flat"), "candidate": candidate})

    # candidates, and of each frame the strongest voxel, which stands in where no candidate is left
    own = F.when(allowed, F.struct("magnitude", (-F.col("index")).alias("order")))
    pool = cells.withColumns({"__own": own, "__best": F.max(own).over(frame), "__some": F.max((positive & F.col("valid")).cast("int")).over(frame)})
    pool = pool.filter(F.col("candidate") | (F.col("__own") == F.col("__best"))).drop("__own", "__best")

    order = [F.desc("snr_db"), F.asc("index")]
    kept = F.col("candidate")
    if spec.max_doppler_peaks_per_spatial is not None:
        w = Window.partitionBy(*k, "flat").orderBy(F.desc("candidate"), *order)
        kept = kept & (F.row_number().over(w) <= spec.max_doppler_peaks_per_spatial)
    pool = pool.withColumn("kept", kept)

    def static(rows: Column) -> Column:
        """Not faster than the threshold, with a tolerance from the velocities of the rows that count."""
        fastest = F.max(F.when(rows, F.abs("velocity"))).over(frame)
        return F.abs("velocity") <= F.lit(spec.static_velocity_threshold_mps) + F.lit(EPS32) * F.greatest(fastest, F.lit(1.0))

    if spec.static_point_capacity_fraction == 1.0:
        place = F.row_number().over(frame.orderBy(F.desc("kept"), *order))
        pool = pool.withColumn("chosen", F.col("kept") & (place <= spec.max_points))
    else:
        cap = math.floor(spec.max_points * spec.static_point_capacity_fraction)
        pool = pool.withColumn("__static", static(F.col("kept")))
        place = F.row_number().over(Window.partitionBy(*k, "__static").orderBy(F.desc("kept"), *order))
        taken = F.least(F.count_if(F.col("kept") & F.col("__static")).over(frame), F.lit(cap))
        room = F.when(F.col("__static"), F.lit(cap)).otherwise(F.lit(spec.max_points) - taken)
        pool = pool.withColumn("chosen", F.col("kept") & (place <= room))
    none = F.max(F.col("chosen").cast("int")).over(frame) == 0
    first = F.row_number().over(frame.orderBy(F.desc(allowed), F.desc("magnitude"), "index")) == 1
    stand_in = none & first & allowed & (F.col("__some") == 1) if spec.strongest_point_fallback else F.lit(False)
    pool = pool.withColumn("fallback", stand_in).withColumn("out", F.col("chosen") | F.col("fallback"))
    pool = pool.withColumns({"rank": F.row_number().over(frame.orderBy(F.desc("out"), *order)), "__static": static(F.col("out"))})
    points = pool.filter("out").select(*k, "d", "z", "y", "x", "velocity", "snr_db", "rank", "fallback")

    slab_noise = F.when((F.col("flat") == 0) & (F.col("noise") > 0), F.col("noise"))  # one voxel a slab
    counters = cells.groupBy(*k).agg(
        F.count_if(F.col("valid") & (F.col("d") == 0)).alias("valid_spatial_voxels"),
        F.count_if(positive).alias("positive_volume_voxels"),
        F.count_if(positive & F.col("valid")).alias("valid_positive_volume_voxels"),
        F.count_if(positive & F.col("doppler_peak")).alias("doppler_peak_voxels"),
        F.count_if(peak).alias("local_peak_voxels"),
        F.count_if("candidate").alias("threshold_peak_voxels"),
        F.min(slab_noise).alias("noise_floor_min"),
        F.percentile(slab_noise, F.lit(0.5)).alias("noise_floor_median"),
        F.max(slab_noise).alias("noise_floor_max"),
    )
    made = pool.groupBy(*k).agg(
        F.count_if("kept").alias("limited_peak_voxels"),
        F.count_if(F.col("out") & F.col("__static")).alias("static_output_points"),
        F.count_if("out").alias("point_count"),
        F.max("fallback").alias("fallback_used"),
    )
    zero = ["limited_peak_voxels", "static_output_points", "point_count", "noise_floor_min", "noise_floor_median", "noise_floor_max"]
    stats = counters.join(made, k, "left")
    return points, stats.withColumns({**{c: F.coalesce(F.col(c), F.lit(0)) for c in zero}, "fallback_used": F.coalesce("fallback_used", F.lit(False))})


# --- the same from frames as arrays


def _box_peaks(m: np.ndarray, radius: int) -> np.ndarray:
    """Cells of (d, z, y, x) that no cell of their box exceeds, nor equals from an earlier place."""
    top = np.ones(m.shape, bool)
    for step in itertools.product(range(-radius, radius + 1), repeat=3):
        if step == (0, 0, 0):
            continue
        here = (slice(None), *[slice(max(0, -s), n - max(0, s)) for s, n in zip(step, m.shape[1:])])
        there = (slice(None), *[slice(max(0, s), n - max(0, -s)) for s, n in zip(step, m.shape[1:])])
        top[here] &= (m[here] > m[there]) | ((m[here] == m[there]) & (step > (0, 0, 0)))
    return top


def _line_peaks(seen: np.ndarray, radius: int) -> np.ndarray:
    """Cells above the ones before them along Doppler and not below the ones after."""
    top = np.ones(seen.shape, bool)
    for s in range(1, min(radius, len(seen) - 1) + 1):
        top[s:] &= seen[s:] > seen[:-s]
        top[:-s] &= seen[:-s] >= seen[s:]
    return top


def sparsify_frame(m: np.ndarray, velocity: np.ndarray, spec: Sparsification, suppressed: int | None = None) -> tuple[list[tuple], tuple]:
    """Points (d, z, y, x, velocity, snr_db, rank, fallback) and counters of one volume (d, z, y, x)."""
    margin = spec.boundary_margin_voxels
    require(all(2 * margin < n for n in m.shape[1:]), "the margin leaves no voxel")
    valid = np.zeros(m.shape, bool)
    valid[(slice(None), *[slice(margin, n - margin) for n in m.shape[1:]])] = True
    seen = m.copy()
    if suppressed is not None:
        seen[suppressed] = 0.0
    positive = seen > 0
    noise = np.array([np.exp(np.log(s[v & p]).mean()) * spec.noise_floor_scale if (v & p).any() else 0.0 for s, v, p in zip(seen, valid, positive)])
    snr = np.full(m.shape, -np.inf)
    known = positive & (noise > 0)[:, None, None, None]
    snr[known] = 20 * np.log10(seen[known] / np.broadcast_to(noise[:, None, None, None], m.shape)[known])
    doppler = positive & _line_peaks(seen, spec.doppler_peak_radius)
    peak = doppler & valid & _box_peaks(m, spec.spatial_peak_radius)
    candidate = peak & (snr >= spec.min_snr_db)

    flat_snr, fast = snr.reshape(-1), np.abs(velocity)
    voxels = m[0].size
    at = np.flatnonzero(candidate)
    at = at[np.lexsort((at, -flat_snr[at]))]  # the strongest first, of equal ones the first
    if spec.max_doppler_peaks_per_spatial is not None:
        place = at % voxels
        order = np.argsort(place, kind="stable")
        run = np.arange(len(at)) - np.searchsorted(place[order], place[order])
        keep = np.zeros(len(at), bool)
        keep[order] = run < spec.max_doppler_peaks_per_spatial
        at = at[keep]
    limited = len(at)

    def static(rows: np.ndarray) -> np.ndarray:
        own = fast[rows // voxels]
        return own <= spec.static_velocity_threshold_mps + EPS32 * max(own.max(initial=0.0), 1.0)

    if spec.static_point_capacity_fraction == 1.0:
        at = at[: spec.max_points]
    else:
        cap, slow = math.floor(spec.max_points * spec.static_point_capacity_fraction), static(at)
        room = np.where(slow, cap, spec.max_points - min(int(slow.sum()), cap))
        at = at[np.where(slow, np.cumsum(slow), np.cumsum(~slow)) <= room]
    fallback = False
    if not len(at) and spec.strongest_point_fallback and (positive & valid).any():
        allowed = valid.copy()
        if suppressed is not None:
            allowed[suppressed] = False
        fallback = bool(allowed.any())
        if fallback:
            at = np.array([np.where(allowed, m, -np.inf).argmax()])
    points = [(*map(int, np.unravel_index(i, m.shape)), float(velocity[i // voxels]), float(flat_snr[i]), rank, fallback) for rank, i in enumerate(at.tolist(), 1)]
    heard = noise[noise > 0]
    low, middle, high = (float(heard.min()), float(np.median(heard)), float(heard.max())) if len(heard) else (0.0, 0.0, 0.0)
    counts = [valid[0].sum(), positive.sum(), (positive & valid).sum(), doppler.sum(), peak.sum(), candidate.sum()]
    return points, (*map(int, counts), low, middle, high, limited, int(static(at).sum()) if len(at) else 0, len(at), fallback)


POINT = "d int, z int, y int, x int, velocity double, snr_db double, rank int, fallback boolean"
COUNTERS = (
    "valid_spatial_voxels bigint, positive_volume_voxels bigint, valid_positive_volume_voxels bigint, doppler_peak_voxels bigint, local_peak_voxels bigint, "
    "threshold_peak_voxels bigint, noise_floor_min double, noise_floor_median double, noise_floor_max double, limited_peak_voxels bigint, "
    "static_output_points bigint, point_count bigint, fallback_used boolean"
)


def sparsify_dense(
    volumes: DataFrame, shape: tuple[int, int, int, int], velocity: list[float], spec: Sparsification = Sparsification(), suppressed: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(points, counters) as ``sparsify_volume`` gives them, from (capture_id, frame, v): a volume a row, no exchange."""
    speeds = np.asarray(velocity, float)
    require(len(speeds) == shape[0], "a velocity for each Doppler bin")
    kind = volumes.schema["capture_id"].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(f"points array<struct<{POINT}>>, stats struct<{COUNTERS}>"))
    names, counter_names = ([f.split()[0] for f in x.split(", ")] for x in (POINT, COUNTERS))

    def run(batches):
        for batch in batches:
            made = [sparsify_frame(np.asarray(v.values.to_numpy(zero_copy_only=False), float).reshape(shape), speeds, spec, suppressed) for v in batch.column(2)]
            points = pa.array([[dict(zip(names, p)) for p in points] for points, _ in made], arrow.field("points").type)
            stats = pa.array([dict(zip(counter_names, c)) for _, c in made], arrow.field("stats").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), points, stats], names=["capture_id", "frame", "points", "stats"])

    out = volumes.select("capture_id", F.col("frame").cast("int").alias("frame"), "v").mapInArrow(run, f"capture_id {kind}, frame int, points array<struct<{POINT}>>, stats struct<{COUNTERS}>")
    return out.select("capture_id", "frame", F.inline("points")), out.select("capture_id", "frame", "stats.*")
