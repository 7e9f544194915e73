"""Detection: thresholds, local maxima, CFAR in one and two dimensions, peak grouping, quality.

Comparisons follow IEEE: NaN never passes a test, unlike Spark's ordering, so NaN is excluded explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.complexes import cabs, pair
from ..plans.contracts import Cfar1D, Cfar2D, PeakDetection, PeakGrouping, RangeDopplerCfar, require
from .cube import Cube, range_doppler_magnitude

#: SNR where the noise is not positive: the largest 32-bit float.
UNDEFINED_SNR = 3.4028234663852886e38


def real_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def threshold_range_doppler(cube: Cube, spec: PeakDetection) -> DataFrame:
    """Cells of the aggregated magnitude map at or above the threshold."""
    m = range_doppler_magnitude(cube, spec.aggregate_rx)
    return m.filter(real_number(F.col("magnitude")) & (F.col("magnitude") >= spec.threshold)).select(*cube.keys, "range_bin", "doppler_bin", "magnitude")


def threshold_azimuth(cube: Cube, spec: PeakDetection) -> DataFrame:
    """Cells of a range-Doppler-azimuth cube at or above the threshold that dominate their azimuth neighbours.

    Neighbours are clipped at the edges; a NaN neighbour is not dominated.
    """
    w = Window.partitionBy(*cube.keys, "doppler_bin", "range_bin").orderBy("azimuth_bin")
    m = cube.df.withColumn("magnitude", cabs(pair()))
    k = spec.azimuth_peak_radius
    kept = real_number(F.col("magnitude")) & (F.col("magnitude") >= spec.threshold)
    if k:
        before, after = F.max("magnitude").over(w.rowsBetween(-k, -1)), F.max("magnitude").over(w.rowsBetween(1, k))
        m = m.withColumns({"__before": before, "__after": after})
        for side in ("__before", "__after"):
            wins = F.col("magnitude") > F.col(side) if spec.azimuth_peak_strict else F.col("magnitude") >= F.col(side)
            kept = kept & (F.col(side).isNull() | (~F.isnan(side) & wins))
    return m.filter(kept).select(*cube.keys, "range_bin", "doppler_bin", "azimuth_bin", "magnitude")


# --- CFAR along a line


def _noise(spec: Cfar1D, left: Column, right: Column) -> Column:
    t = float(spec.training)
    if spec.mode == "ca":
        return (left + right) / (2.0 * t)
    if spec.mode == "go":
        return F.greatest(left / t, right / t)
    if spec.mode == "so":
        return F.least(left / t, right / t)
    return left + right


def cfar_line(df: DataFrame, line: list[str], idx: str, value: str, length: Column | int, spec: Cfar1D, out: str = "noise") -> DataFrame:
    """Adds the noise estimate of each cell under test to lines of cells; null where a cell is not under test.

    Sums of the training cells on both sides are window frames. In cyclic lines the cells within the radius of
    either end are repeated beyond the other one, where frames then find them.
    """
    n = F.lit(length) if isinstance(length, int) else length
    g, t = spec.guard, spec.training
    radius = g + t
    rows = df.withColumns({"__idx": F.col(idx).cast("int"), "__n": n.cast("int")})
    if spec.cyclic:
        low = F.when(F.col(idx) >= F.col("__n") - radius, F.col(idx) - F.col("__n"))
        high = F.when(F.col(idx) < radius, F.col(idx) + F.col("__n"))
        rows = rows.withColumn("__idx", F.explode(F.array_compact(F.array(F.col("__idx"), low.cast("int"), high.cast("int")))))
    w: WindowSpec = Window.partitionBy(*line).orderBy("__idx")
    rows = rows.withColumns({
        "__left": F.sum(value).over(w.rowsBetween(-radius, -(g + 1))),
        "__right": F.sum(value).over(w.rowsBetween(g + 1, radius)),
    })
    # a radius of half a line or more leaves no cell under test
    fits = F.lit(radius) < F.ceil(F.col("__n") / 2)
    if spec.cyclic:
        rows = rows.filter(F.col("__idx") == F.col(idx))
        inside = (F.col(idx) >= spec.left_skip) & (F.col(idx) < F.col("__n") - spec.right_skip)
    else:
        inside = (F.col(idx) >= spec.left_skip + radius) & (F.col(idx) < F.col("__n") - spec.right_skip - radius)
    noise = F.when(fits & inside, _noise(spec, F.col("__left"), F.col("__right")))
    return rows.withColumn(out, noise).drop("__idx", "__n", "__left", "__right")


def detect_cfar_1d(df: DataFrame, line: list[str], idx: str, value: str, length: Column | int, spec: Cfar1D) -> DataFrame:
    """(line..., idx, noise) of cells that exceed noise times scale, strictly. ``length`` is a line's cells."""
    noisy = cfar_line(df, line, idx, value, length, spec)
    hit = real_number(F.col(value)) & real_number(F.col("noise")) & (F.col(value) > F.col("noise") * spec.scale)
    return noisy.filter(hit).select(*line, idx, "noise")


def detect_range_doppler_cfar(cube: Cube, spec: RangeDopplerCfar) -> DataFrame:
    """Composed CFAR: a range pass in every Doppler bin and, if given, a Doppler pass in every range bin.

    A cell must pass both; the noise is the larger estimate and snr = signal / noise.
    """
    keys = list(cube.keys)
    m = range_doppler_magnitude(cube, spec.aggregate_rx)
    signal = F.col("magnitude") * F.col("magnitude") if spec.input_scale == "power" else F.col("magnitude")
    rows = cfar_line(m.withColumn("signal", signal), [*keys, "doppler_bin"], "range_bin", "signal", cube.shape["range_bin"], spec.range, "range_noise")
    s = F.col("signal")

    def passes(noise: str, scale: float) -> Column:
        return real_number(F.col(noise)) & (s > F.col(noise) * scale)

    kept, noise = passes("range_noise", spec.range.scale), F.col("range_noise")
    if spec.doppler is not None:
        rows = cfar_line(rows, [*keys, "range_bin"], "doppler_bin", "signal", cube.shape["doppler_bin"], spec.doppler, "doppler_noise")
        kept, noise = kept & passes("doppler_noise", spec.doppler.scale), F.greatest("range_noise", "doppler_noise")
    found = rows.filter(real_number(s) & kept).withColumn("noise", noise)
    snr = F.when(F.col("noise") > 0, s / F.col("noise")).otherwise(F.lit(UNDEFINED_SNR))
    return found.select(*keys, "range_bin", "doppler_bin", "magnitude", "noise", snr.alias("snr"))


def detect_cfar_2d(cube: Cube, spec: Cfar2D) -> DataFrame:
    """Mean of the square ring of training cells around each cell; cells near the edges are not tested."""
    keys = list(cube.keys)
    r, g = spec.training + spec.guard, spec.guard
    m = range_doppler_magnitude(cube, spec.aggregate_rx)
    along_range = Window.partitionBy(*keys, "doppler_bin").orderBy("range_bin")
    along_doppler = Window.partitionBy(*keys, "range_bin").orderBy("doppler_bin")
    m = m.withColumns({"__o": F.sum("magnitude").over(along_range.rowsBetween(-r, r)), "__g": F.sum("magnitude").over(along_range.rowsBetween(-g, g))})
    m = m.withColumns({"__outer": F.sum("__o").over(along_doppler.rowsBetween(-r, r)), "__guard": F.sum("__g").over(along_doppler.rowsBetween(-g, g))})
    cells = (2 * r + 1) ** 2 - (2 * g + 1) ** 2
    noise = (F.col("__outer") - F.col("__guard")) / float(cells)
    inside = (
        (F.col("range_bin") >= r) & (F.col("range_bin") < cube.shape["range_bin"] - r)
        & (F.col("doppler_bin") >= r) & (F.col("doppler_bin") < cube.shape["doppler_bin"] - r)
    )
    hit = real_number(F.col("magnitude")) & real_number(F.col("noise")) & (F.col("magnitude") > F.col("noise") * spec.scale)
    return m.withColumn("noise", noise).filter(inside & hit).select(*keys, "range_bin", "doppler_bin", "magnitude")


# --- after detection


def neighbourhood_maximum(m: DataFrame, keys: list[str], doppler_bins: int, spec: PeakGrouping) -> DataFrame:
    """Adds ``highest``: the largest magnitude around each cell of a whole map, the cell itself left out.

    A maximum along range, then along Doppler, both window frames on one partitioning. Cyclic Doppler neighbours
    are found by repeating rows beyond both ends.
    """
    rr, dr = spec.range_radius, spec.doppler_radius
    row = Window.partitionBy(*keys, "doppler_bin").orderBy("range_bin")
    value, none = F.col("magnitude"), F.lit(None).cast("double")
    # greatest() and max() rank NaN above all numbers, so a NaN neighbour stays visible
    beside = F.greatest(F.max(value).over(row.rowsBetween(-rr, -1)), F.max(value).over(row.rowsBetween(1, rr))) if rr else none
    rows = m.withColumns({"__row": F.max(value).over(row.rowsBetween(-rr, rr)) if rr else value, "highest": beside, "__d": F.col("doppler_bin")})
    if not dr:
        return rows.drop("__row", "__d")
    if spec.cyclic_doppler:
        turns = -(-dr // doppler_bins)
        places = F.array(*[(F.col("doppler_bin") + k * doppler_bins).cast("int") for k in range(-turns, turns + 1)])
        rows = rows.withColumn("__d", F.explode(F.filter(places, lambda d: (d >= -dr) & (d < doppler_bins + dr))))
    line = Window.partitionBy(*keys, "range_bin").orderBy("__d")
    others = [F.max("__row").over(line.rowsBetween(-dr, -1)), F.max("__row").over(line.rowsBetween(1, dr))]
    rows = rows.withColumn("highest", F.greatest("highest", *others))
    return rows.filter(F.col("__d") == F.col("doppler_bin")).drop("__row", "__d")


def group_detection_peaks(cube: Cube, detections: DataFrame, spec: PeakGrouping = PeakGrouping()) -> DataFrame:
    """Detections whose cell is the peak of its neighbourhood in the whole magnitude map.

    Doppler neighbours wrap if cyclic (a wrapped neighbour may be the cell itself, which a strict test rejects),
    range neighbours never do. A NaN neighbour rejects.
    """
    keys = list(cube.keys)
    if not spec.doppler_radius and not spec.range_radius:
        return detections
    m = neighbourhood_maximum(range_doppler_magnitude(cube, spec.aggregate_rx), keys, cube.shape["doppler_bin"], spec)
    value, top = F.col("magnitude"), F.col("highest")
    peak = top.isNull() | (~F.isnan(top) & ~F.isnan(value) & ((value > top) if spec.strict else (value >= top)))
    cells = [*keys, "doppler_bin", "range_bin"]
    return detections.join(m.filter(peak).select(*cells), cells, "left_semi").select(detections.columns)


def filter_detection_quality(detections: DataFrame, min_snr: float) -> DataFrame:
    require("snr" in detections.columns, "detections without SNR cannot be filtered by it")
    return detections.filter(real_number(F.col("snr")) & (F.col("snr") >= min_snr))
