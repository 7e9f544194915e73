"""Queries over cubes: decoding, transforms, algebra, detection, angles and points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import angle, cube as C, detection as D, vitals as V
from .contracts import Cfar1D, Cfar2D, Fft, PeakDetection, PeakGrouping, PlanarAperture, Projection, RangeDopplerCfar, Subarray
from .signals import DAILY_SQL, MAP_SQL, cells, cells_sql, daily_power, dft_sql, magnitude_cube, r4, read, rounded

QUERIES, SQL = {}, {}
KEYS = ["capture_id", "frame"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- decoding

for _layout in ("iq_interleaved", "sample_i_then_q", "group2_i_then_q", "group4_i_then_q"):

    def _decode(spark, sf_dir, layout=_layout):
        return cells(spark, sf_dir, layout).df

    query(f"adc_decode_{_layout}", f"WITH {cells_sql(_layout)} SELECT * FROM cells")(_decode)

# --- chain of transforms

RANGE = dft_sql("cells", "rng", "sample", "range_bin", [*KEYS, "chirp", "rx"], 4)
TDM = "tdm AS (SELECT capture_id, frame, (chirp // 2)::INT AS loop, ((chirp % 2) * 2 + rx)::INT AS virtual_rx, range_bin, re, im FROM rng)"
DOPPLER = dft_sql("tdm", "rd", "loop", "doppler_bin", [*KEYS, "virtual_rx", "range_bin"], 2, shift=True)
CHAIN = ", ".join((cells_sql(), RANGE, TDM, DOPPLER))
CUBE = "re", "im"


def range_cube(spark, sf_dir, spec=Fft()):
    return C.range_fft(cells(spark, sf_dir), spec)


def rd_cube(spark, sf_dir):
    return C.doppler_fft(C.map_tdm_virtual_array(range_cube(spark, sf_dir), 2))


def _select(sql: str, *axes: str) -> str:
    return f"SELECT {', '.join((*KEYS, *axes))}, {r4('re')}, {r4('im')} FROM {sql}"


@query("range_fft", f"WITH {cells_sql()}, {RANGE} {_select('rng', 'chirp', 'rx', 'range_bin')}")
def _(spark, sf_dir):
    return rounded(range_cube(spark, sf_dir).df, *CUBE)


_HANN = dft_sql("cells", "rng", "sample", "range_bin", [*KEYS, "chirp", "rx"], 4, n=8, window="hann", one_sided=True, dc=True)


@query("range_fft_windowed_one_sided", f"WITH {cells_sql()}, {_HANN} {_select('rng', 'chirp', 'rx', 'range_bin')}")
def _(spark, sf_dir):
    return rounded(range_cube(spark, sf_dir, Fft(8, "hann", one_sided=True, remove_dc=True)).df, *CUBE)


_SHORT = dft_sql("cells", "dop", "chirp", "doppler_bin", [*KEYS, "rx", "sample"], 4, n=3, window="hamming", shift=True)


@query("doppler_fft_hamming_truncated", f"WITH {cells_sql()}, {_SHORT} {_select('dop', 'doppler_bin', 'rx', 'sample')}")
def _(spark, sf_dir):
    return rounded(C.doppler_fft(cells(spark, sf_dir), Fft(3, "hamming", True)).df, *CUBE)


@query("tdm_virtual_array", f"WITH {cells_sql()}, {RANGE}, {TDM} {_select('tdm', 'loop', 'virtual_rx', 'range_bin')}")
def _(spark, sf_dir):
    return rounded(C.map_tdm_virtual_array(range_cube(spark, sf_dir), 2).df, *CUBE)


@query("doppler_fft", f"WITH {CHAIN} {_select('rd', 'doppler_bin', 'virtual_rx', 'range_bin')}")
def _(spark, sf_dir):
    return rounded(rd_cube(spark, sf_dir).df, *CUBE)


@query("static_clutter_removal", f"""WITH {cells_sql()},
m AS (SELECT capture_id, frame, rx, sample, avg(re) AS mre, avg(im) AS mim FROM cells GROUP BY ALL),
x AS (SELECT c.capture_id, c.frame, c.chirp, c.rx, c.sample, c.re - mre AS re, c.im - mim AS im
      FROM cells c JOIN m USING (capture_id, frame, rx, sample)) {_select('x', 'chirp', 'rx', 'sample')}""")
def _(spark, sf_dir):
    return rounded(C.remove_static_clutter(cells(spark, sf_dir)).df, *CUBE)


_PHASE = "(-2 * pi() * (doppler_bin - 1) * (virtual_rx // 2) / 4.0)"
COMP = f"cmp AS (SELECT capture_id, frame, doppler_bin, virtual_rx, range_bin, re * cos{_PHASE} - im * sin{_PHASE} AS re, re * sin{_PHASE} + im * cos{_PHASE} AS im FROM rd)"


@query("tdm_doppler_phase_compensation", f"WITH {CHAIN}, {COMP} {_select('cmp', 'doppler_bin', 'virtual_rx', 'range_bin')}")
def _(spark, sf_dir):
    return rounded(C.compensate_tdm_doppler_phase(rd_cube(spark, sf_dir), 2, 2).df, *CUBE)


APERTURE = PlanarAperture(((0, 0), (0, 1), (1, 1), (0, 1)))
_GRID = "grid(e, a, src) AS (VALUES (0, 0, 0), (0, 1, 1), (1, 0, NULL), (1, 1, 2))"
_PLANAR = f"""{_GRID}, pl AS (
  SELECT l.capture_id, l.frame, l.doppler_bin, l.range_bin, grid.e AS elevation_aperture, grid.a AS azimuth_aperture,
         coalesce(rd.re, 0) AS re, coalesce(rd.im, 0) AS im
  FROM (SELECT DISTINCT capture_id, frame, doppler_bin, range_bin FROM rd) l CROSS JOIN grid
  LEFT JOIN rd ON rd.capture_id = l.capture_id AND rd.frame = l.frame AND rd.doppler_bin = l.doppler_bin AND rd.range_bin = l.range_bin
       AND rd.virtual_rx = grid.src)"""


@query("planar_aperture", f"WITH {CHAIN}, {_PLANAR} {_select('pl', 'doppler_bin', 'range_bin', 'elevation_aperture', 'azimuth_aperture')}")
def _(spark, sf_dir):
    return rounded(C.map_planar_aperture(rd_cube(spark, sf_dir), APERTURE).df, *CUBE)


_PA = dft_sql("pl", "pa", "azimuth_aperture", "azimuth_bin", [*KEYS, "doppler_bin", "range_bin", "elevation_aperture"], 2, n=4, shift=True)
_PE = dft_sql("pa", "pe", "elevation_aperture", "elevation_bin", [*KEYS, "doppler_bin", "range_bin", "azimuth_bin"], 2, shift=True)


@query("planar_angle_fft", f"WITH {CHAIN}, {_PLANAR}, {_PA}, {_PE} {_select('pe', 'doppler_bin', 'range_bin', 'elevation_bin', 'azimuth_bin')}")
def _(spark, sf_dir):
    plane = C.map_planar_aperture(rd_cube(spark, sf_dir), APERTURE)
    return rounded(C.planar_angle_fft(plane, Fft(4, fftshift=True)).df, *CUBE)


SUB = Subarray((3, 1, 0), ((0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (1.0, 0.0, 0.0)))


@query("virtual_subarray", f"""WITH {CHAIN}, s(v, n) AS (VALUES (3, 0), (1, 1), (0, 2)),
x AS (SELECT capture_id, frame, doppler_bin, s.n AS virtual_rx, range_bin, re, im FROM rd JOIN s ON s.v = rd.virtual_rx)
{_select('x', 'doppler_bin', 'virtual_rx', 'range_bin')}""")
def _(spark, sf_dir):
    return rounded(C.select_virtual_subarray(rd_cube(spark, sf_dir), SUB).df, *CUBE)


_COEF = [1 + 0j, 0.5 - 0.5j, -1 + 0.25j, 0.75j]
_COEF_SQL = "cal(v, cr, ci) AS (VALUES " + ", ".join(f"({i}, {c.real}, {c.imag})" for i, c in enumerate(_COEF)) + ")"


@query("channel_calibration", f"""WITH {CHAIN}, {_COEF_SQL},
x AS (SELECT capture_id, frame, doppler_bin, virtual_rx, range_bin, re * cr - im * ci AS re, re * ci + im * cr AS im
      FROM rd JOIN cal ON v = virtual_rx) {_select('x', 'doppler_bin', 'virtual_rx', 'range_bin')}""")
def _(spark, sf_dir):
    return rounded(C.apply_virtual_channel_calibration(rd_cube(spark, sf_dir), _COEF).df, *CUBE)


_FREQ = {(t, r): 0.01 * (1 + 2 * t + r) for t in range(2) for r in range(2)}
_CORR = dict(zip(sorted(_FREQ), _COEF))
_FREQ_SQL = "cal(v, f, cr, ci) AS (VALUES " + ", ".join(f"({t * 2 + r}, {f}::DOUBLE, {_CORR[t, r].real}, {_CORR[t, r].imag})" for (t, r), f in sorted(_FREQ.items())) + ")"


@query("time_domain_calibration", f"""WITH {cells_sql()}, {_FREQ_SQL},
t AS (SELECT capture_id, frame, (chirp // 2)::INT AS loop, ((chirp % 2) * 2 + rx)::INT AS virtual_rx, sample, re, im FROM cells),
y AS (SELECT t.*, re * cr - im * ci AS yr, re * ci + im * cr AS yi, f * sample AS a FROM t JOIN cal ON v = virtual_rx),
x AS (SELECT capture_id, frame, loop, virtual_rx, sample, yr * cos(a) - yi * sin(a) AS re, yr * sin(a) + yi * cos(a) AS im FROM y)
{_select('x', 'loop', 'virtual_rx', 'sample')}""")
def _(spark, sf_dir):
    return rounded(C.apply_time_domain_calibration(C.map_tdm_virtual_array(cells(spark, sf_dir), 2), _FREQ, _CORR, 2).df, *CUBE)


_ANGLE = dft_sql("rd", "ang", "virtual_rx", "azimuth_bin", [*KEYS, "doppler_bin", "range_bin"], 4, n=8, window="hann", shift=True)


@query("angle_fft", f"WITH {CHAIN}, {_ANGLE} {_select('ang', 'doppler_bin', 'azimuth_bin', 'range_bin')}")
def _(spark, sf_dir):
    return rounded(C.angle_fft(rd_cube(spark, sf_dir), Fft(8, "hann", True)).df, *CUBE)


MAG = "mag AS (SELECT capture_id, frame, doppler_bin, range_bin, {how}(sqrt(re * re + im * im)) AS magnitude FROM rd GROUP BY ALL)"

for _how, _sql in (("max", "max"), ("sum", "sum"), ("mean", "avg")):

    def _magnitude(spark, sf_dir, how=_how):
        return rounded(C.range_doppler_magnitude(rd_cube(spark, sf_dir), how), "magnitude")

    query(f"range_doppler_magnitude_{_how}", f"WITH {CHAIN}, {MAG.format(how=_sql)} SELECT capture_id, frame, doppler_bin, range_bin, {r4('magnitude')} FROM mag")(_magnitude)

# --- detection


@query("detect_threshold", f"WITH {CHAIN}, {MAG.format(how='max')} SELECT capture_id, frame, range_bin, doppler_bin, {r4('magnitude')} FROM mag WHERE magnitude >= 4000.123")
def _(spark, sf_dir):
    return rounded(D.threshold_range_doppler(rd_cube(spark, sf_dir), PeakDetection(4000.123)), "magnitude")


for _strict, _op in ((True, ">"), (False, ">=")):

    def _azimuth(spark, sf_dir, strict=_strict):
        cube = C.angle_fft(rd_cube(spark, sf_dir), Fft(8, "hann", True))
        return rounded(D.threshold_azimuth(cube, PeakDetection(2000.123, azimuth_peak_radius=2, azimuth_peak_strict=strict)), "magnitude")

    query(f"detect_azimuth_peaks_{'strict' if _strict else 'plateau'}", f"""WITH {CHAIN}, {_ANGLE},
am AS (SELECT capture_id, frame, range_bin, doppler_bin, azimuth_bin, sqrt(re * re + im * im) AS magnitude FROM ang)
SELECT capture_id, frame, range_bin, doppler_bin, azimuth_bin, {r4('magnitude')} FROM am a WHERE magnitude >= 2000.123 AND NOT EXISTS (
  SELECT 1 FROM am b WHERE b.capture_id = a.capture_id AND b.frame = a.frame AND b.range_bin = a.range_bin AND b.doppler_bin = a.doppler_bin
  AND b.azimuth_bin <> a.azimuth_bin AND abs(b.azimuth_bin - a.azimuth_bin) <= 2 AND NOT a.magnitude {_op} b.magnitude)""")(_azimuth)


def _noise_sql(mode: str, t: int) -> str:
    return {"ca": f"(l + r) / {2 * t}.0", "go": f"greatest(l / {t}.0, r / {t}.0)", "so": f"least(l / {t}.0, r / {t}.0)", "cacc": "l + r"}[mode]


def _cfar_sql(mode: str, g: int, t: int, scale: float, cyclic: bool, left: int = 0, right: int = 0) -> str:
    rad, n = g + t, 30
    lag = "(a.day - b.day + 30) % 30" if cyclic else "a.day - b.day"
    lead = "(b.day - a.day + 30) % 30" if cyclic else "b.day - a.day"
    low, high = (left, n - right) if cyclic else (left + rad, n - right - rad)
    return f"""WITH {DAILY_SQL}, s AS (
  SELECT a.user_id, a.day, a.power, sum(CASE WHEN {lag} BETWEEN {g + 1} AND {rad} THEN b.power ELSE 0 END) AS l,
         sum(CASE WHEN {lead} BETWEEN {g + 1} AND {rad} THEN b.power ELSE 0 END) AS r
  FROM daily a JOIN daily b ON a.user_id = b.user_id GROUP BY ALL),
n AS (SELECT user_id, day, power, {_noise_sql(mode, t)} AS noise FROM s WHERE day >= {low} AND day < {high})
SELECT user_id, day, {r4('noise', 6)} FROM n WHERE power > noise * {scale}"""


for _mode, _scale in (("ca", 2.5013), ("go", 2.0013), ("so", 3.0013), ("cacc", 0.3013)):

    def _cfar(spark, sf_dir, mode=_mode, scale=_scale):
        return rounded(D.detect_cfar_1d(daily_power(spark, sf_dir), ["user_id"], "day", "power", 30, Cfar1D(4, 1, scale, mode)), "noise", digits=6)

    query(f"cfar_1d_{_mode}", _cfar_sql(_mode, 1, 4, _scale, False))(_cfar)


@query("cfar_1d_cyclic_skips", _cfar_sql("ca", 1, 3, 2.5013, True, 2, 3))
def _(spark, sf_dir):
    return rounded(D.detect_cfar_1d(daily_power(spark, sf_dir), ["user_id"], "day", "power", 30, Cfar1D(3, 1, 2.5013, "ca", True, 2, 3)), "noise", digits=6)


COMPOSED = RangeDopplerCfar(Cfar1D(2, 0, 1.5013), Cfar1D(2, 1, 1.2013, "go", cyclic=True))
_COMPOSED_SQL = f"""{MAP_SQL}, s AS (SELECT *, magnitude * magnitude AS p FROM map),
rn AS (SELECT a.capture_id, a.frame, a.doppler_bin, a.range_bin, sum(b.p) / 4.0 AS noise FROM s a JOIN s b
  ON a.capture_id = b.capture_id AND a.doppler_bin = b.doppler_bin AND abs(a.range_bin - b.range_bin) BETWEEN 1 AND 2
  WHERE a.range_bin BETWEEN 2 AND 5 GROUP BY ALL),
dn AS (SELECT a.capture_id, a.frame, a.doppler_bin, a.range_bin,
  greatest(sum(CASE WHEN (a.doppler_bin - b.doppler_bin + 8) % 8 BETWEEN 2 AND 3 THEN b.p ELSE 0 END) / 2.0,
           sum(CASE WHEN (b.doppler_bin - a.doppler_bin + 8) % 8 BETWEEN 2 AND 3 THEN b.p ELSE 0 END) / 2.0) AS noise
  FROM s a JOIN s b ON a.capture_id = b.capture_id AND a.range_bin = b.range_bin GROUP BY ALL),
det AS (SELECT s.capture_id, s.frame, s.range_bin, s.doppler_bin, s.magnitude, greatest(rn.noise, dn.noise) AS noise, s.p / greatest(rn.noise, dn.noise) AS snr
  FROM s JOIN rn USING (capture_id, frame, doppler_bin, range_bin) JOIN dn USING (capture_id, frame, doppler_bin, range_bin)
  WHERE s.p > rn.noise * 1.5013 AND s.p > dn.noise * 1.2013)"""


def composed(spark, sf_dir):
    return D.detect_range_doppler_cfar(magnitude_cube(spark, sf_dir), COMPOSED)


_DET_COLS = f"capture_id, frame, range_bin, doppler_bin, {r4('magnitude')}, {r4('noise')}, {r4('snr')}"


@query("cfar_range_doppler", f"WITH {_COMPOSED_SQL} SELECT {_DET_COLS} FROM det")
def _(spark, sf_dir):
    return rounded(composed(spark, sf_dir), "magnitude", "noise", "snr")


@query("filter_detection_quality", f"WITH {_COMPOSED_SQL} SELECT {_DET_COLS} FROM det WHERE snr >= 3.00013")
def _(spark, sf_dir):
    return rounded(D.filter_detection_quality(composed(spark, sf_dir), 3.00013), "magnitude", "noise", "snr")


@query("cfar_2d", f"""WITH {MAP_SQL}, n AS (
  SELECT a.capture_id, a.frame, a.doppler_bin, a.range_bin, a.magnitude,
    sum(CASE WHEN abs(a.doppler_bin - b.doppler_bin) <= 2 AND abs(a.range_bin - b.range_bin) <= 2
             AND NOT (abs(a.doppler_bin - b.doppler_bin) <= 1 AND abs(a.range_bin - b.range_bin) <= 1) THEN b.magnitude ELSE 0 END) / 16.0 AS noise
  FROM map a JOIN map b ON a.capture_id = b.capture_id
  WHERE a.doppler_bin BETWEEN 2 AND 5 AND a.range_bin BETWEEN 2 AND 5 GROUP BY ALL)
SELECT capture_id, frame, range_bin, doppler_bin, {r4('magnitude')} FROM n WHERE magnitude > noise * 1.8013""")
def _(spark, sf_dir):
    return rounded(D.detect_cfar_2d(magnitude_cube(spark, sf_dir), Cfar2D(1, 1, 1.8013)), "magnitude")


def _group_sql(cyclic: bool, op: str) -> str:
    near = "least((a.doppler_bin - b.doppler_bin + 8) % 8, (b.doppler_bin - a.doppler_bin + 8) % 8)" if cyclic else "abs(a.doppler_bin - b.doppler_bin)"
    return f"""WITH {_COMPOSED_SQL} SELECT {_DET_COLS} FROM det a WHERE NOT EXISTS (SELECT 1 FROM map b WHERE b.capture_id = a.capture_id
  AND {near} <= 1 AND abs(a.range_bin - b.range_bin) <= 1 AND (a.doppler_bin, a.range_bin) <> (b.doppler_bin, b.range_bin) AND NOT a.magnitude {op} b.magnitude)"""


@query("group_detection_peaks", _group_sql(True, ">"))
def _(spark, sf_dir):
    cube = magnitude_cube(spark, sf_dir)
    return rounded(D.group_detection_peaks(cube, D.detect_range_doppler_cfar(cube, COMPOSED)), "magnitude", "noise", "snr")


@query("group_detection_peaks_bounded", _group_sql(False, ">="))
def _(spark, sf_dir):
    cube = magnitude_cube(spark, sf_dir)
    found = D.detect_range_doppler_cfar(cube, COMPOSED)
    return rounded(D.group_detection_peaks(cube, found, PeakGrouping(cyclic_doppler=False, strict=False)), "magnitude", "noise", "snr")


# --- angles and points

ULA = Subarray((0, 1, 2, 3), tuple((0.5 * i, 0.0, 0.0) for i in range(4)))


@query("angle_bin_angles", "SELECT b::INT AS bin, round(asin((b - 8) / 16.0 / 0.5), 6) + 0.0 AS angle_rad FROM range(16) t(b)")
def _(spark, sf_dir):
    return rounded(angle.angle_bins(spark, 16, list(ULA.positions)), "angle_rad", digits=6)


_DET_RD = f"{MAG.format(how='max')}, det AS (SELECT * FROM mag WHERE magnitude >= 4000.123)"
_AZ8 = dft_sql("rd", "ang", "virtual_rx", "azimuth_bin", [*KEYS, "doppler_bin", "range_bin"], 4, n=8, shift=True)
_CAND = f"""{_DET_RD}, {_AZ8}, am AS (SELECT ang.*, sqrt(re * re + im * im) AS angle_magnitude FROM ang),
best AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame, doppler_bin, range_bin ORDER BY round(angle_magnitude, 6) DESC, azimuth_bin) AS rn FROM am),
az AS (SELECT det.capture_id, det.frame, det.range_bin, det.doppler_bin, azimuth_bin, asin((azimuth_bin - 4) / 8.0 / 0.5) AS azimuth_rad, magnitude, angle_magnitude
       FROM det JOIN best USING (capture_id, frame, doppler_bin, range_bin) WHERE rn = 1)"""


def candidates(spark, sf_dir):
    rd = rd_cube(spark, sf_dir)
    found = D.threshold_range_doppler(rd, PeakDetection(4000.123))
    return rd, angle.estimate_candidate_azimuths(rd, found, Fft(8, fftshift=True), ULA)


@query("candidate_azimuths", f"WITH {CHAIN}, {_CAND} SELECT capture_id, frame, range_bin, doppler_bin, azimuth_bin, {r4('azimuth_rad')}, {r4('magnitude')}, {r4('angle_magnitude')} FROM az")
def _(spark, sf_dir):
    return rounded(candidates(spark, sf_dir)[1], "azimuth_rad", "magnitude", "angle_magnitude")


PROJECTION = Projection(0.25, 0.5, True, 2, True)
_POINTS = f"""pts AS (SELECT capture_id, frame, range_bin * 0.25 * sin(azimuth_rad) AS x,
  range_bin * 0.25 * sqrt(greatest(1 - sin(azimuth_rad) * sin(azimuth_rad), 0)) AS y, 0.0 AS z,
  (doppler_bin - 1) * 0.5 AS velocity, range_bin * 0.25 AS range_m, range_bin, doppler_bin, azimuth_rad, magnitude, angle_magnitude FROM az)"""
_POINT_COLS = ", ".join(r4(c) for c in ("x", "y", "z", "velocity", "range_m", "azimuth_rad", "magnitude", "angle_magnitude"))


@query("detections_to_point_cloud", f"WITH {CHAIN}, {_CAND}, {_POINTS} SELECT capture_id, frame, range_bin, doppler_bin, {_POINT_COLS} FROM pts")
def _(spark, sf_dir):
    points = angle.detections_to_points(candidates(spark, sf_dir)[1], PROJECTION)
    return rounded(points, "x", "y", "z", "velocity", "range_m", "azimuth_rad", "magnitude", "angle_magnitude")


ROW_A = Subarray((0, 1), ((0.0, 0.0, 0.0), (0.5, 0.0, 0.0)))
ROW_E = Subarray((2, 3), ((0.5, 0.0, 0.5), (1.0, 0.0, 0.5)))
_ROW = "SELECT capture_id, frame, doppler_bin, range_bin, virtual_rx - {o} AS virtual_rx, re, im FROM rd WHERE virtual_rx IN ({o}, {o} + 1)"
_EL = f"""{_DET_RD}, ra AS ({_ROW.format(o=0)}), re_ AS ({_ROW.format(o=2)}),
{dft_sql('ra', 'fa', 'virtual_rx', 'azimuth_bin', [*KEYS, 'doppler_bin', 'range_bin'], 2, n=8, shift=True)},
{dft_sql('re_', 'fe', 'virtual_rx', 'azimuth_bin', [*KEYS, 'doppler_bin', 'range_bin'], 2, n=8, shift=True)},
best AS (SELECT *, sqrt(re * re + im * im) AS angle_magnitude, row_number() OVER (PARTITION BY capture_id, frame, doppler_bin, range_bin ORDER BY round(sqrt(re * re + im * im), 6) DESC, azimuth_bin) AS rn FROM fa),
az AS (SELECT det.capture_id, det.frame, det.range_bin, det.doppler_bin, best.azimuth_bin, asin((best.azimuth_bin - 4) / 8.0 / 0.5) AS azimuth_rad, magnitude, angle_magnitude, best.re AS a_re, best.im AS a_im
       FROM det JOIN best USING (capture_id, frame, doppler_bin, range_bin) WHERE rn = 1),
v AS (SELECT az.*, sqrt(fe.re * fe.re + fe.im * fe.im) AS elevation_magnitude,
  (atan2(fe.im * a_re - fe.re * a_im, fe.re * a_re + fe.im * a_im) / (2 * pi()) - 0.5 * sin(azimuth_rad)) / 0.5 + 1.0 AS u
  FROM az JOIN fe USING (capture_id, frame, doppler_bin, range_bin, azimuth_bin)),
el AS (SELECT *, u - 2.0 * floor(u / 2.0) - 1.0 AS vert FROM v)"""


@query("candidate_elevations", f"""WITH {CHAIN}, {_EL} SELECT capture_id, frame, range_bin, doppler_bin, azimuth_bin, {r4('azimuth_rad')}, {r4('magnitude')}, {r4('angle_magnitude')},
  round(asin(greatest(-1, least(1, vert))), 4) + 0.0 AS elevation_rad, {r4('elevation_magnitude')} FROM el
  WHERE abs(vert) <= 1 + 1e-6 AND sin(azimuth_rad) * sin(azimuth_rad) + vert * vert <= 1 + 1e-6""")
def _(spark, sf_dir):
    rd = rd_cube(spark, sf_dir)
    found = D.threshold_range_doppler(rd, PeakDetection(4000.123))
    az = angle.estimate_candidate_azimuths(rd, found, Fft(8, fftshift=True), ROW_A)
    el = angle.estimate_candidate_elevations(rd, az, Fft(8, fftshift=True), ROW_A, ROW_E)
    return rounded(el, "azimuth_rad", "magnitude", "angle_magnitude", "elevation_rad", "elevation_magnitude")


# --- vital signs

_WAVE = """wave AS (SELECT user_id, event_id, atan2(sin(value), cos(value)) AS p FROM events),
lagged AS (SELECT *, p - lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM wave),
un AS (SELECT user_id, event_id, p + coalesce(sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0 END)
       OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS value FROM lagged),
ph AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS value FROM un)"""


def phases(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.cos("value").alias("re"), F.sin("value").alias("im"))
    return V.extract_phase(events, ["user_id"], "event_id")


@query("vital_sign_phase", f"WITH {_WAVE} SELECT user_id, event_id, {r4('value')} FROM ph")
def _(spark, sf_dir):
    return rounded(phases(spark, sf_dir), "value")


@query("phase_to_displacement", f"WITH {_WAVE} SELECT user_id, event_id, round(value * {0.005 / (4 * math.pi)!r}, 7) + 0.0 AS value FROM ph")
def _(spark, sf_dir):
    return rounded(V.phase_to_displacement(phases(spark, sf_dir), 0.005), "value", digits=7)


@query("vital_amplitude_spectrum", f"""WITH {_WAVE}, i AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ph),
w AS (SELECT *, CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS w FROM i),
s AS (SELECT user_id, n, b.b::INT AS bin, sum(w) AS w, sum(value * w * cos(2 * pi() * ((b.b * i) % n) / n)) AS c, sum(value * w * sin(2 * pi() * ((b.b * i) % n) / n)) AS s
  FROM w JOIN range(4097) b(b) ON b.b <= w.n // 2 GROUP BY ALL)
SELECT user_id, bin, round(2 * (CASE WHEN bin = 0 OR bin * 2 = n THEN 0.5 ELSE 1 END) * sqrt(c * c + s * s) / w, 4) + 0.0 AS amplitude FROM s""")
def _(spark, sf_dir):
    return rounded(V.amplitude_spectrum(phases(spark, sf_dir), ["user_id"], "event_id"), "amplitude")


@query("display_scaling", f"""WITH {MAP_SQL} SELECT capture_id, doppler_bin, range_bin, {r4('magnitude')}, round(magnitude * magnitude, 4) AS power,
  round(20 * log10(greatest(magnitude, 2.2250738585072014e-308)), 4) + 0.0 AS db FROM map""")
def _(spark, sf_dir):
    m = C.range_doppler_magnitude(magnitude_cube(spark, sf_dir))
    scaled = m.select("capture_id", "doppler_bin", "range_bin", "magnitude", V.display_scale(F.col("magnitude"), "power").alias("power"), V.display_scale(F.col("magnitude")).alias("db"))
    return rounded(scaled, "magnitude", "power", "db")


@query("range_doppler_map", f"WITH {CHAIN} SELECT capture_id, doppler_bin, range_bin, round(avg(sqrt(re * re + im * im)), 4) AS magnitude FROM rd GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(V.mean_magnitude_map(rd_cube(spark, sf_dir), "capture_id", "doppler_bin", "range_bin"), "magnitude")


@query("range_time_map", f"WITH {cells_sql()}, {RANGE} SELECT capture_id, frame, range_bin, round(avg(sqrt(re * re + im * im)), 4) AS magnitude FROM rng GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(V.mean_magnitude_map(range_cube(spark, sf_dir), "capture_id", "frame", "range_bin"), "magnitude")
