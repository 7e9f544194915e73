"""Known answers, computed by hand, and contradictions that must be refused."""

import math
import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.operators import angle as A, clustering as K, cube as C, detection as D, dense as DN, intervals as I, packets as P, tracking as T, track_metrics as M, vitals as V
from echofield.operators.adc import organize_adc_samples
from echofield.operators.cartesian import sparsify_volume
from echofield.plans import format_queries, presets, runners, track_queries, volume_queries
from echofield.plans.signals import exact_sum, sql_round
from echofield.plans.contracts import (
    AdcFrame, Allocation, Box2D, Cfar1D, ContractError, Dbscan, DetectionRecipe, Fft, Gating, LAYOUTS, Lifecycle, PeakDetection, PeakGrouping,
    PlanarAperture, Projection, RadarCapture, RadarProfile, RangeDopplerCfar, RangeDopplerRecipe, Scenery, Sparsification, VirtualArray, with_changes,
)

sys.path.insert(0, os.path.dirname(__file__))
from oracle import SMALL, compare  # noqa: E402


def frames(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "capture_id bigint, samples array<smallint>")


def cells_of(cube):
    return {tuple(r[a] for a in cube.axes): complex(r.re, r.im) for r in cube.df.collect()}


# --- decoding


@pytest.mark.parametrize("layout,words,shape", [
    ("iq_interleaved", [1, 10, 2, 20, 3, 30, 4, 40], (1, 2, 2)),
    ("sample_i_then_q", [1, 3, 10, 30, 2, 4, 20, 40], (1, 2, 2)),
    ("group2_i_then_q", [1, 2, 10, 20, 3, 4, 30, 40, 5, 6, 50, 60, 7, 8, 70, 80], (1, 2, 4)),
])
def test_layouts(spark, layout, words, shape):
    cube = organize_adc_samples(frames(spark, words), AdcFrame(*shape, layout))
    got = cells_of(cube)
    ordered = [got[k] for k in sorted(got)]
    assert ordered == [complex(i, 10 * i) for i in range(1, len(ordered) + 1)]


def test_incomplete_frames(spark):
    spec = AdcFrame(1, 1, 2)
    raw = frames(spark, [1, 2, 3, 4, 5])
    assert organize_adc_samples(raw, spec, drop_incomplete=True).df.count() == 2
    with pytest.raises(Exception, match="incomplete"):
        organize_adc_samples(raw, spec).df.count()
    with pytest.raises(Exception, match="incomplete"):
        organize_adc_samples(frames(spark, [1, 2]), spec, drop_incomplete=True).df.count()


def test_several_frames_in_a_row(spark):
    cube = organize_adc_samples(frames(spark, range(8)), AdcFrame(1, 1, 2))
    assert sorted((r.frame, r["sample"], r.re) for r in cube.df.collect()) == [(0, 0, 0.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 6.0)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_dense_equals_long(spark, layout):
    rng = np.random.default_rng(3)
    raw = frames(spark, *[[int(x) for x in rng.integers(-500, 500, 96)] for _ in range(2)])
    array = VirtualArray(presets.geometry("xwr1642"), (1, 0))
    adc = AdcFrame(6, 2, 4, layout)
    array = VirtualArray(with_changes(array.geometry, rx=array.geometry.rx[:2]), (1, 0))
    recipe = RangeDopplerRecipe(adc, Fft(8, "hann", remove_dc=True), Fft(5, "hamming", True), array, tuple((1.0, 0.1 * i) for i in range(4)), True)
    long, dense = runners.adc_to_range_doppler(raw, recipe), DN.dense_range_doppler(raw, recipe).long()
    assert long.shape == dense.shape
    both = long.df.alias("a").join(dense.df.alias("b"), [*long.keys, *long.axes])
    n, worst = both.agg(F.count(F.lit(1)), F.max(F.abs(F.col("a.re") - F.col("b.re")) + F.abs(F.col("a.im") - F.col("b.im")))).first()
    assert n == 2 * math.prod(long.shape.values()) and worst < 1e-9


def test_fft_against_numpy(spark):
    rng = np.random.default_rng(1)
    words = [int(x) for x in rng.integers(-99, 99, 14)]
    x = np.array(words[0::2]) + 1j * np.array(words[1::2])
    cube = organize_adc_samples(frames(spark, words), AdcFrame(1, 1, 7))
    for spec in (Fft(), Fft(4), Fft(12, "hann", fftshift=True), Fft(None, "hamming", one_sided=True, remove_dc=True)):
        got = cells_of(C.fft_axis(cube, "sample", "bin", spec))
        want = DN.transform(x, 0, spec)
        assert len(got) == len(want)
        assert max(abs(got[0, 0, k] - want[k]) for k in range(len(want))) < 1e-9


def test_chain_has_one_exchange(spark):
    raw = frames(spark, range(64))
    rd = runners.adc_to_range_doppler(raw, RangeDopplerRecipe(AdcFrame(4, 2, 4), virtual=VirtualArray(with_changes(presets.geometry("xwr1642"), rx=presets.geometry("xwr1642").rx[:2]), (0, 1)), remove_clutter=True))
    plan = C.range_doppler_magnitude(rd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# --- cube algebra


def test_static_clutter(spark):
    cube = organize_adc_samples(frames(spark, [1, 1, 3, 3]), AdcFrame(2, 1, 1))
    assert cells_of(C.remove_static_clutter(cube)) == {(0, 0, 0): -1 - 1j, (1, 0, 0): 1 + 1j}


def test_planar_aperture_first_wins(spark):
    cube = organize_adc_samples(frames(spark, [1, 0, 2, 0, 3, 0]), AdcFrame(1, 3, 1))
    cube = C.map_tdm_virtual_array(cube, 1)
    plane = C.map_planar_aperture(cube, PlanarAperture(((0, 0), (1, 1), (0, 0))))
    got = {(r.elevation_aperture, r.azimuth_aperture): r.re for r in plane.df.collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 2.0}


# --- CFAR


def line(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "line_id int, idx int, p double")


def hits(spark, values, spec):
    rows = D.detect_cfar_1d(line(spark, values), ["line_id"], "idx", "p", len(values), spec).collect()
    return {r.idx: r.noise for r in rows}


def test_cfar_modes(spark):
    p = [1, 1, 0, 20, 0, 5, 5]
    noise = {m: hits(spark, p, Cfar1D(2, 0, 1.1, m))[3] for m in ("ca", "go", "so", "cacc")}
    assert noise == {"ca": 1.5, "go": 2.5, "so": 0.5, "cacc": 6.0}


def test_cfar_edges(spark):
    assert hits(spark, [10, 1, 1, 1, 1], Cfar1D(1, 0, 2.0, cyclic=True)) == {0: 1.0}
    assert set(hits(spark, [100, 1, 1, 10, 1, 1, 100], Cfar1D(1, 0, 2.0, left_skip=1, right_skip=1))) == {3}
    assert hits(spark, [1, 20, 1, 1], Cfar1D(2, 0, 1.0)) == {}
    assert hits(spark, [1, float("nan"), 1, 9, 1], Cfar1D(1, 0, 2.0)) == {3: 1.0}


def test_quality_filter_is_inclusive(spark):
    rows = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (float("nan"),)], "snr double")
    assert [r.snr for r in D.filter_detection_quality(rows, 10.0).collect()] == [10.0, 15.0]


def test_grouping_wraps_onto_itself(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 3.0, 0.0)], "capture_id bigint, frame int, doppler_bin int, range_bin int, rx int, re double, im double")
    cube = C.Cube(df, {"doppler_bin": 1, "range_bin": 1, "rx": 1})
    found = D.threshold_range_doppler(cube, PeakDetection(1.0))
    assert D.group_detection_peaks(cube, found).count() == 0  # its wrapped neighbour is the cell itself
    assert D.group_detection_peaks(cube, found, PeakGrouping(cyclic_doppler=False)).count() == 1


# --- angles and points


def test_broadside(spark):
    cube = C.map_tdm_virtual_array(organize_adc_samples(frames(spark, [1, 0] * 4), AdcFrame(1, 4, 1)), 1)
    cube = C.Cube(cube.df.withColumnsRenamed({"loop": "doppler_bin", "sample": "range_bin"}), {"doppler_bin": 1, "virtual_rx": 4, "range_bin": 1})
    found = D.threshold_range_doppler(cube, PeakDetection(0.5))
    row = A.estimate_candidate_azimuths(cube, found, Fft(4, fftshift=True), presets.subarray((0,), "xwr1642", (0, 1))).first()
    assert (row.azimuth_bin, row.azimuth_rad, row.angle_magnitude) == (2, 0.0, 4.0)


@pytest.mark.parametrize("azimuth,elevation", [(0.5235987755982988, 0.0), (-0.3, 0.2)])
def test_end_to_end_target(spark, azimuth, elevation):
    """A synthetic point target comes out at its range, velocity and direction, in both forms."""
    profile = RadarProfile(num_adc_samples=32, num_chirps_per_tx=8)
    cfar = RangeDopplerCfar(Cfar1D(3, 1, 8.0), None)
    recipe = presets.cfar_point_cloud(cfar, PeakGrouping(), profile, 4.0, elevation=True)
    array = recipe.detection.transform.virtual
    rng, n = np.random.default_rng(2), np.arange(32)
    x = rng.normal(0, 1, (8, 3, 4, 32)) + 1j * rng.normal(0, 1, (8, 3, 4, 32))
    u, w = math.sin(azimuth), math.sin(elevation)
    for loop in range(8):
        for t in range(3):
            for r in range(4):
                p = array.positions[4 * t + r]
                x[loop, t, r] += 300 * np.exp(2j * np.pi * (5 * n / 32 + (3 * loop + t) / 24 + p[0] * u + p[2] * w))
    words = np.stack([x.real, x.imag], -1).round().astype(int).ravel().tolist()
    raw = frames(spark, words)
    dense = runners.range_doppler_to_detections(DN.dense_range_doppler(raw, recipe.detection.transform), recipe.detection)
    long = runners.range_doppler_to_detections(runners.adc_to_range_doppler(raw, recipe.detection.transform), recipe.detection)
    for found in (dense, long):
        row = runners.detections_to_point_cloud(found, recipe).orderBy(F.desc("magnitude")).first()
        assert row.range_bin == 5 and row.doppler_bin == 5
        assert abs(math.sin(row.azimuth_rad) - u) < 0.04 and abs(math.sin(row.elevation_rad) - w) < 0.04
        assert abs(row.x - row.range_m * math.sin(row.azimuth_rad)) < 1e-9
        assert abs(row.x**2 + row.y**2 + row.z**2 - row.range_m**2) < 1e-9


def test_contradicting_angles(spark):
    row = spark.createDataFrame([(0, 0, 1, 0, 1.5, 1.5, 1.0)], "capture_id int, frame int, range_bin int, doppler_bin int, azimuth_rad double, elevation_rad double, magnitude double")
    with pytest.raises(Exception, match="contradict"):
        A.detections_to_points(row).collect()


def test_doppler_velocity(spark):
    bins = spark.range(4)
    v = lambda spec: [r[0] for r in bins.select(A.doppler_velocity(F.col("id"), spec)).collect()]
    assert v(Projection(1, 2)) == [0, 2, 4, 6]
    assert v(Projection(1, 2, True, 4, True)) == [-4, -2, 0, 2]
    assert v(Projection(1, 2, True, 4, False)) == [0, 2, -4, -2]


# --- clusters, assignment, tracks


def test_dbscan(spark):
    pts = [(0, 1, 0, 0.3), (0.1, 1.1, 0, 0.3), (3, 4, 0.5, -1.1), (3.1, 4.1, 0.5, -1.1), (9, 9, 9, 0)]
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "frame_id bigint, point_idx int, x double, y double, z double, velocity double")
    labels = K.cluster_points(df, Dbscan(0.3, 2, 0.2))
    assert [r.cluster_id for r in labels.orderBy("point_idx").collect()] == [0, 0, 1, 1, -1]
    a, b = K.summarize_clusters(df, labels).orderBy("cluster_id").collect()
    assert (round(a.cx, 3), round(a.cy, 3), round(a.mean_velocity, 3), a.point_count) == (0.05, 1.05, 0.3, 2)
    assert (round(b.cz, 3), round(b.ex, 3), round(b.mean_velocity, 3)) == (0.5, 0.1, -1.1)


@pytest.mark.parametrize("seed,use_z,scale", [(0, True, 0.0), (1, False, 0.0), (2, True, 0.5)])
def test_dbscan_grid_equals_point_by_point(monkeypatch, seed, use_z, scale):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(c, 0.3, (150, 3)) for c in ((0, 0, 0), (1.2, 0, 0), (5, 5, 1))] + [rng.uniform(-4, 8, (200, 3)), np.zeros((20, 3))])
    points = np.round(rng.permutation(points), 1)  # many distances equal eps
    velocity, spec = rng.normal(0, 1, len(points)), Dbscan(0.5, 5, scale, use_z)
    plain = K.dbscan_labels(points, velocity, spec)
    monkeypatch.setattr(K, "ROWS", 0)
    for pairs in (1 << 20, 64):
        monkeypatch.setattr(K, "PAIRS", pairs)
        assert (K.dbscan_labels(points, velocity, spec) == plain).all() and plain.max() >= 1


def test_dbscan_of_many_points():
    """50,000 points: memory and work grow with the neighbours, not with all pairs."""
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 100, (50_000, 3)) * (1, 1, 0.02)
    labels = K.dbscan_labels(points, None, Dbscan(0.5, 4))
    assert len(labels) == 50_000 and labels.max() > 100 and (labels == -1).any()


def test_dense_projection_equals_long(spark):
    from echofield.operators.cartesian import PlanarProjector, project_dense

    rng = np.random.default_rng(5)
    raw = frames(spark, *rng.integers(-99, 99, (2, 2 * 8 * 2 * 6)).tolist())
    adc = AdcFrame(8, 2, 6)
    long = C.doppler_fft(C.map_tdm_virtual_array(C.range_fft(organize_adc_samples(raw, adc), Fft()), 2))
    dense = DN.DenseCube(raw, adc).range_fft().then("tdm", 2).doppler_fft()
    for na, ne in ((8, 4), (5, 3), (2, 2)):
        p = PlanarProjector(PlanarAperture(((0, 0), (0, 1), (1, 2), (0, 1))), 0.4, 6, 4, -1.0, 0.5, 5, -1.3, 0.3, (3, 4, 5), (-0.2, -0.9, -0.5), (0.4, 0.5, 0.5), na, ne)
        at = lambda df: {tuple(r[c] for c in ("capture_id", "frame", "d", "z", "y", "x")): r.magnitude for r in df.collect()}
        a, b = at(p.project(long)), at(project_dense(dense, p))
        assert a.keys() == b.keys() and len(a) == 2 * 5 * 60 and all(abs(a[k] - b[k]) < 1e-6 for k in a) and any(a.values())


def test_dbscan_border_goes_to_the_lowest_cluster():
    # the point in the middle is in reach of a core point of either cluster, but no core point itself
    x = np.array([[0, 0, 0], [0.05, 0, 0], [0.1, 0, 0], [0.55, 0, 0], [1.0, 0, 0], [1.05, 0, 0], [1.1, 0, 0]], float)
    assert K.dbscan_labels(x, None, Dbscan(0.46, 4)).tolist() == [0, 0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("cost,rows,cols", [
    ([[4, 1, 3], [2, 0, 5], [3, 2, 2]], [0, 1, 2], [1, 0, 2]),
    ([[10, 1], [1, 10], [2, 2]], [0, 1], [1, 0]),
    (np.ones((2, 3)), [0, 1], [0, 1]),
    (np.zeros((0, 3)), [], []),
])
def test_assignment(cost, rows, cols):
    r, c = K.linear_sum_assignment(np.array(cost, float))
    assert (r.tolist(), c.tolist()) == (rows, cols)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(5)
    for n, m in ((3, 3), (3, 5), (5, 3), (1, 4)):
        for _ in range(30):
            cost = rng.integers(0, 6, (n, m)).astype(float)
            r, c = K.linear_sum_assignment(cost)
            wide = cost if n <= m else cost.T
            best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
            assert cost[r, c].sum() == best
    with pytest.raises(ValueError):
        K.linear_sum_assignment(np.array([[np.nan]]))


SPEC = T.TrackerSpec(T.Dynamics(0.1), Gating(0.5), lifecycle=Lifecycle(3, 2, 3))


def feed(tracks, *frames_):
    one = lambda x: np.array([[x, 1.0, 0.0]])
    out = []
    for x in frames_:
        c = np.zeros((0, 3)) if x is None else one(x)
        ids = T.step_clusters(tracks, c, np.zeros_like(c), np.zeros(len(c)), np.ones(len(c), np.int64))
        out.append((ids.tolist(), [(r["track_id"], r["status"]) for r in tracks.report()]))
    return out


def test_tracker_lifecycle():
    tracks = T.TrackSet(SPEC)
    out = feed(tracks, 0.0, 0.1, 0.2)
    assert out[0] == ([0], [(0, "tentative")]) and out[2] == ([0], [(0, "confirmed")])
    assert tracks.state[0, 2] > 0
    out = feed(tracks, None, None, None)
    assert [o[1] for o in out] == [[(0, "coasting")], [(0, "coasting")], []]
    assert feed(tracks, 0.5)[0] == ([1], [(1, "tentative")])  # identities are not reused


def test_tracker_state_survives_storage():
    tracks = T.TrackSet(SPEC)
    feed(tracks, 0.0, 0.1)
    again = T.TrackSet.load(SPEC, tracks.dump())
    assert feed(tracks, 0.2) == feed(again, 0.2)
    assert np.allclose(tracks.cov, again.cov)


def test_tracker_limits():
    box = Scenery((Box2D(-1, 1, 0, 2),), 2)
    spec = T.TrackerSpec(T.Dynamics(0.1), Gating(0.5), Allocation(2, 0.1, None, 1), Lifecycle(1, 2, 3), box, 3)
    tracks = T.TrackSet(spec)
    c = np.array([[0.0, 1, 0], [5, 1, 0], [0.9, 1, 0], [-0.9, 1, 0]])
    ids = T.step_clusters(tracks, c, np.zeros_like(c), np.array([1.0, 1, 1, 0]), np.array([2, 9, 5, 9]))
    assert ids.tolist() == [-1, -1, 0, -1]  # outside the box, too slow, one new track a frame; the larger first
    assert tracks.report()[0]["status"] == "confirmed"


def test_measurement_tracker_moments():
    tracks = T.TrackSet(SPEC)
    pts = np.array([[0.0, 1, 0], [0.2, 1, 0], [0.1, 1.1, 0]])
    ids = T.step_points(tracks, Dbscan(0.3, 2), pts, np.zeros(3), np.ones(3))
    assert ids.tolist() == [0, 0, 0]
    assert np.allclose(tracks.extent[0], np.cov(pts[:, :2].T, bias=True))


def test_track_summary(spark):
    rows = [(f, 7, x, y, 0.0, v, 0.0, 0.0, s) for f, x, y, v, s in ((0, 0.0, 1.0, 0.5, "tentative"), (1, 0.3, 1.4, 0.7, "confirmed"), (2, 0.6, 1.8, 0.8, "confirmed"), (4, 1.2, 1.8, 2.0, "confirmed"))]
    df = spark.createDataFrame(rows, "frame_id bigint, track_id bigint, px double, py double, pz double, vx double, vy double, vz double, status string")
    r = M.summarize_tracks(df).first()
    assert (round(r.median_px, 6), round(r.median_py, 6), round(r.path_length_m, 6), round(r.median_speed_mps, 6), r.max_speed_mps) == (0.45, 1.6, 1.6, 0.75, 2.0)
    assert r.confirmed_intervals == [[1, 2], [4, 4]] and r.in_scenery_frames is None
    with pytest.raises(Exception, match="twice"):
        M.summarize_tracks(df.unionByName(df)).collect()


def test_sparsification_keeps_its_partitions(spark):
    """A task's memory is bounded by the number of shuffle partitions, not by the bytes that adaptive execution joins."""
    points, counters = volume_queries.sparse(spark, SMALL)
    assert points.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert counters.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_causal_stream_ends_after_its_data(spark, tmp_path, monkeypatch):
    """One batch holds the whole finite stream; its pairs are those of the batch join."""
    monkeypatch.setattr(format_queries, "shared_dir", lambda *_: f"file://{tmp_path}/causal")
    usual = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted(map(tuple, format_queries.QUERIES["causal_pairs_stream"](spark, SMALL).collect()))
    assert got == sorted(map(tuple, track_queries.QUERIES["causal_pairs"](spark, SMALL).collect()))
    assert [f for f in os.listdir(tmp_path / "causal/ck/commits") if not f.startswith(".")] == ["0"]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == usual


def event_table(spark, path, values, days=1):
    """A user's events, the same values each day, written in the given order."""
    rows = [(d * len(values) + i, f"2024-01-{d + 1:02d} 00:00:{i:02d}", 7, "click", v, "{}") for d in range(days) for i, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


EDGE = [60.1, 66.68, 19.74, 13.48]  # a mean of 40, px = 4.0 on the edge of a box; as doubles in the second order above it
ORDERS = [(0, 1, 2, 3), (1, 3, 0, 2)]


@pytest.mark.parametrize("order", ORDERS)
def test_scenery_edge_in_any_order(spark, tmp_path, order):
    sf_dir = event_table(spark, tmp_path, [EDGE[i] for i in order])
    assert [tuple(r) for r in format_queries.QUERIES["scenery_filter"](spark, sf_dir).collect()] == [(0, 7)]


@pytest.mark.parametrize("order", ORDERS)
def test_track_summary_in_any_order(spark, tmp_path, order):
    sf_dir = event_table(spark, tmp_path, [EDGE[i] for i in order], days=3)
    r = track_queries.QUERIES["summarize_tracks"](spark, sf_dir).first()
    assert (r.observed_frames, r.in_scenery_frames, r.outside_scenery_frames, r.median_px) == (3, 3, 0, 4.0)


def test_track_summary_rounds_as_its_sql(spark, tmp_path):
    """A mean half-way between two rounded numbers: 1.17 over 16 events, px = 0.0073125; its sum is the same in any order."""
    sf_dir = event_table(spark, tmp_path, [1.17] + [0.0] * 15)
    got = track_queries.QUERIES["summarize_tracks"](spark, sf_dir).select("first_px", "median_px").first()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT first_px, median_px FROM ({track_queries.SQL['summarize_tracks']})").fetchall()
    assert want == [(0.007313, 0.007313)] and tuple(got) == want[0]


def test_rounding_follows_sql(spark):
    values = [1.245e-4, 0.0073125 - 1e-18, -0.0253125 + 4e-18, 0.49999999999999994e-6, 2.5e-6, -1e17, 1e300, 1e305, float("inf"), float("nan"), -0.0, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", sql_round(F.col("v"), 6)).orderBy("i").collect()
    assert [repr(r[1]) for r in got] == [repr(duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0]) for v in values]


@pytest.mark.parametrize("values,total", [([1e300, 1e300], 2e300), ([1e-30, 2e-30], 1e-30 + 2e-30), ([None, None], None), ([0.1, 0.2, None], 0.3), ([float("nan"), 1.0], float("nan"))])
def test_exact_sum(spark, values, total):
    """Values that no decimal tells are summed as they are."""
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum("v")).first()[0]
    assert got == total or (got != got and total != total)


@pytest.mark.parametrize("name", ["kalman_lifecycle_clusters", "kalman_lifecycle_points"])
def test_tracker_keeps_captures_whole(spark, name):
    """Frames from a union whose sides are partitioned alike and coalesced apart."""
    uneven = {
        "autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.parallelismFirst": "false",
        "adaptive.advisoryPartitionSizeInBytes": "6000", "adaptive.coalescePartitions.minPartitionSize": "100",
    }
    try:
        for k, v in uneven.items():
            spark.conf.set(f"spark.sql.{k}", v)
        compare(spark, track_queries.QUERIES[name], track_queries.SQL[name])
    finally:
        for k in uneven:
            spark.conf.unset(f"spark.sql.{k}")


def test_tracker_streams_through_batches(spark):
    """A capture longer than an Arrow batch gives the same tracks as all its frames in one step."""
    rng = np.random.default_rng(7)
    rows = [(c, f, k, 0.1 * f + 3 * k + rng.normal(0, 0.02), float(c), 0.0, 0.0, 0.0, 0.0, 0.0, 5) for c in range(3) for f in range(40) for k in range(4)]
    names = ["capture_id", "frame_id", "cluster_id", "cx", "cy", "cz", "ex", "ey", "ez", "mean_velocity", "point_count"]
    spec = T.TrackerSpec(T.Dynamics(0.1), Gating(0.6), lifecycle=Lifecycle(2, 2, 3))
    import pandas as pd

    whole = pd.DataFrame(rows, columns=names)
    want = {(c, r["frame_id"], r["track_id"]): (r["px"], r["vx"], r["status"]) for c, part in whole.groupby("capture_id") for r in T.run_clusters(T.TrackSet(spec), part)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = T.track_clusters(spark.createDataFrame(whole), spec).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.capture_id, r.frame_id, r.track_id): (r.px, r.vx, r.status) for r in got} == want


def test_evaluation_keeps_captures_apart(spark):
    truth = spark.createDataFrame([(c, f, 0, 0.0, 0.0, 0.0) for c in "ab" for f in range(3)], "capture_id string, frame_id bigint, truth_id bigint, x double, y double, z double")
    tracks = truth.select("capture_id", "frame_id", F.when(F.col("capture_id") == "a", 5).otherwise(6).cast("bigint").alias("track_id"), F.lit(0.1).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.lit("confirmed").alias("status"))
    row = M.evaluate_tracks(tracks, truth, 0.5, by=("capture_id",)).first()
    assert (row.id_switches, row.matched_observations, row.recall) == (0, 6, 1.0)


def test_identity_switches(spark):
    truth = [(f, t, float(t), 0.0, 0.0) for f in range(2) for t in range(2)]
    pred = [(f, (t + f) % 2, float(t), 0.0, 0.0, "confirmed") for f in range(2) for t in range(2)]
    t = spark.createDataFrame(truth, "frame_id bigint, truth_id bigint, x double, y double, z double")
    p = spark.createDataFrame(pred, "frame_id bigint, track_id bigint, px double, py double, pz double, status string")
    found = M.identity_switches(M.match_frames(p, t, 0.5)).collect()
    assert {(r.frame_id, r.truth_id, r.new_track_id) for r in found} == {(1, 0, 1), (1, 1, 0)}
    r = M.evaluate_tracks(p, t, 0.5).first()
    assert (r.matched_observations, r.id_switches, r.recall, r.position_rmse_m) == (4, 2, 1.0, 0.0)


# --- packets, intervals, waves


def test_reorder(spark):
    rows = [("c", i, n, [v]) for i, (n, v) in enumerate([(7, 70), (5, 50), (7, 71), (9, 90)])]
    df = spark.createDataFrame(rows, "capture_id string, arrival bigint, packet_number bigint, payload array<smallint>")
    assert P.reorder_packets(df, 5, 3, fill=-1).first().samples == [50, -1, 70]
    r = P.packet_loss(df, 5, 3).first()
    assert (r.missing, r.duplicate, r.out_of_frame, r.received) == ([6], [7], [9], 2)


def test_assembly_refuses_gaps(spark):
    rows = [("c", i, 10 + i, 4 * i, [i, i]) for i in (0, 2)]
    df = spark.createDataFrame(rows, "capture_id string, arrival bigint, packet_number bigint, byte_count bigint, payload array<smallint>")
    with pytest.raises(Exception, match="contiguous"):
        P.assemble_frames(df, 0, 2, 2).collect()
    with pytest.raises(Exception, match="ended"):
        P.take_frame(df, 3).collect()


def intervals(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id bigint, start_ns bigint, end_ns bigint")


def test_causal_pairs(spark):
    e, l = intervals(spark, (0, 10), (20, 30), (40, 50)), intervals(spark, (25, 25))
    for bucket in (1, 7, 1000):
        assert I.causal_pairs(e, l, -20, 20, bucket).count() == 3
        assert I.causal_pairs(e, l, 100, 120, bucket).count() == 0


def test_causal_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    make = lambda: [(int(a), int(a + d)) for a, d in zip(rng.integers(-200, 200, 40), rng.integers(0, 60, 40))]
    a, b = make(), make()
    for lo, hi in ((-5, 5), (10, 50), (30, 30), (-60, -40)):
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if y[0] - x[1] <= hi and y[1] - x[0] >= lo}
        got = [(r.earlier_id, r.later_id) for r in I.causal_pairs(intervals(spark, *a), intervals(spark, *b), lo, hi, 13).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_monotone(spark):
    assert I.assert_monotone(intervals(spark, (0, 1), (0, 2)), [], "id").count() == 2
    with pytest.raises(Exception, match="backwards"):
        I.assert_monotone(intervals(spark, (0, 5), (1, 2)), [], "id").collect()
    rows = [(k, i, 10 * i, 10 * i + 5) for k in ("a", "b") for i in range(50)]
    for stretch in (1, 7, 100):
        made = spark.createDataFrame(rows, "source_id string, id bigint, start_ns bigint, end_ns bigint")
        assert I.assert_monotone(made, ["source_id"], "id", stretch).count() == 100
        late = made.withColumn("start_ns", F.when((F.col("id") == 21) & (F.col("source_id") == "b"), 199).otherwise(F.col("start_ns")))
        with pytest.raises(Exception, match="backwards"):
            I.assert_monotone(late, ["source_id"], "id", stretch).collect()


def test_floor_division(spark):
    df = spark.createDataFrame([(-7,), (7,), (-6,)], "a bigint").select(F.col("a").cast(I.WIDE).alias("a"))
    two = F.lit(2).cast(I.WIDE)
    assert [(int(r[0]), int(r[1])) for r in df.select(I.floor_div(F.col("a"), two), I.ceil_div(F.col("a"), two)).collect()] == [(-4, -3), (3, 4), (-3, -3)]


def test_segments(spark):
    seg = [("s", 0, 10, 0, 0, 1, 1, 0), ("s", 5, 20, 5, 5, 1, 1, 0), ("t", 3, 3, 3, 0, 1, 1, 0), ("u", 0, 5, 9, 0, 1, 1, 0)]
    names = "source_id string, start_tick bigint, end_tick bigint, source_origin_tick bigint, host_origin_ns bigint, scale_num bigint, scale_den bigint, uncertainty_ns bigint"
    df = spark.createDataFrame(seg, names)
    assert [r.problem for r in I.validate_segments(df).orderBy("source_id", "start_tick").collect()] == [None, "overlap", "empty", "origin outside"]
    items = spark.createDataFrame([("s", 0, 7)], "source_id string, item_index bigint, tick bigint")
    with pytest.raises(Exception, match="segment"):
        I.segment_of(items, df).collect()


def test_unwrap_and_displacement(spark):
    df = spark.createDataFrame([(0, 0, 2.8), (0, 1, -2.9)], "s int, i int, p double")
    assert [round(r.value, 9) for r in V.unwrap_phase(df, ["s"], "i", "p").orderBy("i").collect()] == [2.8, round(2 * math.pi - 2.9, 9)]
    wave = spark.createDataFrame([(-math.pi,)], "value double")
    assert abs(V.phase_to_displacement(wave, 0.004).first().value + 0.001) < 1e-12


def test_sparsify_suppression_and_fallback(spark):
    rows = [(0, 0, d, 0, 0, x, float(m)) for d, x, m in ((0, 0, 5), (0, 1, 5), (1, 0, 9), (1, 1, 1))]
    df = spark.createDataFrame(rows, "capture_id int, frame int, d int, z int, y int, x int, magnitude double")
    v = F.col("d").cast("double")
    points, stats = sparsify_volume(df, (2, 1, 1, 2), v, Sparsification(min_snr_db=-100.0))
    assert {(r.d, r.x) for r in points.collect()} == {(0, 0), (1, 0)}  # of equal voxels the first
    points, stats = sparsify_volume(df, (2, 1, 1, 2), v, Sparsification(min_snr_db=90.0), suppressed=1)
    assert [(r.d, r.x, r.fallback) for r in points.collect()] == [(0, 0, True)]
    s = stats.first()
    assert (s.positive_volume_voxels, s.limited_peak_voxels, s.fallback_used) == (2, 0, True)


@pytest.mark.parametrize("spec,suppressed", [
    (Sparsification(min_snr_db=0.5, max_points=7), None),
    (Sparsification(1.0, 5, 2, 2, 1, 1, 1.1, 0.4, 0.3), 1),
    (Sparsification(-100.0, 9, 0, 0, 2, 0, 1.0, 0.5, 0.6), 0),
    (Sparsification(90.0, 3, 1, 1), 2),
    (Sparsification(90.0, 3, 1, 1, strongest_point_fallback=False), None),
])
def test_dense_sparsification_equals_long(spark, spec, suppressed):
    from echofield.operators.cartesian import sparsify_dense

    shape, rng = (4, 3, 4, 5), np.random.default_rng(8)
    volumes = [np.round(rng.random(240) * 6) * (rng.random(240) < 0.8) for _ in range(6)] + [np.zeros(240)]  # many ties and zeros
    arrays = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(volumes)], "capture_id bigint, frame int, v array<double>")
    i = F.col("i")
    long = arrays.select("capture_id", "frame", F.posexplode("v").alias("i", "magnitude")).select(
        "capture_id", "frame", F.floor(i / 60).cast("int").alias("d"), (F.floor(i / 20) % 3).cast("int").alias("z"), (F.floor(i / 5) % 4).cast("int").alias("y"), (i % 5).cast("int").alias("x"), "magnitude"
    )
    speeds = [(d - 1.5) * 0.5 for d in range(4)]
    tidy = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))) for r in df.collect())
    for a, b in zip(sparsify_volume(long, shape, (F.col("d") - 1.5) * 0.5, spec, suppressed), sparsify_dense(arrays, shape, speeds, spec, suppressed)):
        assert sorted(a.columns) == sorted(b.columns) and tidy(a) == tidy(b)


# --- contracts


@pytest.mark.parametrize("make", [
    lambda: AdcFrame(0, 1, 1),
    lambda: AdcFrame(1, 1, 3, "group2_i_then_q"),
    lambda: AdcFrame(1, 1, 2, "other"),
    lambda: Cfar1D(0, 0, 1.0),
    lambda: Cfar1D(1, 0, float("nan")),
    lambda: RangeDopplerRecipe(AdcFrame(3, 4, 2), virtual=presets.virtual_array(tx_order=(0, 1))),
    lambda: RangeDopplerRecipe(AdcFrame(1, 1, 2), Fft(fftshift=True)),
    lambda: DetectionRecipe(RangeDopplerRecipe(AdcFrame(1, 1, 2))),
    lambda: Projection(1, 1, True),
    lambda: RadarCapture(RadarProfile(), RadarProfile().adc_frame(), (0, 0, 1)),
    lambda: RadarCapture(RadarProfile(), RadarProfile().adc_frame(), (0, 1, 2), 1e-6),
    lambda: RadarCapture.from_record(RadarCapture(RadarProfile(), RadarProfile().adc_frame(), (0, 1, 2)).to_record() | {"more": 1}),
    lambda: Sparsification(max_points=0),
    lambda: Dbscan(0.0, 1),
])
def test_contradictions(make):
    with pytest.raises(ContractError):
        make()


def test_capture_round_trip():
    c = RadarCapture(RadarProfile(), RadarProfile().adc_frame(), (0, 2, 1), 0.1, 5)
    assert RadarCapture.from_record(c.to_record()) == c


def test_presets():
    assert presets.planar_aperture().shape == (2, 8) and len(presets.azimuth_row().indices) == 8 and len(presets.elevation_row().indices) == 4
    assert A.spacing_of(list(presets.azimuth_row().positions), 0) == 0.5
    tracker, clustering, distance = presets.people_counting()
    assert tracker.max_tracks == 20 and clustering.min_samples == 6 and distance == 1.0
    with pytest.raises(ValueError):
        presets.range_doppler(tx_order=(0, 2))
    with pytest.raises(ValueError):
        presets.range_doppler(RadarProfile(num_rx=2))
    p = RadarProfile()
    assert abs(p.range_resolution_m - p.speed_of_light_mps / 2 / (p.frequency_slope_hz_per_s * 256 / 4.4e6)) < 1e-12


PRESETS = {
    "range_doppler": lambda p: presets.range_doppler(p),
    "detection": lambda p: presets.detection(1.0, p),
    "point_cloud": lambda p: presets.point_cloud(1.0, p),
    "point_cloud_3d": lambda p: presets.point_cloud(1.0, p, elevation=True),
    "cfar_point_cloud": lambda p: presets.cfar_point_cloud(RangeDopplerCfar(Cfar1D(4, 1, 2.0)), profile=p),
    "cfar_point_cloud_3d": lambda p: presets.cfar_point_cloud(RangeDopplerCfar(Cfar1D(4, 1, 2.0)), profile=p, elevation=True),
}


@pytest.mark.parametrize("name", PRESETS)
@pytest.mark.parametrize("samples,chirps", [(16, 8), (256, 64)])
def test_recipe_shapes(spark, name, samples, chirps):
    """All six recipes: one-sided ranges, shifted Doppler over all chirps, and the angles they ask for."""
    p = RadarProfile(num_adc_samples=samples, num_chirps_per_tx=chirps)
    recipe = PRESETS[name](p)
    found = getattr(recipe, "detection", recipe)
    transform = getattr(found, "transform", found)
    raw = spark.createDataFrame([], "capture_id int, samples array<smallint>")
    for cube in (runners.adc_to_range_doppler(raw, transform), DN.dense_range_doppler(raw, transform)):
        assert dict(cube.shape) == {"doppler_bin": chirps, "virtual_rx": 12, "range_bin": samples // 2 + 1}
    assert transform.range_fft == Fft(samples, "hann", one_sided=True) and transform.doppler_fft == Fft(chirps, "hann", fftshift=True)
    if found is not recipe or name == "detection":
        assert (found.elevation is not None) == name.endswith("3d") and len(found.azimuth.indices) == 8 and found.angle == Fft(64, "hann", True)
        assert (found.method == "cfar") == name.startswith("cfar")
    if found is not recipe:
        assert recipe.projection.doppler_bins == chirps and recipe.projection.doppler_fftshifted and recipe.projection.center_doppler


def test_benchmark_trackers(spark):
    rows, truth = [], []
    for f in range(12):
        for t, y in enumerate((2.0, 4.0)):
            x = 0.1 * f if t == 0 else 1.0 - 0.1 * f
            truth.append(("c", f, t, x, y, 0.0))
            rows += [("c", f, 10 * t + k, x + 0.02 * (k % 2), y + 0.02 * (k // 2), 0.0, 0.5, 10.0) for k in range(4)]
    points = spark.createDataFrame(rows, "capture_id string, frame_id bigint, point_idx int, x double, y double, z double, velocity double, snr double")
    t = spark.createDataFrame(truth, "capture_id string, frame_id bigint, truth_id bigint, x double, y double, z double")
    spec = T.TrackerSpec(T.Dynamics(0.1), Gating(0.6), Allocation(2, 0.1, 20.0), Lifecycle(3, 2, 3))
    got = {(r.strategy, r.tracks): r for r in M.benchmark_trackers(points, t, spec, Dbscan(0.3, 2), 0.5).collect()}
    assert len(got) == 4
    for strategy in ("cluster", "measurement"):
        assert got[strategy, "all"].recall == 1.0 and got[strategy, "all"].id_switches == 0 and got[strategy, "all"].false_track_observations == 0
        assert got[strategy, "confirmed"].matched_observations == 20


def test_benchmark_frame_is_the_known_one():
    """The bench's full-size frame has a published digest (its first and last bytes)."""
    import hashlib

    words = ((25173 * np.arange(786_432, dtype=np.int64) + 13849) & 0xFFFF).astype("<u2").tobytes()
    digest = hashlib.sha256(words).hexdigest()
    assert len(words) == 1_572_864 and digest.startswith("007ac7c6") and digest.endswith("8f66")
