"""Recipes to plans: ADC frames to range-Doppler cubes, detections, points, clusters and tracks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import angle, cube as C, detection as D
from ..operators.adc import organize_adc_samples
from ..operators.clustering import cluster_points, summarize_clusters
from ..operators.cube import Cube
from ..operators.dense import DenseCube, dense_range_doppler
from ..operators.tracking import TrackerSpec, track_clusters, track_points
from .contracts import Cfar2D, Dbscan, DetectionRecipe, Fft, PointCloudRecipe, RadarCapture, RangeDopplerRecipe, require

#: Frames of more words than this run in the dense form.
DENSE_WORDS = 2048


def adc_to_range_doppler(raw: DataFrame, recipe: RangeDopplerRecipe) -> Cube:
    """Long-form cube from rows of (capture_id, samples)."""
    cube = C.range_fft(organize_adc_samples(raw, recipe.adc, recipe.drop_incomplete), recipe.range_fft)
    num_tx = len(recipe.virtual.tx_order) if recipe.virtual else 1
    if recipe.virtual is not None:
        cube = C.map_tdm_virtual_array(cube, num_tx)
    if recipe.remove_clutter:
        cube = C.remove_static_clutter(cube, "loop" if recipe.virtual else "chirp")
    cube = C.doppler_fft(cube, recipe.doppler_fft)
    if recipe.calibration is not None:
        cube = C.apply_virtual_channel_calibration(cube, [complex(a, b) for a, b in recipe.calibration])
    if num_tx > 1:
        cube = C.compensate_tdm_doppler_phase(cube, num_tx, recipe.adc.rx, recipe.doppler_fft.fftshift)
    return cube


def range_doppler_to_detections(cube: Cube | DenseCube, recipe: DetectionRecipe) -> DataFrame:
    """Detect, group, filter; with CFAR the angles are then estimated for detections alone."""
    if recipe.method == "threshold" and recipe.angle is not None:
        full = cube.long() if isinstance(cube, DenseCube) else cube
        if recipe.azimuth is not None:
            full = C.select_virtual_subarray(full, recipe.azimuth)
        found = D.threshold_azimuth(C.angle_fft(full, recipe.angle), recipe.peak)
        if recipe.azimuth is None:
            return found
        n = recipe.angle.n_fft or len(recipe.azimuth.indices)
        spacing = angle.spacing_of(list(recipe.azimuth.positions), 0)
        return found.withColumn("azimuth_rad", angle.angle_of_bin(F.col("azimuth_bin"), n, spacing, recipe.angle.fftshift))
    how = recipe.peak.aggregate_rx if recipe.peak else recipe.cfar.aggregate_rx
    plane = cube.magnitude(how) if isinstance(cube, DenseCube) else cube
    if recipe.method == "threshold":
        found = D.threshold_range_doppler(plane, recipe.peak)
    elif isinstance(recipe.cfar, Cfar2D):
        found = D.detect_cfar_2d(plane, recipe.cfar)
    else:
        found = D.detect_range_doppler_cfar(plane, recipe.cfar)
    if recipe.grouping is not None:
        around = cube.magnitude(recipe.grouping.aggregate_rx) if isinstance(cube, DenseCube) else cube
        found = D.group_detection_peaks(around, found, recipe.grouping)
    if recipe.min_snr is not None:
        found = D.filter_detection_quality(found, recipe.min_snr)
    if recipe.azimuth is None:
        return found
    spec = recipe.angle or Fft(fftshift=True)
    lines = cube.lines_at(found) if isinstance(cube, DenseCube) else cube
    found = angle.estimate_candidate_azimuths(lines, found, spec, recipe.azimuth)
    if recipe.elevation is not None:
        found = angle.estimate_candidate_elevations(lines, found, spec, recipe.azimuth, recipe.elevation)
    return found


def adc_to_detections(raw: DataFrame, recipe: DetectionRecipe) -> DataFrame:
    t = recipe.transform
    cube = dense_range_doppler(raw, t) if t.adc.words > DENSE_WORDS else adc_to_range_doppler(raw, t)
    return range_doppler_to_detections(cube, recipe)


def detections_to_point_cloud(detections: DataFrame, recipe: PointCloudRecipe) -> DataFrame:
    return angle.detections_to_points(detections, recipe.projection)


def adc_to_point_cloud(raw: DataFrame, recipe: PointCloudRecipe) -> DataFrame:
    return detections_to_point_cloud(adc_to_detections(raw, recipe.detection), recipe)


def check_capture(recipe: RangeDopplerRecipe, capture: RadarCapture, frame_period_s: float | None = None) -> None:
    """A recipe must describe the capture it is bound to."""
    require(recipe.adc == capture.adc, "recipe and capture have different frames")
    if len(capture.tx_order) > 1:
        require(recipe.virtual is not None, "several transmitters need a virtual array")
    if recipe.virtual is not None:
        require(tuple(recipe.virtual.tx_order) == tuple(capture.tx_order), "recipe and capture have different transmitter orders")
    if frame_period_s is not None:
        require(capture.frame_periodicity_s is not None and math.isclose(frame_period_s, capture.frame_periodicity_s, rel_tol=1e-9), "tracker and capture have different frame periods")


def _indexed(points: DataFrame) -> DataFrame:
    """Points numbered within their frame, in order of cells; the frame id is the frame's number."""
    w = Window.partitionBy("capture_id", "frame").orderBy("doppler_bin", "range_bin", "azimuth_rad")
    return points.withColumn("point_idx", F.row_number().over(w) - 1).withColumnRenamed("frame", "frame_id")


def adc_to_cluster_tracks(raw: DataFrame, recipe: PointCloudRecipe, clustering: Dbscan, tracker: TrackerSpec) -> DataFrame:
    """Tracks of clustered points; ``raw`` has (capture_id, samples), all frames of a capture in one row."""
    points = _indexed(adc_to_point_cloud(raw, recipe))
    labels = cluster_points(points, clustering, ("capture_id", "frame_id"))
    return track_clusters(summarize_clusters(points, labels, ("capture_id", "frame_id")), tracker)


def adc_to_measurement_tracks(raw: DataFrame, recipe: PointCloudRecipe, clustering: Dbscan, tracker: TrackerSpec) -> DataFrame:
    points = _indexed(adc_to_point_cloud(raw, recipe))
    require("snr" in points.columns, "measurement tracking needs SNR")
    return track_points(points, tracker, clustering)
