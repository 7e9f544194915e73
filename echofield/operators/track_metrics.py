"""Analytics over track tables: summaries, coverage, and evaluation against ground truth."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.contracts import Scenery, require
from .clustering import cluster_points, linear_sum_assignment, summarize_clusters
from .tracking import in_scenery_column, track_clusters, track_points


def assert_unique_ids(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The tracks, failing where an id occurs twice in a frame."""
    w = Window.partitionBy(*keys, "track_id")
    twice = F.count(F.lit(1)).over(w) > 1
    return tracks.withColumn("__twice", F.when(twice, F.raise_error(F.lit("a track id occurs twice in a frame")).cast("boolean")).otherwise(F.lit(False))).filter(~F.col("__twice")).drop("__twice")


def confirmed_intervals(tracks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., start_frame, end_frame): runs of consecutive frames in which a track is confirmed."""
    w = Window.partitionBy(*by).orderBy("frame_id")
    island = F.col("frame_id") - F.row_number().over(w)
    rows = tracks.filter(F.col("status") == "confirmed").withColumn("__island", island)
    return rows.groupBy(*by, "__island").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame")).drop("__island")


def summarize_tracks(tracks: DataFrame, scenery: Scenery | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per track: frames, positions, path, speeds, confirmed intervals, frames inside the scenery."""
    group = [*by, "track_id"]
    w = Window.partitionBy(*group).orderBy("frame_id")
    step = F.sqrt(F.pow(F.col("px") - F.lag("px").over(w), 2) + F.pow(F.col("py") - F.lag("py").over(w), 2))
    rows = assert_unique_ids(tracks, [*by, "frame_id"]).withColumns({
        "__step": F.coalesce(step, F.lit(0.0)),
        "__speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")),
    })
    first = {c: F.min_by(c, "frame_id") for c in ("px", "py", "pz")}
    last = {c: F.max_by(c, "frame_id") for c in ("px", "py", "pz")}
    inside = F.count_if(in_scenery_column(scenery, F.col("px"), F.col("py"))) if scenery else F.lit(None).cast("bigint")
    out = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("observed_frames"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed_frames"),
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"),
        *[first[c].alias(f"first_{c}") for c in first],
        *[last[c].alias(f"last_{c}") for c in last],
        *[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("px", "py", "pz")],
        F.sum("__step").alias("path_length_m"),
        F.percentile("__speed", F.lit(0.5)).alias("median_speed_mps"),
        F.max("__speed").alias("max_speed_mps"),
        inside.alias("in_scenery_frames"),
    )
    moved = F.sqrt(F.pow(F.col("last_px") - F.col("first_px"), 2) + F.pow(F.col("last_py") - F.col("first_py"), 2))
    out = out.withColumns({"displacement_m": moved, "outside_scenery_frames": F.col("observed_frames") - F.col("in_scenery_frames")})
    runs = confirmed_intervals(tracks, group).groupBy(*group).agg(F.array_sort(F.collect_list(F.array("start_frame", "end_frame"))).alias("confirmed_intervals"))
    return out.join(runs, group, "left").withColumn("confirmed_intervals", F.coalesce("confirmed_intervals", F.array().cast("array<array<bigint>>")))


def summarize_sequence(tracks: DataFrame, num_frames: int) -> DataFrame:
    """One row: frames with tracks and with confirmed tracks, concurrency, ids, and coverage."""
    per_frame = tracks.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("status") == "confirmed").cast("int")).alias("c"))
    frames = per_frame.agg(
        F.count(F.lit(1)).alias("frames_with_tracks"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("frames_with_confirmed_tracks"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_concurrent_tracks"),
    )
    ids = tracks.groupBy("track_id").agg(F.max((F.col("status") == "confirmed").cast("int")).alias("c")).agg(
        F.count(F.lit(1)).alias("observed_track_ids"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("confirmed_track_ids")
    )
    coverage = F.col("frames_with_confirmed_tracks") / float(num_frames) if num_frames else F.lit(0.0)
    # two tables of one row each
    return frames.join(F.broadcast(ids)).withColumns({"num_frames": F.lit(num_frames), "confirmed_frame_coverage": coverage})


def match_frames(predictions: DataFrame, truth: DataFrame, match_distance_m: float, confirmed_only: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., frame_id, truth_id, track_id, distance) of the least-cost matches of each frame within the distance."""
    require(match_distance_m > 0, "match distance must be positive")
    keys = [*by, "frame_id"]
    chosen = predictions.filter(F.col("status") == "confirmed") if confirmed_only else predictions
    both = truth.select(*keys, F.lit(0).alias("kind"), F.col("truth_id").alias("id"), "x", "y", "z").unionByName(
        chosen.select(*keys, F.lit(1).alias("kind"), F.col("track_id").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    )

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        t, p = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        rows = []
        if len(t) and len(p):
            gap = t[["x", "y", "z"]].to_numpy(float)[:, None, :] - p[["x", "y", "z"]].to_numpy(float)[None, :, :]
            distance = np.sqrt((gap * gap).sum(axis=2))
            rows = [(t["id"].iloc[i], p["id"].iloc[j], distance[i, j]) for i, j in zip(*linear_sum_assignment(distance)) if distance[i, j] <= match_distance_m]
        out = pd.DataFrame(rows, columns=["truth_id", "track_id", "distance"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.groupBy(*keys).applyInPandas(match, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "truth_id bigint, track_id bigint, distance double"]))


def identity_switches(matches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., frame_id, truth_id, previous_track_id, new_track_id): a truth's track differs from its last matched one."""
    w = Window.partitionBy(*by, "truth_id").orderBy("frame_id")
    rows = matches.withColumn("previous_track_id", F.lag("track_id").over(w))
    return rows.filter(F.col("previous_track_id") != F.col("track_id")).select(*by, "frame_id", "truth_id", "previous_track_id", F.col("track_id").alias("new_track_id"))


def evaluate_tracks(predictions: DataFrame, truth: DataFrame, match_distance_m: float, confirmed_only: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: observations, matches, misses, false tracks, identity switches, position error, recall.

    ``by`` names the captures, whose frames and ids have nothing to do with each other. Frames are matched once.
    """
    chosen = predictions.filter(F.col("status") == "confirmed") if confirmed_only else predictions
    matches = match_frames(predictions, truth, match_distance_m, confirmed_only, by)
    before = F.lag("track_id").over(Window.partitionBy(*by, "truth_id").orderBy("frame_id"))
    found = matches.withColumn("before", before).agg(
        F.count(F.lit(1)).alias("matched"),
        F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("position_rmse_m"),
        F.count_if(F.col("before") != F.col("track_id")).alias("id_switches"),
    )
    # three tables of one row each
    counts = truth.agg(F.count(F.lit(1)).alias("truths")).join(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("tracked")))).join(F.broadcast(found))
    return counts.select(
        F.col("truths").alias("ground_truth_observations"),
        F.col("matched").alias("matched_observations"),
        (F.col("truths") - F.col("matched")).alias("missed_observations"),
        (F.col("tracked") - F.col("matched")).alias("false_track_observations"),
        "id_switches",
        "position_rmse_m",
        F.when(F.col("truths") > 0, F.col("matched") / F.col("truths")).otherwise(0.0).alias("recall"),
    )


def polar_to_cartesian(points: DataFrame) -> DataFrame:
    """x = r sin(theta), y = r cos(theta)."""
    return points.withColumns({"x": F.col("range_m") * F.sin("azimuth_rad"), "y": F.col("range_m") * F.cos("azimuth_rad")})


def benchmark_trackers(points: DataFrame, truth: DataFrame, spec, clustering, match_distance_m: float) -> DataFrame:
    """Both trackers against the truth, with all and with confirmed tracks: (strategy, tracks, measures...).

    ``points`` has (capture_id, frame_id, point_idx, x, y, z, velocity, snr), ``truth`` the same keys.
    """
    keys = ("capture_id", "frame_id")
    seen = points.filter(F.col("point_idx").isNotNull())
    clusters = summarize_clusters(seen, cluster_points(seen, clustering, keys), keys)
    # frames without a cluster still age the tracks
    every = points.select(*keys).distinct().join(clusters, list(keys), "left")
    plain = replace(spec, allocation=replace(spec.allocation, min_total_snr=None))
    made = {"cluster": track_clusters(every, plain), "measurement": track_points(points, spec, clustering)}
    out = None
    for strategy, tracks in made.items():
        for confirmed in (False, True):
            row = evaluate_tracks(tracks, truth, match_distance_m, confirmed, ("capture_id",)).select(
                F.lit(strategy).alias("strategy"), F.lit("confirmed" if confirmed else "all").alias("tracks"), "*"
            )
            out = row if out is None else out.unionByName(row)
    return out
