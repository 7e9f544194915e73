"""Trackers and causal joins on unbounded streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import causal_match
from ..operators.tracking import TRACK_FIELDS, TrackerSpec, TrackSet, run_clusters, run_points
from ..plans.contracts import Dbscan

#: Parts of a bucket of the stream join.
FINER = 4
COLUMNS = ["frame_id", *[f.split()[0] for f in TRACK_FIELDS.split(", ")]]


def _stateful(rows: DataFrame, spec: TrackerSpec, run, capture: str) -> DataFrame:
    """The same step as in batch; a capture's tracks are kept between micro-batches.

    Frames of a capture must arrive in order; the frames of one micro-batch are sorted, and one that is not after
    the last frame of the state is an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        text, last = state.get if state.exists else (None, None)
        tracks = TrackSet(spec) if text is None else TrackSet.load(spec, text)
        rows = pd.concat(batches)
        first = int(rows["frame_id"].min())
        if last is not None and first <= last:
            raise ValueError(f"frame {first} of {key[0]} came after frame {last}")
        out = pd.DataFrame(run(tracks, rows), columns=COLUMNS)
        out.insert(0, capture, key[0])
        state.update((tracks.dump(), int(rows["frame_id"].max())))
        yield out

    return rows.groupBy(capture).applyInPandasWithState(
        step, f"{capture} {kinds[capture]}, frame_id {kinds['frame_id']}, {TRACK_FIELDS}", "tracks string, last_frame bigint", "append", GroupStateTimeout.NoTimeout
    )


def track_clusters_stream(clusters: DataFrame, spec: TrackerSpec, capture: str = "capture_id") -> DataFrame:
    return _stateful(clusters, spec, run_clusters, capture)


def track_points_stream(points: DataFrame, spec: TrackerSpec, clustering: Dbscan, capture: str = "capture_id") -> DataFrame:
    return _stateful(points, spec, lambda tracks, pdf: run_points(tracks, clustering, pdf), capture)


def causal_pairs_stream(earlier: DataFrame, later: DataFrame, lag_min: int, lag_max: int, bucket_ns: int, delay: str) -> DataFrame:
    """Causal pairs of two streams of (id, ts, start_ns, end_ns), ``ts`` being the event time of ``start_ns``.

    Both sides are laid into time buckets as in the batch join; watermarks on ``ts`` let the state of old buckets
    go. Intervals must be shorter than a bucket. A bucket is divided: a candidate is looked up in the state one by
    one, which costs more than a row's copies, and finer buckets bring fewer candidates that are no pair.
    """
    fine_ns = max(bucket_ns // FINER, 1)
    bucket = lambda t: F.floor(t / F.lit(fine_ns)).cast("bigint")
    lo, hi = F.col("start_ns") + lag_min, F.col("end_ns") + lag_max
    e = earlier.withWatermark("ts", delay).select(
        F.col("id").alias("earlier_id"), F.col("ts").alias("e_ts"), F.col("start_ns").alias("e_start"), F.col("end_ns").alias("e_end"),
        bucket(F.least(lo, hi)).alias("e_first"), F.explode(F.sequence(bucket(F.least(lo, hi)), bucket(F.greatest(lo, hi)))).alias("e_bucket"),
    )
    l = later.withWatermark("ts", delay).select(  # noqa: E741
        F.col("id").alias("later_id"), F.col("ts").alias("l_ts"), F.col("start_ns").alias("l_start"), F.col("end_ns").alias("l_end"),
        bucket(F.col("start_ns")).alias("l_first"), F.explode(F.sequence(bucket(F.col("start_ns")), bucket(F.col("end_ns")))).alias("l_bucket"),
    )
    span = f"interval {(max(abs(lag_min), abs(lag_max)) + 2 * bucket_ns) // 1_000 + 1} microseconds"
    near = (F.col("l_ts") >= F.col("e_ts") - F.expr(span)) & (F.col("l_ts") <= F.col("e_ts") + F.expr(span))
    met = causal_match(F.col("e_start"), F.col("e_end"), F.col("l_start"), F.col("l_end"), lag_min, lag_max)
    once = F.col("e_bucket") == F.greatest("e_first", "l_first")
    return e.join(l, (F.col("e_bucket") == F.col("l_bucket")) & near & met & once).select("earlier_id", "later_id")
