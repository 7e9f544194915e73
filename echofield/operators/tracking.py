"""Constant-velocity trackers over clusters or single measurements.

One ``step`` serves batch and streaming: ``track_clusters`` and ``track_points`` run it per capture in frame order,
``echofield.streaming.trackers`` keeps its state between micro-batches. Tracks are held as parallel NumPy arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.contracts import Allocation, Dbscan, Gating, Lifecycle, Scenery, require
from .clustering import dbscan_labels, linear_sum_assignment
from .cube import in_order

TENTATIVE, CONFIRMED, COASTING = 0, 1, 2
STATUS = ("tentative", "confirmed", "coasting")
#: Cost of a pair that the gates reject; such pairs are dropped again after the assignment.
REJECTED = 1e12


@dataclass(frozen=True)
class Dynamics:
    frame_period_s: float
    max_acceleration_mps2: tuple[float, float] = (2.0, 2.0)
    measurement_noise_m: float = 0.2
    initial_velocity_std_mps: float = 2.0
    extent_smoothing: float = 0.2

    def __post_init__(self):
        require(self.frame_period_s > 0 and self.measurement_noise_m > 0 and self.initial_velocity_std_mps > 0, "dynamics must be positive")
        require(0 <= self.extent_smoothing <= 1, "smoothing lies between 0 and 1")


@dataclass(frozen=True)
class TrackerSpec:
    dynamics: Dynamics
    gating: Gating
    allocation: Allocation = field(default_factory=Allocation)
    lifecycle: Lifecycle = field(default_factory=Lifecycle)
    scenery: Scenery = field(default_factory=Scenery)
    max_tracks: int = 200


def in_scenery(spec: Scenery, x: float, y: float) -> bool:
    """No box at all means everywhere."""
    return not spec.boxes or any(b.holds(x, y) for b in spec.boxes)


def in_scenery_column(spec: Scenery, x: Column, y: Column) -> Column:
    out = F.lit(not spec.boxes)
    for b in spec.boxes:
        out = out | (x.between(b.x_min_m, b.x_max_m) & y.between(b.y_min_m, b.y_max_m))
    return out


def radial_velocity(state: np.ndarray) -> np.ndarray:
    """Velocity along the line of sight, 0 at the origin."""
    d = np.hypot(state[..., 0], state[..., 1])
    along = state[..., 0] * state[..., 2] + state[..., 1] * state[..., 3]
    return np.divide(along, d, out=np.zeros_like(along), where=d > 0)


class TrackSet:
    """All tracks of a capture: arrays with one entry per track, in order of allocation."""

    INTS = ("track_id", "status", "hits", "age", "missed", "outside")

    def __init__(self, spec: TrackerSpec):
        self.spec, self.next_id = spec, 0
        self.state, self.cov = np.zeros((0, 4)), np.zeros((0, 4, 4))
        self.extent, self.z = np.zeros((0, 2, 2)), np.zeros(0)
        for name in self.INTS:
            setattr(self, name, np.zeros(0, np.int64))
        dt = spec.dynamics.frame_period_s
        self.move = np.eye(4) + dt * np.eye(4, k=2)
        push = np.vstack([np.eye(2) * dt * dt / 2, np.eye(2) * dt])
        self.process = push @ np.diag(np.square(spec.dynamics.max_acceleration_mps2)) @ push.T
        self.noise = np.eye(2) * spec.dynamics.measurement_noise_m**2

    def __len__(self) -> int:
        return len(self.track_id)

    # state in and out of storage

    def dump(self) -> str:
        out = {name: getattr(self, name).tolist() for name in (*self.INTS, "state", "cov", "extent", "z")}
        return json.dumps(out | {"next_id": self.next_id})

    @classmethod
    def load(cls, spec: TrackerSpec, text: str) -> TrackSet:
        out, data = cls(spec), json.loads(text)
        n = len(data["track_id"])
        for name in cls.INTS:
            setattr(out, name, np.array(data[name], np.int64))
        out.state, out.cov = np.array(data["state"]).reshape(n, 4), np.array(data["cov"]).reshape(n, 4, 4)
        out.extent, out.z, out.next_id = np.array(data["extent"]).reshape(n, 2, 2), np.array(data["z"]).reshape(n), data["next_id"]
        return out

    # filter

    def predict(self) -> None:
        self.state = self.state @ self.move.T
        self.cov = self.move @ self.cov @ self.move.T + self.process

    def update(self, i: int, centre: np.ndarray, extent: np.ndarray, count: int) -> None:
        """Joseph-form update; with a Mahalanobis gate the centroid's own covariance adds to the noise."""
        noise = self.noise + (extent / count if self.spec.gating.max_mahalanobis_distance is not None else 0)
        p = self.cov[i]
        gain = p[:, :2] @ np.linalg.inv(p[:2, :2] + noise)
        self.state[i] += gain @ (centre[:2] - self.state[i, :2])
        rest = np.eye(4)
        rest[:, :2] -= gain
        self.cov[i] = rest @ p @ rest.T + gain @ noise @ gain.T
        a = self.spec.dynamics.extent_smoothing
        self.extent[i] = (1 - a) * self.extent[i] + a * extent
        self.z[i] = centre[2]
        self.hits[i] += 1
        self.age[i] += 1
        self.missed[i] = 0
        if self.hits[i] >= self.spec.lifecycle.confirmation_hits:
            self.status[i] = CONFIRMED
        self._look_outside(i)

    def _look_outside(self, i: int) -> None:
        inside = in_scenery(self.spec.scenery, self.state[i, 0], self.state[i, 1])
        self.outside[i] = 0 if inside else self.outside[i] + 1

    def gates(self, xy: np.ndarray, velocity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, accepted) of all tracks against all observations."""
        gap = xy[None, :, :] - self.state[:, None, :2]
        distance = np.hypot(gap[..., 0], gap[..., 1])
        g = self.spec.gating
        ok = distance <= g.max_distance_m
        ok &= np.array([in_scenery(self.spec.scenery, x, y) for x, y in xy], bool)[None, :]
        if g.max_mahalanobis_distance is not None:
            inverse = np.linalg.inv(self.cov[:, :2, :2] + self.noise + self.extent)
            squared = np.einsum("tni,tij,tnj->tn", gap, inverse, gap)
            ok &= np.sqrt(np.maximum(squared, 0)) <= g.max_mahalanobis_distance
        if g.max_radial_velocity_difference_mps is not None:
            ok &= np.abs(radial_velocity(self.state)[:, None] - velocity[None, :]) <= g.max_radial_velocity_difference_mps
        return distance, ok

    # lifecycle

    def miss(self, matched: set[int]) -> None:
        for i in range(len(self)):
            if i not in matched:
                self.age[i] += 1
                self.missed[i] += 1
                if self.status[i] == CONFIRMED:
                    self.status[i] = COASTING
                self._look_outside(i)

    def expire(self) -> set[int]:
        life = self.spec.lifecycle
        gone = (self.status == TENTATIVE) & (self.missed >= life.tentative_max_misses)
        gone |= (self.status == COASTING) & (self.missed >= life.confirmed_max_misses)
        gone |= self.outside >= self.spec.scenery.outside_max_frames
        ids = set(self.track_id[gone].tolist())
        for name in (*self.INTS, "state", "cov", "extent", "z"):
            setattr(self, name, getattr(self, name)[~gone])
        return ids

    def full(self, made: int) -> bool:
        limit = self.spec.allocation.max_new_tracks_per_frame
        return len(self) >= self.spec.max_tracks or (limit is not None and made >= limit)

    def admits(self, centre: np.ndarray, count: int, velocity: float, snr: float | None) -> bool:
        a = self.spec.allocation
        return (
            in_scenery(self.spec.scenery, centre[0], centre[1])
            and count >= a.min_points
            and abs(velocity) >= a.min_abs_radial_velocity_mps
            and (a.min_total_snr is None or snr >= a.min_total_snr)
        )

    def allocate(self, centre: np.ndarray, extent: np.ndarray) -> int:
        start = np.diag([*np.diag(self.noise), *[self.spec.dynamics.initial_velocity_std_mps**2] * 2])
        self.state = np.vstack([self.state, [centre[0], centre[1], 0, 0]])
        self.cov = np.concatenate([self.cov, start[None]])
        self.extent, self.z = np.concatenate([self.extent, extent[None]]), np.append(self.z, centre[2])
        first = CONFIRMED if self.spec.lifecycle.confirmation_hits == 1 else TENTATIVE
        for name, value in zip(self.INTS, (self.next_id, first, 1, 1, 0, 0)):
            setattr(self, name, np.append(getattr(self, name), value))
        self.next_id += 1
        return self.next_id - 1

    def report(self) -> list[dict]:
        return [
            {
                "track_id": int(self.track_id[i]), "px": self.state[i, 0], "py": self.state[i, 1], "pz": self.z[i],
                "vx": self.state[i, 2], "vy": self.state[i, 3], "vz": 0.0,
                "pos_cov": self.cov[i, :2, :2].tolist(), "ext_cov": self.extent[i].tolist(),
                "status": STATUS[self.status[i]], "age": int(self.age[i]), "missed": int(self.missed[i]),
            }
            for i in range(len(self))
        ]


def step_clusters(tracks: TrackSet, centres: np.ndarray, extents: np.ndarray, velocity: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One frame of clusters; the track id of each cluster, -1 where it has none."""
    require(tracks.spec.allocation.min_total_snr is None, "clusters have no SNR to allocate by")
    n = len(centres)
    shape = np.zeros((n, 2, 2))
    shape[:, 0, 0], shape[:, 1, 1] = extents[:, 0] ** 2 / 12, extents[:, 1] ** 2 / 12
    tracks.predict()
    out, matched = np.full(n, -1, np.int64), {}
    if len(tracks) and n:
        distance, ok = tracks.gates(centres[:, :2], velocity)
        if ok.any():
            for t, c in zip(*linear_sum_assignment(np.where(ok, distance, REJECTED))):
                if ok[t, c]:
                    matched[int(t)] = int(c)
    for t, c in matched.items():
        tracks.update(t, centres[c], shape[c], int(counts[c]))
        out[c] = tracks.track_id[t]
    tracks.miss(set(matched))
    gone = tracks.expire()
    out[np.isin(out, list(gone))] = -1
    made, taken = 0, set(matched.values())
    for c in np.argsort(-counts, kind="stable"):
        if tracks.full(made):
            break
        if int(c) not in taken and tracks.admits(centres[c], int(counts[c]), float(velocity[c]), None):
            out[c] = tracks.allocate(centres[c], shape[c])
            made += 1
    return out


def _moments(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = points.mean(axis=0)
    off = points[:, :2] - centre[:2]
    return centre, off.T @ off / len(points)


def step_points(tracks: TrackSet, clustering: Dbscan, points: np.ndarray, velocity: np.ndarray, snr: np.ndarray) -> np.ndarray:
    """One frame of single points; the track id of each point, -1 where it has none."""
    n = len(points)
    tracks.predict()
    out = np.full(n, -1, np.int64)
    if len(tracks) and n:
        distance, ok = tracks.gates(points[:, :2], velocity)
        distance = np.where(ok, distance, np.inf)
        nearest = distance.argmin(axis=0)  # the earlier track of equally near ones
        hit = np.isfinite(distance[nearest, np.arange(n)])
        out[hit] = tracks.track_id[nearest[hit]]
    matched = set()
    for t in range(len(tracks)):
        own = np.flatnonzero(out == tracks.track_id[t])
        if len(own):
            centre, extent = _moments(points[own])
            tracks.update(t, centre, extent, len(own))
            matched.add(t)
    tracks.miss(matched)
    gone = tracks.expire()
    out[np.isin(out, list(gone))] = -1
    free = np.flatnonzero(out < 0)
    if not len(free) or tracks.full(0):
        return out
    labels = dbscan_labels(points[free], velocity[free], clustering)
    members = [free[labels == c] for c in range(labels.max() + 1)]
    made = 0
    for own in sorted(members, key=len, reverse=True):
        if tracks.full(made):
            break
        centre, extent = _moments(points[own])
        if tracks.admits(centre, len(own), float(velocity[own].mean()), float(snr[own].sum())):
            out[own] = tracks.allocate(centre, extent)
            made += 1
    return out


TRACK_FIELDS = (
    "track_id bigint, px double, py double, pz double, vx double, vy double, vz double, pos_cov array<array<double>>, "
    "ext_cov array<array<double>>, status string, age int, missed int, observations array<bigint>"
)


def _frames(pdf: pd.DataFrame, frame: str, order: str):
    for number, rows in pdf.sort_values([frame, order], kind="stable").groupby(frame, sort=True):
        yield number, rows[rows[order].notna()]


def _reported(tracks: TrackSet, number, ids: np.ndarray, names: np.ndarray) -> list[dict]:
    return [{"frame_id": number, **r, "observations": [int(x) for x in names[ids == r["track_id"]]]} for r in tracks.report()]


def run_clusters(tracks: TrackSet, pdf: pd.DataFrame) -> list[dict]:
    """Steps over rows of (frame_id, cluster_id, cx.., ex.., mean_velocity, point_count); a null cluster_id marks an empty frame."""
    out = []
    for number, rows in _frames(pdf, "frame_id", "cluster_id"):
        ids = step_clusters(tracks, rows[["cx", "cy", "cz"]].to_numpy(float), rows[["ex", "ey", "ez"]].to_numpy(float), rows["mean_velocity"].to_numpy(float), rows["point_count"].to_numpy(np.int64))
        out += _reported(tracks, number, ids, rows["cluster_id"].to_numpy())
    return out


def run_points(tracks: TrackSet, clustering: Dbscan, pdf: pd.DataFrame) -> list[dict]:
    """Steps over rows of (frame_id, point_idx, x, y, z, velocity, snr); a null point_idx marks an empty frame."""
    out = []
    for number, rows in _frames(pdf, "frame_id", "point_idx"):
        ids = step_points(tracks, clustering, rows[["x", "y", "z"]].to_numpy(float), rows["velocity"].to_numpy(float), rows["snr"].to_numpy(float))
        out += _reported(tracks, number, ids, rows["point_idx"].to_numpy())
    return out


def _tracked(rows: DataFrame, spec: TrackerSpec, run, capture: str, order: str) -> DataFrame:
    """Steps over sorted rows as they stream through a task; of a capture, only its tracks and one batch are held."""
    columns = ["frame_id", *[f.split()[0] for f in TRACK_FIELDS.split(", ")]]

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tracks, held = None, TrackSet(spec), None

        def tracked(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal current, tracks
            for name, part in pdf.groupby(capture, sort=False):
                if name != current:
                    current, tracks = name, TrackSet(spec)
                out = pd.DataFrame(run(tracks, part), columns=columns)
                out.insert(0, capture, name)
                yield out

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # the last frame may go on in the next batch
            same = (pdf[capture] == pdf[capture].iloc[-1]) & (pdf["frame_id"] == pdf["frame_id"].iloc[-1])
            held = pdf[same]
            yield from tracked(pdf[~same])
        if held is not None:
            yield from tracked(held)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return in_order(rows, (capture,), "frame_id", order).mapInPandas(steps, f"{capture} {kinds[capture]}, frame_id {kinds['frame_id']}, {TRACK_FIELDS}")


def track_clusters(clusters: DataFrame, spec: TrackerSpec, capture: str = "capture_id") -> DataFrame:
    """Tracks after every frame; a capture is one sequence, captures are independent."""
    return _tracked(clusters, spec, run_clusters, capture, "cluster_id")


def track_points(points: DataFrame, spec: TrackerSpec, clustering: Dbscan, capture: str = "capture_id") -> DataFrame:
    return _tracked(points, spec, lambda tracks, pdf: run_points(tracks, clustering, pdf), capture, "point_idx")
