"""Density clustering per frame, cluster summaries, and optimal assignment."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.contracts import Dbscan

#: Frames of up to this many points are compared point by point, larger ones cell by cell.
ROWS = 1024
#: Pairs of points whose distances are formed at once.
PAIRS = 1 << 20


def dbscan_labels(points: np.ndarray, velocity: np.ndarray | None, spec: Dbscan) -> np.ndarray:
    """Cluster of each point, -1 for noise.

    Clusters are numbered by their first core point; a border point goes to the lowest-numbered cluster that has
    a core point in reach. This is what scanning and expanding in row order gives.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    features = [points[:, 0], points[:, 1]]
    if spec.use_z:
        features.append(points[:, 2])
    if spec.velocity_scale_s > 0 and velocity is not None:
        features.append(velocity * spec.velocity_scale_s)
    x = np.stack(features, axis=1).astype(float)
    if n > ROWS:
        return _grid_labels(x, spec)
    gap = x[:, None, :] - x[None, :, :]
    near = (gap * gap).sum(axis=2) <= spec.eps_m**2
    core = near.sum(axis=1) >= spec.min_samples
    label = np.where(core, np.arange(n), n)
    links = near & core[None, :]
    while True:
        # labels of core points spread among core points until nothing changes
        spread = np.where(links, label[None, :], n).min(axis=1)
        new = np.where(core, np.minimum(label, spread), n)
        if (new == label).all():
            break
        label = new
    roots = np.unique(label[core])
    number = np.full(n + 1, n, np.int64)
    number[roots] = np.arange(len(roots))
    out = np.where(links, number[label][None, :], n).min(axis=1)
    return np.where(out == n, -1, out)


def _near_pairs(x: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i before j in a cell order, of points within eps; each pair once, a bounded number at a time.

    Points fall into cells of side eps, so near points are in equal or adjacent cells.
    """
    # cells a little longer than eps, so that rounding cannot put near points two cells apart
    cell = np.floor((x - x.min(axis=0)) / (eps * (1 + 1e-9))).astype(np.int64)
    order = np.lexsort(cell.T[::-1])
    cells, starts, sizes = np.unique(cell[order], axis=0, return_index=True, return_counts=True)
    place = {tuple(c): k for k, c in enumerate(cells.tolist())}
    steps = [s for s in itertools.product((-1, 0, 1), repeat=x.shape[1]) if s >= (0,) * x.shape[1]]
    for k, c in enumerate(cells.tolist()):
        own = order[starts[k] : starts[k] + sizes[k]]
        around = [place[t] for s in steps if (t := tuple(a + b for a, b in zip(c, s))) in place]
        others = np.concatenate([order[starts[m] : starts[m] + sizes[m]] for m in around])  # its own points come first
        width = max(1, PAIRS // len(others))
        for at in range(0, len(own), width):
            part = own[at : at + width]
            gap = x[part][:, None, :] - x[others][None, :, :]
            i, j = np.nonzero((gap * gap).sum(axis=2) <= eps * eps)
            keep = j > i + at  # within the cell, each pair once
            yield part[i[keep]], others[j[keep]]


def _grid_labels(x: np.ndarray, spec: Dbscan) -> np.ndarray:
    """Labels by union-find over the pairs of core points; memory grows with the points, not with their pairs."""
    n = len(x)
    neighbours = np.ones(n, np.int64)
    for i, j in _near_pairs(x, spec.eps_m):
        neighbours += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    core = neighbours >= spec.min_samples
    root = np.arange(n)

    def settle() -> None:
        nonlocal root
        while (root[root] != root).any():
            root = root[root]

    for i, j in _near_pairs(x, spec.eps_m):
        both = core[i] & core[j]
        i, j = i[both], j[both]
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, high[apart], low[apart])
            settle()
    number = np.full(n + 1, n, np.int64)
    firsts = np.unique(root[core])
    number[firsts] = np.arange(len(firsts))
    out = np.where(core, number[root], n)
    for i, j in _near_pairs(x, spec.eps_m):
        for border, other in ((i, j), (j, i)):
            some = ~core[border] & core[other]
            np.minimum.at(out, border[some], number[root[other[some]]])
    return np.where(out == n, -1, out)


def cluster_points(points: DataFrame, spec: Dbscan, keys: tuple[str, ...] = ("frame_id",), order: str = "point_idx") -> DataFrame:
    """(keys..., order, cluster_id): a frame is one group; frames are independent and spread over the cluster."""
    has_v = "velocity" in points.columns
    cols = [*keys, order, "x", "y", "z", *(["velocity"] if has_v else [])]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        v = pdf["velocity"].to_numpy(float) if has_v else None
        if not np.isfinite(xyz).all() or (v is not None and not np.isfinite(v).all()):
            raise ValueError("points must be finite")
        out = pdf[[*keys, order]].copy()
        out["cluster_id"] = dbscan_labels(xyz, v, spec)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, order)], "cluster_id bigint"])
    return points.select(*cols).groupBy(*keys).applyInPandas(label, schema)


def summarize_clusters(points: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("frame_id",), order: str = "point_idx") -> DataFrame:
    """Centre, extent, mean velocity (0 without a velocity channel) and size of each cluster."""
    rows = points.join(labels.filter(F.col("cluster_id") >= 0), [*keys, order])
    velocity = F.avg("velocity") if "velocity" in points.columns else F.lit(0.0)
    return rows.groupBy(*keys, "cluster_id").agg(
        *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        *[(F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"],
        velocity.alias("mean_velocity"),
        F.count(F.lit(1)).alias("point_count"),
    )


def linear_sum_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment of the shorter side, rows ascending.

    Shortest augmenting paths with dual prices, one free row at a time, so ties resolve to the lowest column.
    """
    cost = np.asarray(cost, float)
    if not np.isfinite(cost).all():
        raise ValueError("costs must be finite")
    if cost.shape[0] > cost.shape[1]:
        cols, rows = linear_sum_assignment(cost.T)
        order = np.argsort(rows, kind="stable")
        return rows[order], cols[order]
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for free in range(n):
        shortest, came_from, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, distance, last = free, 0.0, -1
        while True:
            through = distance + cost[row] - row_price[row] - col_price
            better = ~done & (through < shortest)
            shortest[better], came_from[better] = through[better], last
            col = int(np.where(done, np.inf, shortest).argmin())
            distance, done[col] = shortest[col], True
            if owner[col] < 0:
                break
            row, last = owner[col], col
        reached = np.flatnonzero(done & (np.arange(m) != col))
        row_price[free] += distance
        row_price[owner[reached]] += distance - shortest[reached]
        col_price[reached] -= distance - shortest[reached]
        while col >= 0:  # turn the path over
            before = came_from[col]
            owner[col] = free if before < 0 else owner[before]
            col = before
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols], kind="stable")
    return owner[cols][order], cols[order]


def assign(costs: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(keys..., row_idx, col_idx, cost) from a complete cost table (keys, row_idx, col_idx, cost) per group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="row_idx", columns="col_idx", values="cost")
        rows, cols = linear_sum_assignment(table.to_numpy())
        out = pd.DataFrame({"row_idx": table.index.to_numpy()[rows], "col_idx": table.columns.to_numpy()[cols], "cost": table.to_numpy()[rows, cols]})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in costs.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"row_idx {kinds['row_idx']}", f"col_idx {kinds['col_idx']}", "cost double"])
    return costs.select(*keys, "row_idx", "col_idx", F.col("cost").cast("double").alias("cost")).groupBy(*keys).applyInPandas(solve, schema)
