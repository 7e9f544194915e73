"""Queries over points, clusters, tracks, packets and time intervals."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import clustering as K, intervals as I, packets as P, track_metrics as M, tracking as T
from .contracts import Box2D, Dbscan, Gating, Lifecycle, Scenery
from .signals import exact_sum, r4, read, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- clustering: 25 embeddings make a frame of points

POINTS_SQL = """pts AS (SELECT (vec_id // 25)::BIGINT AS frame_id, (vec_id % 25)::INT AS point_idx,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS velocity FROM embeddings)"""
SPEC = Dbscan(0.13013, 3, 0.2)


def points(spark, sf_dir):
    v = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("frame_id"), (F.col("vec_id") % 25).cast("int").alias("point_idx"),
        v(0).alias("x"), v(1).alias("y"), v(2).alias("z"), v(3).alias("velocity"),
    )


_DBSCAN = f"""{POINTS_SQL}, near AS (
  SELECT a.frame_id, a.point_idx AS a, b.point_idx AS b FROM pts a JOIN pts b USING (frame_id)
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) + (a.velocity - b.velocity) * (a.velocity - b.velocity) * 0.2 * 0.2 <= 0.13013 * 0.13013),
core AS (SELECT frame_id, a AS p FROM near GROUP BY ALL HAVING count(*) >= 3),
edge AS (SELECT n.frame_id, n.a, n.b FROM near n JOIN core c ON c.frame_id = n.frame_id AND c.p = n.a JOIN core d ON d.frame_id = n.frame_id AND d.p = n.b),
walk AS (SELECT frame_id, p, p AS q FROM core UNION SELECT w.frame_id, w.p, e.b FROM walk w JOIN edge e ON e.frame_id = w.frame_id AND e.a = w.q),
root AS (SELECT frame_id, p, min(q) AS r FROM walk GROUP BY ALL),
num AS (SELECT frame_id, p, dense_rank() OVER (PARTITION BY frame_id ORDER BY r) - 1 AS c FROM root),
lab AS (SELECT pts.frame_id, pts.point_idx, coalesce(min(num.c), -1)::BIGINT AS cluster_id FROM pts
  LEFT JOIN near ON near.frame_id = pts.frame_id AND near.a = pts.point_idx
  LEFT JOIN num ON num.frame_id = near.frame_id AND num.p = near.b GROUP BY ALL)"""


@query("cluster_point_cloud", f"WITH RECURSIVE {_DBSCAN} SELECT * FROM lab")
def _(spark, sf_dir):
    return K.cluster_points(points(spark, sf_dir), SPEC)


_SUMMARY = "cx cy cz ex ey ez mean_velocity".split()


@query("cluster_summary", f"""WITH RECURSIVE {_DBSCAN}, s AS (SELECT frame_id, cluster_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(x) - min(x) AS ex,
  max(y) - min(y) AS ey, max(z) - min(z) AS ez, avg(velocity) AS mean_velocity, count(*) AS point_count
  FROM lab JOIN pts USING (frame_id, point_idx) WHERE cluster_id >= 0 GROUP BY ALL)
SELECT frame_id, cluster_id, {', '.join(r4(c, 6) for c in _SUMMARY)}, point_count FROM s""")
def _(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(K.summarize_clusters(pts, K.cluster_points(pts, SPEC)), *_SUMMARY, digits=6)


@query("linear_sum_assignment", """WITH c AS (SELECT vec_id AS frame_id, i // 4 AS r, i % 4 AS k, abs(embedding[i + 1]::DOUBLE) AS cost FROM embeddings, range(12) t(i)),
p AS (SELECT a.frame_id, a.k AS a, b.k AS b, d.k AS d, a.cost + b.cost + d.cost AS total FROM c a JOIN c b ON b.frame_id = a.frame_id AND b.r = 1 AND b.k <> a.k
  JOIN c d ON d.frame_id = a.frame_id AND d.r = 2 AND d.k NOT IN (a.k, b.k) WHERE a.r = 0),
best AS (SELECT frame_id, arg_min([a, b, d], total) AS ks FROM p GROUP BY frame_id)
SELECT best.frame_id, c.r::INT AS row_idx, c.k::INT AS col_idx, round(c.cost, 6) AS cost FROM best JOIN c ON c.frame_id = best.frame_id AND c.k = best.ks[c.r + 1]""")
def _(spark, sf_dir):
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode(F.slice("embedding", 1, 12)).alias("i", "v"))
    costs = cells.select("frame_id", F.floor(F.col("i") / 4).cast("int").alias("row_idx"), (F.col("i") % 4).cast("int").alias("col_idx"), F.abs(F.col("v").cast("double")).alias("cost"))
    return rounded(K.assign(costs), "cost", digits=6)


# --- tracks: a user is a track, a day a frame

TRACKS_SQL = """trk AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame_id, user_id AS track_id, avg(value) / 10 AS px, max(value) / 10 AS py,
  min(value) / 10 AS pz, sum(value) / 100 AS vx, count(*) / 10.0::DOUBLE AS vy, CASE WHEN count(*) >= 3 THEN 'confirmed' ELSE 'tentative' END AS status
  FROM events GROUP BY ALL)"""
_TRACK_NUMBERS = (
    "first_px first_py first_pz last_px last_py last_pz median_px median_py median_pz path_length_m median_speed_mps max_speed_mps displacement_m".split()
)
SCENERY = Scenery((Box2D(1.0, 4.0, 2.0, 8.0), Box2D(5.0, 9.0, 5.0, 20.0)))


def tracks(spark, sf_dir):
    """Means and sums are exact: a mean on the edge of a box, or half-way between two rounded numbers, is so in any order of the rows."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    total = exact_sum("value")
    return read(spark, sf_dir, "events").groupBy(day.alias("frame_id"), F.col("user_id").alias("track_id")).agg(
        (total / F.nullif(F.count("value"), F.lit(0)) / 10).alias("px"), (F.max("value") / 10).alias("py"), (F.min("value") / 10).alias("pz"),
        (total / 100).alias("vx"), (F.count(F.lit(1)) / 10.0).alias("vy"), F.lit(0.0).alias("vz"),
        F.when(F.count(F.lit(1)) >= 3, "confirmed").otherwise("tentative").alias("status"),
    )


@query("summarize_tracks", f"""WITH {TRACKS_SQL}, s AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed,
  coalesce(sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)), 0) AS step FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
a AS (SELECT track_id, count(*) AS observed_frames, count(*) FILTER (WHERE status = 'confirmed') AS confirmed_frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame,
  arg_min(px, frame_id) AS first_px, arg_min(py, frame_id) AS first_py, arg_min(pz, frame_id) AS first_pz,
  arg_max(px, frame_id) AS last_px, arg_max(py, frame_id) AS last_py, arg_max(pz, frame_id) AS last_pz,
  median(px) AS median_px, median(py) AS median_py, median(pz) AS median_pz, sum(step) AS path_length_m, median(speed) AS median_speed_mps, max(speed) AS max_speed_mps,
  count(*) FILTER (WHERE (px BETWEEN 1 AND 4 AND py BETWEEN 2 AND 8) OR (px BETWEEN 5 AND 9 AND py BETWEEN 5 AND 20)) AS in_scenery_frames FROM s GROUP BY track_id),
c AS (SELECT track_id, frame_id, frame_id - row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS g FROM trk WHERE status = 'confirmed'),
i AS (SELECT track_id, min(frame_id) AS f, max(frame_id) AS t FROM c GROUP BY track_id, g),
j AS (SELECT track_id, string_agg(f || '-' || t, ',' ORDER BY f) AS confirmed_intervals FROM i GROUP BY track_id),
z AS (SELECT *, sqrt(pow(last_px - first_px, 2) + pow(last_py - first_py, 2)) AS displacement_m, observed_frames - in_scenery_frames AS outside_scenery_frames FROM a)
SELECT track_id, observed_frames, confirmed_frames, first_frame, last_frame, {', '.join(r4(c, 6) for c in _TRACK_NUMBERS)}, in_scenery_frames, outside_scenery_frames,
  coalesce(confirmed_intervals, '') AS confirmed_intervals FROM z LEFT JOIN j USING (track_id)""")
def _(spark, sf_dir):
    out = rounded(M.summarize_tracks(tracks(spark, sf_dir), SCENERY), *_TRACK_NUMBERS, digits=6)
    text = F.array_join(F.transform("confirmed_intervals", lambda i: F.concat_ws("-", i[0], i[1])), ",")
    return out.withColumn("confirmed_intervals", text)


@query("track_confirmed_intervals", f"""WITH {TRACKS_SQL}, c AS (SELECT track_id, frame_id, frame_id - row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS g FROM trk WHERE status = 'confirmed')
SELECT track_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM c GROUP BY track_id, g""")
def _(spark, sf_dir):
    return M.confirmed_intervals(tracks(spark, sf_dir), ["track_id"])


@query("summarize_track_sequence", f"""WITH {TRACKS_SQL}, f AS (SELECT frame_id, count(*) AS n, max((status = 'confirmed')::INT) AS c FROM trk GROUP BY ALL),
t AS (SELECT track_id, max((status = 'confirmed')::INT) AS c FROM trk GROUP BY ALL)
SELECT count(*) AS frames_with_tracks, sum(c)::BIGINT AS frames_with_confirmed_tracks, max(n) AS max_concurrent_tracks, (SELECT count(*) FROM t) AS observed_track_ids,
  (SELECT sum(c) FROM t)::BIGINT AS confirmed_track_ids, 31 AS num_frames, round(sum(c) / 31.0::DOUBLE, 6) AS confirmed_frame_coverage FROM f""")
def _(spark, sf_dir):
    return rounded(M.summarize_sequence(tracks(spark, sf_dir), 31), "confirmed_frame_coverage", digits=6)


def evaluation(spark, sf_dir):
    """Truth: embeddings 0, 1 mod 5 of a frame of five; predictions: the other three."""
    e = read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("frame_id"), (F.col("vec_id") % 5).alias("k"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")],
    )
    truth = e.filter("k < 2").select("frame_id", F.col("k").alias("truth_id"), "x", "y", "z")
    pred = e.filter("k >= 2").select("frame_id", F.col("k").alias("track_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.lit("confirmed").alias("status"))
    return pred, truth


_MATCH = """e AS (SELECT vec_id // 5 AS frame_id, vec_id % 5 AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT t.frame_id, t.k AS truth_id, p.k AS track_id, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z)) AS distance
  FROM e t JOIN e p USING (frame_id) WHERE t.k < 2 AND p.k >= 2),
q AS (SELECT a.frame_id, a.track_id AS p0, b.track_id AS p1, a.distance + b.distance AS total FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.truth_id = 0 AND b.truth_id = 1 AND a.track_id <> b.track_id),
best AS (SELECT frame_id, arg_min(p0, total) AS p0, arg_min(p1, total) AS p1 FROM q GROUP BY frame_id),
m AS (SELECT d.frame_id, d.truth_id, d.track_id, d.distance FROM best JOIN d ON d.frame_id = best.frame_id AND d.track_id = CASE d.truth_id WHEN 0 THEN p0 ELSE p1 END WHERE distance <= 0.20013)"""


@query("match_track_frames", f"WITH {_MATCH} SELECT frame_id, truth_id, track_id, round(distance, 6) AS distance FROM m")
def _(spark, sf_dir):
    return rounded(M.match_frames(*evaluation(spark, sf_dir), 0.20013), "distance", digits=6)


_SWITCH = "sw AS (SELECT frame_id, truth_id, lag(track_id) OVER (PARTITION BY truth_id ORDER BY frame_id) AS previous_track_id, track_id AS new_track_id FROM m)"


@query("track_identity_switches", f"WITH {_MATCH}, {_SWITCH} SELECT * FROM sw WHERE previous_track_id <> new_track_id")
def _(spark, sf_dir):
    return M.identity_switches(M.match_frames(*evaluation(spark, sf_dir), 0.20013))


@query("evaluate_track_frames", f"""WITH {_MATCH}, {_SWITCH}, n AS (SELECT count(*) FILTER (WHERE k < 2) AS t, count(*) FILTER (WHERE k >= 2) AS p FROM e), c AS (SELECT count(*) AS c, sqrt(avg(distance * distance)) AS r FROM m)
SELECT t AS ground_truth_observations, c AS matched_observations, t - c AS missed_observations, p - c AS false_track_observations,
  (SELECT count(*) FROM sw WHERE previous_track_id <> new_track_id) AS id_switches, round(r, 6) AS position_rmse_m, round(c / t::DOUBLE, 6) AS recall FROM n, c""")
def _(spark, sf_dir):
    return rounded(M.evaluate_tracks(*evaluation(spark, sf_dir), 0.20013), "position_rmse_m", "recall", digits=6)


@query("polar_to_cartesian", f"""WITH {POINTS_SQL}, p AS (SELECT frame_id, point_idx, abs(x) * 10 AS range_m, y AS azimuth_rad FROM pts)
SELECT frame_id, point_idx, round(range_m * sin(azimuth_rad), 6) + 0.0 AS x, round(range_m * cos(azimuth_rad), 6) + 0.0 AS y FROM p""")
def _(spark, sf_dir):
    p = points(spark, sf_dir).select("frame_id", "point_idx", (F.abs("x") * 10).alias("range_m"), F.col("y").alias("azimuth_rad"))
    return rounded(M.polar_to_cartesian(p).select("frame_id", "point_idx", "x", "y"), "x", "y", digits=6)


TRACKER = T.TrackerSpec(T.Dynamics(0.1), Gating(0.6, None, 6.0), lifecycle=Lifecycle(3, 2, 3))


def _captures(df):
    """Ten frames make a capture."""
    return df.withColumn("capture_id", F.floor(F.col("frame_id") / 10))


@query("cluster_tracker")
def _(spark, sf_dir):
    pts = points(spark, sf_dir)
    clusters = K.summarize_clusters(pts, K.cluster_points(pts, SPEC))
    return rounded(T.track_clusters(_captures(clusters), TRACKER).drop("pos_cov", "ext_cov"), "px", "py", "pz", "vx", "vy", "vz")


@query("measurement_tracker")
def _(spark, sf_dir):
    pts = _captures(points(spark, sf_dir)).withColumn("snr", F.lit(10.0))
    return rounded(T.track_points(pts, TRACKER, SPEC).drop("pos_cov", "ext_cov"), "px", "py", "pz", "vx", "vy", "vz")


# --- one Kalman cycle in closed form: two embeddings are a capture of two observations, a third frame is empty

PAIR_SPEC = T.TrackerSpec(T.Dynamics(0.5, (2.0, 2.0), 0.2, 2.0), Gating(0.18013), lifecycle=Lifecycle(2, 4, 11))
_R2, _S2, _DT, _A2 = 0.2**2, 2.0**2, 0.5, 2.0**2
_PP = _R2 + _DT**2 * _S2 + _A2 * _DT**4 / 4
_GAIN, _GAIN_V = _PP / (_PP + _R2), (_DT * _S2 + _A2 * _DT**3 / 2) / (_PP + _R2)
#: A track is allocated at the first observation; the second one updates it or, beyond the gate, makes another one.
PAIR_SQL = f"""WITH e AS (SELECT vec_id // 2 AS capture_id, vec_id % 2 AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
p AS (SELECT a.capture_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= 0.18013 AS near
  FROM e a JOIN e b ON a.capture_id = b.capture_id AND a.k = 0 AND b.k = 1),
u AS (SELECT *, x0 + {_GAIN!r} * (x1 - x0) AS ux, y0 + {_GAIN!r} * (y1 - y0) AS uy, {_GAIN_V!r} * (x1 - x0) AS wx, {_GAIN_V!r} * (y1 - y0) AS wy FROM p),
t AS (
  SELECT capture_id, 0 AS frame_id, 0 AS track_id, x0 AS px, y0 AS py, z0 AS pz, 0.0 AS vx, 0.0 AS vy, 'tentative' AS status, 1 AS age, 0 AS missed FROM u
  UNION ALL SELECT capture_id, 1, 0, ux, uy, z1, wx, wy, 'confirmed', 2, 0 FROM u WHERE near
  UNION ALL SELECT capture_id, 2, 0, ux + 0.5 * wx, uy + 0.5 * wy, z1, wx, wy, 'coasting', 3, 1 FROM u WHERE near
  UNION ALL SELECT capture_id, 1, 0, x0, y0, z0, 0.0, 0.0, 'tentative', 2, 1 FROM u WHERE NOT near
  UNION ALL SELECT capture_id, 1, 1, x1, y1, z1, 0.0, 0.0, 'tentative', 1, 0 FROM u WHERE NOT near
  UNION ALL SELECT capture_id, 2, 0, x0, y0, z0, 0.0, 0.0, 'tentative', 3, 2 FROM u WHERE NOT near
  UNION ALL SELECT capture_id, 2, 1, x1, y1, z1, 0.0, 0.0, 'tentative', 2, 1 FROM u WHERE NOT near)
SELECT capture_id, frame_id::BIGINT AS frame_id, track_id::BIGINT AS track_id, {", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in ("px", "py", "pz", "vx", "vy"))}, status, age::INT AS age, missed::INT AS missed FROM t"""


def _pairs(spark, sf_dir, name: str):
    """(capture_id, frame_id, name, x, y, z): an observation in frames 0 and 1, none in frame 2."""
    v = lambda i: F.col("embedding")[i].cast("double")
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("capture_id"), (F.col("vec_id") % 2).alias("frame_id"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))
    both = e.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("capture_id")
    seen = e.join(both, "capture_id").withColumn(name, F.lit(0).cast("bigint"))
    none = both.select("capture_id", F.lit(2).cast("bigint").alias("frame_id"), *[F.lit(None).cast("double").alias(c) for c in "xyz"], F.lit(None).cast("bigint").alias(name))
    return seen.unionByName(none)


def paired_clusters(spark, sf_dir):
    rows = _pairs(spark, sf_dir, "cluster_id")
    flat = [F.lit(0.0).alias(c) for c in ("ex", "ey", "ez", "mean_velocity")]
    return rows.select("capture_id", "frame_id", "cluster_id", *[F.col(c).alias(f"c{c}") for c in "xyz"], *flat, F.lit(1).cast("bigint").alias("point_count"))


def shown(tracked):
    return rounded(tracked.select("capture_id", "frame_id", "track_id", "px", "py", "pz", "vx", "vy", "status", "age", "missed"), "px", "py", "pz", "vx", "vy", digits=6)


@query("kalman_lifecycle_clusters", PAIR_SQL)
def _(spark, sf_dir):
    return shown(T.track_clusters(paired_clusters(spark, sf_dir), PAIR_SPEC))


@query("kalman_lifecycle_points", PAIR_SQL)
def _(spark, sf_dir):
    rows = _pairs(spark, sf_dir, "point_idx").withColumns({"velocity": F.lit(0.0), "snr": F.lit(1.0)})
    return shown(T.track_points(rows, PAIR_SPEC, Dbscan(0.1, 1)))


# --- packets: an order line is a datagram, a supplier's lines are a capture

N_PACKETS, START = 64, 4294967290
_PACKET_SQL = f"""pk AS (SELECT l_suppkey AS capture_id, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS arrival, ({START} + (l_partkey * 7 + l_orderkey) % 80) % 4294967296 AS packet_number FROM lineitem),
cl AS (SELECT *, (packet_number - {START} + 4294967296) % 4294967296 AS slot, row_number() OVER (PARTITION BY capture_id, packet_number ORDER BY arrival) AS rn FROM pk),
ft AS (SELECT *, CASE WHEN slot >= {N_PACKETS} THEN 'out_of_frame' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS fate FROM cl)"""


def packets(spark, sf_dir):
    number = F.pmod(F.lit(START) + (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 80, F.lit(1 << 32))
    word = F.pmod(F.col("l_partkey") * 25173 + 13849, F.lit(65536))
    i16 = (word - F.when(word >= 32768, 65536).otherwise(0)).cast("smallint")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("capture_id"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("arrival"), number.alias("packet_number"),
        F.array_repeat(i16, F.col("l_linenumber").cast("int")).alias("payload"),
    )


@query("packet_fates", f"WITH {_PACKET_SQL} SELECT capture_id, arrival, packet_number, slot, fate FROM ft")
def _(spark, sf_dir):
    return P.classify_packets(packets(spark, sf_dir), START, N_PACKETS).drop("payload")


@query("missing_packets", f"""WITH {_PACKET_SQL}, s AS (SELECT DISTINCT capture_id, k FROM pk, range({N_PACKETS}) t(k))
SELECT capture_id, (k + {START}) % 4294967296 AS packet_number FROM s ANTI JOIN ft ON ft.capture_id = s.capture_id AND ft.slot = s.k AND ft.fate = 'kept'""")
def _(spark, sf_dir):
    return P.missing_packets(packets(spark, sf_dir), START, N_PACKETS)


@query("packet_loss_statistics", f"""WITH {_PACKET_SQL} SELECT capture_id, {N_PACKETS} AS expected, count(*) FILTER (WHERE fate = 'kept') AS received,
  {N_PACKETS} - count(*) FILTER (WHERE fate = 'kept') AS n_missing, coalesce(string_agg(packet_number::VARCHAR, ',' ORDER BY arrival) FILTER (WHERE fate = 'duplicate'), '') AS duplicate,
  count(*) FILTER (WHERE fate = 'out_of_frame') AS n_out FROM ft GROUP BY capture_id""")
def _(spark, sf_dir):
    out = P.packet_loss(packets(spark, sf_dir), START, N_PACKETS)
    return out.select("capture_id", "expected", "received", F.size("missing").cast("bigint").alias("n_missing"), F.array_join(F.transform("duplicate", lambda x: x.cast("string")), ",").alias("duplicate"), F.size("out_of_frame").cast("bigint").alias("n_out"))


@query("reorder_packets", f"""WITH {_PACKET_SQL}, w AS (SELECT l_suppkey AS capture_id, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS arrival, l_linenumber AS width,
  CASE WHEN (l_partkey * 25173 + 13849) % 65536 >= 32768 THEN (l_partkey * 25173 + 13849) % 65536 - 65536 ELSE (l_partkey * 25173 + 13849) % 65536 END AS word FROM lineitem),
m AS (SELECT capture_id, max(width) AS mw FROM w GROUP BY ALL),
g AS (SELECT m.capture_id, k.k, j.j, coalesce(CASE WHEN j.j < w.width THEN w.word END, -1) AS v FROM m CROSS JOIN range({N_PACKETS}) k(k) JOIN range(8) j(j) ON j.j < m.mw
  LEFT JOIN ft ON ft.capture_id = m.capture_id AND ft.slot = k.k AND ft.fate = 'kept' LEFT JOIN w ON w.capture_id = ft.capture_id AND w.arrival = ft.arrival)
SELECT capture_id, md5(string_agg(v::VARCHAR, ',' ORDER BY k, j)) AS samples_md5, count(*) AS n_words FROM g GROUP BY capture_id""")
def _(spark, sf_dir):
    out = P.reorder_packets(packets(spark, sf_dir), START, N_PACKETS, fill=-1)
    text = F.array_join(F.transform("samples", lambda x: x.cast("string")), ",")
    return out.select("capture_id", F.md5(text).alias("samples_md5"), F.size("samples").cast("bigint").alias("n_words"))


# --- intervals: clicks cause purchases; an event lasts its value in milliseconds

LAG = 600_000_000
_EV = "ev AS (SELECT event_id AS id, event_type, epoch_us(ts) AS s, epoch_us(ts) + round(value * 1000)::BIGINT AS e FROM events)"


def event_intervals(spark, sf_dir, kind):
    ev = read(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(F.col("event_id").alias("id"), start.alias("start_ns"), (start + F.round(F.col("value") * 1000).cast("bigint")).alias("end_ns"))


@query("causal_pairs", f"""WITH {_EV} SELECT a.id AS earlier_id, b.id AS later_id FROM ev a JOIN ev b ON b.s - a.e <= {LAG} AND b.e - a.s >= 0
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def _(spark, sf_dir):
    return I.causal_pairs(event_intervals(spark, sf_dir, "click"), event_intervals(spark, sf_dir, "purchase"), 0, LAG, LAG)


_SEG = [(day, day * 86_400_000, (day + 1) * 86_400_000, day * 86_400_000, 1_704_067_200_000_000_000 + day * 86_400_000_000_000, 3_000_001 + day, 3, 100 + day) for day in range(31)]
_SEG_SQL = "seg(k, st, en, o, h, num, den, u) AS (VALUES " + ", ".join(f"({k}, {a}::HUGEINT, {b}::HUGEINT, {o}::HUGEINT, {h}::HUGEINT, {n}::HUGEINT, {d}::HUGEINT, {u}::HUGEINT)" for k, a, b, o, h, n, d, u in _SEG) + ")"
_TICK = "it AS (SELECT event_id AS item_index, ((epoch_us(ts) - 1704067200000000) // 1000)::HUGEINT AS tick, round(value)::HUGEINT AS dur FROM events)"


def clock_items(spark, sf_dir):
    """Events as items of one source: ticks are milliseconds of January, durations whole values."""
    tick = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000)
    items = read(spark, sf_dir, "events").select(F.lit("s").alias("source_id"), F.col("event_id").alias("item_index"), tick.cast("decimal(20,0)").alias("tick"), F.round("value").cast("decimal(20,0)").alias("duration_ticks"))
    rows = [("s", a, b, o, h, n, d, u) for _, a, b, o, h, n, d, u in _SEG]
    names = "source_id string, start_tick bigint, end_tick bigint, source_origin_tick bigint, host_origin_ns bigint, scale_num bigint, scale_den bigint, uncertainty_ns bigint"
    return items, spark.createDataFrame(rows, names)


@query("clock_segment_lookup", f"WITH {_SEG_SQL}, {_TICK} SELECT item_index, tick::BIGINT AS tick, st::BIGINT AS start_tick FROM it JOIN seg ON tick >= st AND tick < en")
def _(spark, sf_dir):
    items, segments = clock_items(spark, sf_dir)
    return I.segment_of(items, segments).select("item_index", F.col("tick").cast("bigint").alias("tick"), "start_tick")


for _kind, _lo, _hi, _den in (("frame_start", "n", "n + w", "den"), ("exposure_midpoint", "2 * n - w", "2 * n + w", "(2 * den)")):

    def _mapped(spark, sf_dir, kind=_kind):
        items, segments = clock_items(spark, sf_dir)
        out = I.map_interval(I.segment_of(items, segments), kind)
        return out.select("item_index", F.col("start_ns").cast("bigint").alias("start_ns"), F.col("end_ns").cast("bigint").alias("end_ns"))

    _floor = lambda a, d: f"((({a}) - ((({a}) % {d}) + {d}) % {d}) // {d})"
    query(f"clock_interval_{_kind}", f"""WITH {_SEG_SQL}, {_TICK}, j AS (SELECT item_index, dur, den, u, h * den + (tick - o) * num AS n, dur * num AS w FROM it JOIN seg ON tick >= st AND tick < en)
SELECT item_index, (CASE WHEN dur = 0 THEN {_floor('n', 'den')} ELSE {_floor(_lo, _den)} END - u)::BIGINT AS start_ns,
  (CASE WHEN dur = 0 THEN -{_floor('-n', 'den')} ELSE -{_floor(f'-({_hi})', _den)} END + u)::BIGINT AS end_ns FROM j""")(_mapped)


@query("clock_segment_validation", f"WITH {_SEG_SQL} SELECT st::BIGINT AS start_tick, CASE WHEN st < lag(en) OVER (ORDER BY st) THEN 'overlap' WHEN (h * den + (st - o) * num) * lag(den) OVER (ORDER BY st) < lag(h * den + (en - o) * num) OVER (ORDER BY st) * den THEN 'moves backwards' END AS problem FROM seg")
def _(spark, sf_dir):
    return I.validate_segments(clock_items(spark, sf_dir)[1]).select("start_tick", "problem")


_EPOCH_SQL = """WITH k AS (SELECT c_custkey::HUGEINT AS k, 1700000000000000000 + c_custkey::HUGEINT * 1000003 AS h, 1 + (c_custkey * 7919) % 1000000 AS d1, 1 + (c_custkey * 104729) % 1000000 AS d2 FROM customer),
seg AS (
  SELECT 2 * k AS source_id, 0::HUGEINT AS st, d1 * 1000 AS en, 0::HUGEINT AS o, h, d1 + k % 7 AS num, d1 AS den FROM k
  UNION ALL SELECT 2 * k, d1 * 1000, d1 * 1000 + 100, d1 * 1000, h + (d1 + k % 7) * 1000 - (k % 3 = 0)::INT, d2 + 1, d2 FROM k
  UNION ALL SELECT 2 * k + 1, 0, 777, 0, h, d1 + k % 7, d1 FROM k
  UNION ALL SELECT 2 * k + 1, 777, 900, 777 + k % 5, h + (777 * (d1 + k % 7)) // d1 + k % 5 + k % 2, d2 + 1, d2 FROM k)
SELECT source_id::BIGINT AS source_id, st::BIGINT AS start_tick,
  CASE WHEN (h * den + (st - o) * num) * lag(den) OVER w < lag(h * den + (en - o) * num) OVER w * den THEN 'moves backwards' END AS problem
FROM seg WINDOW w AS (PARTITION BY source_id ORDER BY st)"""


@query("clock_segment_validation_epoch", _EPOCH_SQL)
def _(spark, sf_dir):
    """Continuous, nearly continuous and backward boundaries of segments with nanosecond-epoch origins and large scales."""
    k, h, d1, d2 = (F.col(c) for c in ("k", "h", "d1", "d2"))
    key = F.col("c_custkey").cast("bigint")
    rows = read(spark, sf_dir, "customer").select(
        key.alias("k"), (F.lit(1700000000000000000) + key * 1000003).alias("h"), (1 + (key * 7919) % 1000000).alias("d1"), (1 + (key * 104729) % 1000000).alias("d2")
    )
    names = ("source_id", "start_tick", "end_tick", "source_origin_tick", "host_origin_ns", "scale_num", "scale_den")
    n1 = d1 + k % 7
    zero = F.lit(0).cast("bigint")
    made = [
        (2 * k, zero, d1 * 1000, zero, h, n1, d1),
        (2 * k, d1 * 1000, d1 * 1000 + 100, d1 * 1000, h + n1 * 1000 - (k % 3 == 0).cast("int"), d2 + 1, d2),
        (2 * k + 1, zero, F.lit(777).cast("bigint"), zero, h, n1, d1),
        (2 * k + 1, F.lit(777).cast("bigint"), F.lit(900).cast("bigint"), 777 + k % 5, h + F.floor(777 * n1 / d1) + k % 5 + k % 2, d2 + 1, d2),
    ]
    segments = rows.select(F.inline(F.array(*[F.struct(*[c.cast("bigint").alias(n) for c, n in zip(row, names)]) for row in made])))
    return I.validate_segments(segments).select("source_id", "start_tick", "problem")


@query("commit_accepted_items", """WITH it AS (SELECT user_id AS source_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS item_index FROM events),
en AS (SELECT c_custkey AS source_id, (c_custkey % 40) AS n FROM customer WHERE c_custkey % 3 <> 0)
SELECT it.source_id, event_id, item_index FROM it JOIN en USING (source_id) WHERE item_index < n""")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    items = read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", (F.row_number().over(w) - 1).cast("bigint").alias("item_index"))
    c = F.col("c_custkey")
    ends = read(spark, sf_dir, "customer").select(c.alias("source_id"), (c % 40).alias("item_count"), F.when(c % 3 == 0, "failed").otherwise("complete").alias("outcome"))
    return I.accepted_items(items, ends, ("source_id",))


@query("sync_event_cardinality", """WITH it AS (SELECT event_type AS source_id, user_id AS sync_event_id, count(*) AS n FROM events GROUP BY ALL),
b(source_id, required, minimum, maximum) AS (VALUES ('click', true, 5, 60), ('view', false, 2, 40), ('error', true, 1, 3)),
w AS (SELECT b.source_id, u.sync_event_id FROM b, (SELECT DISTINCT sync_event_id FROM it) u WHERE required UNION SELECT source_id, sync_event_id FROM it)
SELECT w.source_id, w.sync_event_id, coalesce(it.n, 0) AS n FROM w JOIN b USING (source_id) LEFT JOIN it ON it.source_id = w.source_id AND it.sync_event_id = w.sync_event_id
WHERE NOT coalesce(it.n, 0) BETWEEN minimum AND maximum""")
def _(spark, sf_dir):
    items = read(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("user_id").alias("sync_event_id"))
    bounds = spark.createDataFrame([("click", True, 5, 60), ("view", False, 2, 40), ("error", True, 1, 3)], "source_id string, required boolean, minimum bigint, maximum bigint")
    return I.event_cardinality(items, bounds)
