"""Queries over Cartesian volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cartesian import PlanarProjector, project_dense, sparsify_dense, sparsify_volume
from ..operators.dense import DenseCube
from .contracts import Fft, PlanarAperture, Sparsification
from .cube_queries import CHAIN, KEYS, _PLANAR, rd_cube
from .signals import FRAME, dft_sql, r4, raw_frames, read, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


PROJECTOR = PlanarProjector(
    PlanarAperture(((0, 0), (0, 1), (1, 1), (0, 1))), 0.5, 4, 2, -1.0, 1.0, 3, -1.2, 0.4, (2, 3, 3), (-0.1, -0.6, -0.2), (0.45, 0.55, 0.3), 4, 4
)
_FA = dft_sql("pl", "fa", "azimuth_aperture", "ab", [*KEYS, "doppler_bin", "range_bin", "elevation_aperture"], 2, n=4)
_FE = dft_sql("fa", "fe", "elevation_aperture", "eb", [*KEYS, "doppler_bin", "range_bin", "ab"], 2, n=4)


@query("planar_cartesian_projection", f"""WITH {CHAIN}, {_PLANAR}, {_FA}, {_FE},
g AS (SELECT z::INT AS z, y::INT AS y, x::INT AS x, -0.1::DOUBLE + x * 0.45::DOUBLE AS xm, -0.6::DOUBLE + y * 0.55::DOUBLE AS ym, -0.2::DOUBLE + z * 0.3::DOUBLE AS zm FROM range(2) a(z), range(3) b(y), range(3) c(x)),
s AS (SELECT z, y, x, sqrt(xm * xm + ym * ym + zm * zm) AS r, xm, ym, zm FROM g),
t AS (SELECT z, y, x, r / 0.5 AS ri, ym / r * 2 + 2 AS ai, zm / r * 2 + 2 AS ei FROM s WHERE r > 1e-7 AND xm >= 0 AND (ym * ym + zm * zm) / (r * r) <= 1 + 1e-6),
v AS (SELECT * FROM t WHERE ri BETWEEN 0 AND 3 AND ai BETWEEN 0 AND 3 AND ei BETWEEN 0 AND 3),
k AS (SELECT z, y, x, least(floor(ri)::INT + dr, 3) AS rb, (least(floor(ai)::INT + da, 3) + 2) % 4 AS ab, (least(floor(ei)::INT + de, 3) + 2) % 4 AS eb,
  (CASE dr WHEN 0 THEN 1 - (ri - floor(ri)) ELSE ri - floor(ri) END) * (CASE da WHEN 0 THEN 1 - (ai - floor(ai)) ELSE ai - floor(ai) END) * (CASE de WHEN 0 THEN 1 - (ei - floor(ei)) ELSE ei - floor(ei) END) AS w
  FROM v, range(2) p(dr), range(2) q(da), range(2) r(de)),
b AS (SELECT capture_id, frame, doppler_bin, k.z, k.y, k.x, sqrt(pow(sum(w * re), 2) + pow(sum(w * im), 2)) AS m FROM fe JOIN k ON fe.range_bin = k.rb AND fe.ab = k.ab AND fe.eb = k.eb GROUP BY ALL),
tv AS (SELECT d::INT AS d, (-1.2::DOUBLE + 0.4::DOUBLE * d + 1.0) / 1.0 AS tp FROM range(3) t(d)),
o AS (SELECT capture_id, frame, d, z, y, x, sum(m * CASE WHEN doppler_bin = floor(tp) THEN 1 - (tp - floor(tp)) ELSE tp - floor(tp) END) AS magnitude
  FROM b JOIN tv ON tp BETWEEN 0 AND 1 AND doppler_bin IN (floor(tp), least(floor(tp) + 1, 1)) GROUP BY ALL)
SELECT f.capture_id, f.frame, f.d::INT AS d, f.z, f.y, f.x, round(coalesce(o.magnitude, 0), 4) + 0.0 AS magnitude
FROM (SELECT DISTINCT capture_id, frame, t.d, g.z, g.y, g.x FROM words, range(3) t(d), g) f LEFT JOIN o USING (capture_id, frame, d, z, y, x)""")
def _(spark, sf_dir):
    return rounded(PROJECTOR.project(rd_cube(spark, sf_dir)), "magnitude")


@query("planar_cartesian_projection_dense", SQL["planar_cartesian_projection"])
def _(spark, sf_dir):
    cube = DenseCube(raw_frames(spark, sf_dir), FRAME).range_fft(Fft()).then("tdm", 2).doppler_fft()
    return rounded(project_dense(cube, PROJECTOR), "magnitude")


SHAPE = (4, 2, 4, 2)

_VOL = """vol AS (SELECT vec_id AS capture_id, 0 AS frame, (i // 16)::INT AS d, ((i // 8) % 2)::INT AS z, ((i // 2) % 4)::INT AS y, (i % 2)::INT AS x, i % 16 AS flat, i,
  abs(embedding[i + 1]::DOUBLE) AS m, CASE WHEN i // 16 = 3 THEN 0 ELSE abs(embedding[i + 1]::DOUBLE) END AS s FROM embeddings, range(64) t(i)),
nf AS (SELECT capture_id, d, exp(avg(ln(s)) FILTER (WHERE s > 0)) * 1.1 AS noise FROM vol GROUP BY ALL),
dp AS (SELECT a.capture_id, a.i, bool_and(b.i IS NULL OR NOT (a.s < b.s OR (a.s = b.s AND a.d > b.d))) AS dpeak FROM vol a LEFT JOIN vol b ON a.capture_id = b.capture_id AND a.flat = b.flat AND abs(a.d - b.d) = 1 GROUP BY ALL),
sp AS (SELECT a.capture_id, a.i, bool_and(b.i IS NULL OR NOT (a.m < b.m OR (a.m = b.m AND a.flat > b.flat))) AS speak FROM vol a LEFT JOIN vol b ON a.capture_id = b.capture_id AND a.d = b.d AND a.flat <> b.flat
  AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
al AS (SELECT vol.*, noise, dpeak, speak, CASE WHEN s > 0 AND noise > 0 THEN 20 * log10(s / noise) ELSE -1e300 END AS snr_db, (vol.d - 1.5) * 0.5 AS velocity
  FROM vol LEFT JOIN nf USING (capture_id, d) JOIN dp USING (capture_id, i) JOIN sp USING (capture_id, i)),
cand AS (SELECT * FROM al WHERE s > 0 AND dpeak AND speak AND snr_db >= 4.00013),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, flat ORDER BY snr_db DESC, i) AS n FROM cand) WHERE n <= 1),
st AS (SELECT *, abs(velocity) <= 0.3 AS static, row_number() OVER (PARTITION BY capture_id, abs(velocity) <= 0.3 ORDER BY snr_db DESC, i) AS place,
  count(*) FILTER (WHERE abs(velocity) <= 0.3) OVER (PARTITION BY capture_id) AS ns FROM lim),
sel AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY snr_db DESC, i) AS rank FROM st WHERE place <= CASE WHEN static THEN 2 ELSE 5 - least(ns, 2) END),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY m DESC, i) AS rank FROM al WHERE d <> 3) WHERE rank = 1 AND capture_id NOT IN (SELECT capture_id FROM sel)),
pt AS (SELECT capture_id, frame, d, z, y, x, velocity, snr_db, rank, false AS fallback FROM sel UNION ALL SELECT capture_id, frame, d, z, y, x, velocity, snr_db, rank, true FROM fb)"""
SPARSE = Sparsification(4.00013, 5, 1, 1, 1, 0, 1.1, 0.4, 0.3)


def volume(spark, sf_dir):
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), F.posexplode("embedding").alias("i", "v"))
    i = F.col("i")
    return cells.select(
        "capture_id", (F.col("capture_id") % 1).cast("int").alias("frame"), F.floor(i / 16).cast("int").alias("d"), (F.floor(i / 8) % 2).cast("int").alias("z"), (F.floor(i / 2) % 4).cast("int").alias("y"),
        (i % 2).alias("x"), F.abs(F.col("v").cast("double")).alias("magnitude"),
    )


def sparse(spark, sf_dir):
    return sparsify_volume(volume(spark, sf_dir), SHAPE, (F.col("d") - 1.5) * 0.5, SPARSE, suppressed=3)


@query("sparsify_cartesian_volume", f"WITH {_VOL} SELECT capture_id, frame, d, z, y, x, {r4('velocity')}, {r4('snr_db')}, rank, fallback FROM pt")
def _(spark, sf_dir):
    return rounded(sparse(spark, sf_dir)[0], "velocity", "snr_db")


@query("sparsification_counters", f"""WITH {_VOL}, c AS (SELECT capture_id, frame, 16 AS valid_spatial_voxels, count(*) FILTER (WHERE s > 0) AS positive_volume_voxels,
  count(*) FILTER (WHERE s > 0) AS valid_positive_volume_voxels, count(*) FILTER (WHERE s > 0 AND dpeak) AS doppler_peak_voxels, count(*) FILTER (WHERE s > 0 AND dpeak AND speak) AS local_peak_voxels FROM al GROUP BY ALL),
n AS (SELECT capture_id, min(noise) AS lo, median(noise) AS mid, max(noise) AS hi FROM nf WHERE noise > 0 GROUP BY ALL)
SELECT c.*, (SELECT count(*) FROM cand WHERE cand.capture_id = c.capture_id) AS threshold_peak_voxels, (SELECT count(*) FROM lim WHERE lim.capture_id = c.capture_id) AS limited_peak_voxels,
  round(lo, 6) AS noise_floor_min, round(mid, 6) AS noise_floor_median, round(hi, 6) AS noise_floor_max,
  (SELECT count(*) FROM pt WHERE pt.capture_id = c.capture_id AND abs(velocity) <= 0.3) AS static_output_points, (SELECT count(*) FROM pt WHERE pt.capture_id = c.capture_id) AS point_count,
  c.capture_id IN (SELECT capture_id FROM fb) AS fallback_used FROM c JOIN n USING (capture_id)""")
def _(spark, sf_dir):
    return rounded(sparse(spark, sf_dir)[1], "noise_floor_min", "noise_floor_median", "noise_floor_max", digits=6)


def sparse_dense(spark, sf_dir):
    size = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    volumes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), F.lit(0).alias("frame"), size.alias("v"))
    return sparsify_dense(volumes, SHAPE, [(d - 1.5) * 0.5 for d in range(SHAPE[0])], SPARSE, suppressed=3)


@query("sparsify_cartesian_volume_dense", SQL["sparsify_cartesian_volume"])
def _(spark, sf_dir):
    return rounded(sparse_dense(spark, sf_dir)[0], "velocity", "snr_db")


@query("sparsification_counters_dense", SQL["sparsification_counters"])
def _(spark, sf_dir):
    return rounded(sparse_dense(spark, sf_dir)[1], "noise_floor_min", "noise_floor_median", "noise_floor_max", digits=6)
