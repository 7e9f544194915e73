"""Radar signals made of the test tables, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.adc import organize_adc_samples
from ..operators.cube import Cube, partitioned
from .contracts import AdcFrame

FRAME = AdcFrame(4, 2, 4)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exact_sum(name: str) -> Column:
    """Sum of doubles that does not depend on the order of the rows: of their decimals, where these tell every value exactly."""
    decimal = F.col(name).try_cast("decimal(38,18)")
    told = F.count_if(decimal.cast("double") == F.col(name)) == F.count(name)
    return F.coalesce(F.when(told, F.try_sum(decimal).cast("double")), F.sum(name))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ADC frame of 64 words from each embedding."""
    word = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4096 + 0.5).cast("smallint"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), word.alias("samples"))


def cells(spark: SparkSession, sf_dir: str, layout: str = "iq_interleaved") -> Cube:
    return organize_adc_samples(raw_frames(spark, sf_dir), AdcFrame(4, 2, 4, layout))


def magnitude_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """An 8 x 8 range-Doppler map, one channel, from each embedding."""
    emb = partitioned(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), "embedding"), ("capture_id",))
    rows = emb.select("capture_id", F.posexplode("embedding").alias("i", "v"))
    df = rows.select(
        "capture_id",
        F.lit(0).alias("frame"),
        F.floor(F.col("i") / 8).cast("int").alias("doppler_bin"),
        (F.col("i") % 8).alias("range_bin"),
        F.lit(0).alias("rx"),
        (F.col("v").cast("double") * 100).alias("re"),
        F.lit(0.0).alias("im"),
    )
    return Cube(df, {"doppler_bin": 8, "range_bin": 8, "rx": 1})


def daily_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, power) over the 30 days of January, 0 where a user has no event."""
    events = read(spark, sf_dir, "events").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    sums = events.groupBy("user_id", day.alias("day")).agg(F.sum("value").alias("power"))
    grid = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day"))
    return grid.join(sums, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("power", F.lit(0.0)).alias("power"))


# --- the same in SQL

WORDS = "words AS (SELECT vec_id AS capture_id, 0 AS frame, i, floor(embedding[i + 1]::DOUBLE * 4096 + 0.5) AS w FROM embeddings, range(64) t(i))"

_PLACES = {
    "iq_interleaved": ("i // 16", "(i // 8) % 2", "(i // 2) % 4", "i % 2"),
    "sample_i_then_q": ("i // 16", "i % 2", "(i % 16) // 4", "(i % 4) // 2"),
    "group2_i_then_q": ("i // 16", "(i // 8) % 2", "2 * ((i // 4) % 2) + i % 2", "(i % 4) // 2"),
    "group4_i_then_q": ("((i // 8) * 4 + i % 4) // 8", "((i // 8) * 4 + i % 4) % 2", "(((i // 8) * 4 + i % 4) % 8) // 2", "(i % 8) // 4"),
}


def cells_sql(layout: str = "iq_interleaved") -> str:
    c, r, s, part = _PLACES[layout]
    return f"""{WORDS}, cells AS (
  SELECT capture_id, frame, ({c})::INT AS chirp, ({r})::INT AS rx, ({s})::INT AS sample,
         max(CASE WHEN {part} = 0 THEN w END) AS re, max(CASE WHEN {part} = 1 THEN w END) AS im
  FROM words GROUP BY ALL)"""


MAP_SQL = """map AS (SELECT vec_id AS capture_id, 0 AS frame, (i // 8)::INT AS doppler_bin, (i % 8)::INT AS range_bin,
  abs(embedding[i + 1]::DOUBLE * 100) AS magnitude FROM embeddings, range(64) t(i))"""

DAILY_SQL = """daily AS (
  SELECT g.user_id, g.day::INT AS day, coalesce(p.power, 0.0) AS power
  FROM (SELECT DISTINCT user_id, d AS day FROM events, range(30) t(d)) g
  LEFT JOIN (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, sum(value) AS power FROM events GROUP BY ALL) p
  ON p.user_id = g.user_id AND p.day = g.day)"""


def dft_sql(src: str, out: str, axis: str, bin_: str, others: list[str], n_in: int, n: int | None = None, window: str = "none", shift: bool = False, one_sided: bool = False, dc: bool = False) -> str:
    """A CTE with the transform of CTE ``src`` along an axis."""
    n = n or n_in
    keep = ", ".join(others)
    on = " AND ".join(f"m.{o} = c.{o}" for o in others)
    k = f"((b.b + {(n + 1) // 2 if shift else 0}) % {n})"
    bins = n // 2 + 1 if one_sided else n
    ab = {"none": (1.0, 0.0), "hann": (0.5, 0.5), "hamming": (0.54, 0.46)}[window]
    w = f"({ab[0]} - {ab[1]} * cos(2 * pi() * c.{axis} / {max(1, n_in - 1)}))"
    re, im = ("(c.re - m.mre)", "(c.im - m.mim)") if dc else ("c.re", "c.im")
    mean = f"JOIN (SELECT {keep}, avg(re) AS mre, avg(im) AS mim FROM {src} GROUP BY ALL) m ON {on}" if dc else ""
    angle = f"(2 * pi() * (({k} * c.{axis}) % {n}) / {n}.0)"
    cols = ", ".join(f"c.{o}" for o in others)
    return f"""{out} AS (SELECT {cols}, b.b::INT AS {bin_},
  sum({w} * ({re} * cos{angle} + {im} * sin{angle})) AS re, sum({w} * ({im} * cos{angle} - {re} * sin{angle})) AS im
  FROM {src} c {mean} CROSS JOIN range({bins}) b(b) WHERE c.{axis} < {min(n, n_in)} GROUP BY {cols}, b.b)"""


def r4(name: str, digits: int = 4) -> str:
    return f"round(({name})::DOUBLE, {digits}) + 0.0 AS {name.split('.')[-1]}"


def sql_round(x: Column, digits: int) -> Column:
    """``round`` of a double as DuckDB does it: the nearest whole number of units of the scaled double, halves away from zero.

    Spark rounds the shortest decimal of a double instead, which falls on the other side where that decimal is half-way
    and the scaled double is not, or the other way round.
    """
    unit = float(10**digits)
    scaled = F.abs(x) * unit
    whole = F.floor(scaled)
    near = whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)
    # doubles from 2^52 on are whole, and those that overflow stay as they are
    return F.when(scaled < 2.0**52, F.signum(x) * (near / unit)).when(scaled == float("inf"), x).otherwise(F.signum(x) * (scaled / unit))


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Rounds columns and turns -0 into 0, for comparison with another engine."""
    return df.withColumns({n: sql_round(F.col(n).cast("double"), digits) + 0.0 for n in names})
