"""Joins over time intervals, and clocks that map ticks to intervals.

Intervals are closed and in integers (nanoseconds). The causal join is a band join; it is run as an equi-join on
time buckets, so it is shuffled and sized like any other, and no pair is made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.contracts import require

#: Ticks and scales fill 64 bits without sign; their products need 38 digits.
WIDE = "decimal(38,0)"


def causal_match(e_start: Column, e_end: Column, l_start: Column, l_end: Column, lag_min: int, lag_max: int) -> Column:
    """Whether the possible lag between two intervals meets [lag_min, lag_max]."""
    return (l_start - e_end <= lag_max) & (l_end - e_start >= lag_min)


#: Items of one stretch of a timeline, which one task compares with their neighbours.
STRETCH = 65_536


def assert_monotone(items: DataFrame, keys: list[str], order: str, stretch: int = STRETCH) -> DataFrame:
    """The items, failing where an interval starts or ends before the one before it; ``order`` is a whole number.

    A timeline is divided into stretches of the order; each is compared within itself, and its first item with the
    last one of the stretch before. Only those last ones, one a stretch, are lined up by key.
    """
    rows = items.withColumn("__stretch", F.floor(F.col(order) / stretch))
    ends = [F.max_by(c, order).alias(f"__{c}") for c in ("start_ns", "end_ns")]
    line = Window.partitionBy(*keys).orderBy("__stretch") if keys else Window.partitionBy(F.lit(0)).orderBy("__stretch")
    last = rows.groupBy(*keys, "__stretch").agg(*ends)
    last = last.select(*keys, "__stretch", *[F.lag(f"__{c}").over(line).alias(f"__{c}") for c in ("start_ns", "end_ns")])
    w = Window.partitionBy(*keys, "__stretch").orderBy(order)
    before = {c: F.coalesce(F.lag(c).over(w), F.col(f"__{c}")) for c in ("start_ns", "end_ns")}
    back = (F.col("start_ns") < before["start_ns"]) | (F.col("end_ns") < before["end_ns"])
    checked = F.when(F.coalesce(back, F.lit(False)), F.raise_error(F.lit("mapped intervals move backwards")).cast("boolean")).otherwise(F.lit(True))
    return rows.join(last, [*keys, "__stretch"]).withColumn("__ok", checked).filter("__ok").select(*items.columns)


def causal_pairs(earlier: DataFrame, later: DataFrame, lag_min: int, lag_max: int, bucket_ns: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of (id, start_ns, end_ns) rows whose possible lag meets the window; (keys..., earlier_id, later_id).

    A later interval meets the earlier one widened to [start + lag_min, end + lag_max]. Both are laid into
    buckets and joined on them; a pair is kept only in the first bucket that both share. Choose buckets near the
    widened length: shorter ones repeat rows, longer ones compare more pairs.
    """
    require(lag_min <= lag_max and bucket_ns > 0, "the lag window or the bucket is empty")
    bucket = lambda t: F.floor(t / F.lit(bucket_ns).cast("decimal(20,0)")).cast("bigint")
    lo, hi = F.col("start_ns") + lag_min, F.col("end_ns") + lag_max
    # a widened interval that is empty is met by any interval that covers it, which then covers its lower end
    first = bucket(F.least(lo, hi))
    last = F.when(lo <= hi, bucket(hi)).otherwise(first)
    e = earlier.select(
        *keys, F.col("id").alias("earlier_id"), F.col("start_ns").alias("e_start"), F.col("end_ns").alias("e_end"),
        first.alias("e_first"), F.explode(F.sequence(first, last)).alias("bucket"),
    )
    b0, b1 = bucket(F.col("start_ns")), bucket(F.col("end_ns"))
    l = later.select(  # noqa: E741
        *keys, F.col("id").alias("later_id"), F.col("start_ns").alias("l_start"), F.col("end_ns").alias("l_end"),
        b0.alias("l_first"), F.explode(F.sequence(b0, b1)).alias("bucket"),
    )
    met = causal_match(F.col("e_start"), F.col("e_end"), F.col("l_start"), F.col("l_end"), lag_min, lag_max)
    once = F.col("bucket") == F.greatest("e_first", "l_first")
    return e.join(l, [*keys, "bucket"]).filter(met & once).select(*keys, "earlier_id", "later_id")


# --- clocks


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a quotient of whole decimals, exact."""
    q = F.call_function("div", a, b).cast(WIDE)
    r = a - q * b
    return F.when((r != 0) & ((r < 0) != (b < 0)), q - 1).otherwise(q).cast(WIDE)


def ceil_div(a: Column, b: Column) -> Column:
    return (-floor_div(-a, b)).cast(WIDE)


def unwrap_ticks(ticks: Column, wraps: Column, wrap_ticks: int) -> Column:
    """wraps * wrap_ticks + ticks; a clock without wrap must not have wrapped."""
    t, w = ticks.cast(WIDE), wraps.cast(WIDE)
    if wrap_ticks == 0:
        return F.when(w == 0, t).otherwise(F.raise_error(F.lit("a clock without wrap has wrapped")).cast(WIDE))
    n = F.lit(wrap_ticks).cast("decimal(20,0)")
    return F.when(t < n, w * n + t).otherwise(F.raise_error(F.lit("a tick beyond the wrap")).cast(WIDE)).cast(WIDE)


def nominal(tick: Column, s: str = "") -> Column:
    """host_origin * den + (tick - origin) * num of a segment's columns."""
    c = lambda name: F.col(s + name).cast("decimal(20,0)")
    return (c("host_origin_ns") * c("scale_den") + (tick.cast("decimal(20,0)") - c("source_origin_tick")) * c("scale_num")).cast(WIDE)


def segment_of(items: DataFrame, segments: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Items with the columns of the one segment whose [start_tick, end_tick) holds their ``tick``.

    A clock's segments (at most some thousand) travel as one array, in which each item finds its own: a plain
    equi-join, no row is made twice. None or two segments for an item is an error.
    """
    names = [c for c in segments.columns if c not in keys]
    clocks = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__segments"))
    tick = F.col("tick")
    hit = F.filter("__segments", lambda s: (tick >= s["start_tick"]) & (tick < s["end_tick"]))
    rows = items.join(clocks, list(keys), "left").withColumn("__hit", hit)
    one = F.when(F.size("__hit") == 1, F.col("__hit")).otherwise(F.raise_error(F.lit("a tick without its one clock segment")))
    return rows.withColumn("__hit", one[0]).select(*items.columns, *[F.col("__hit")[c].alias(c) for c in names])


def map_interval(items: DataFrame, semantics: str = "frame_start") -> DataFrame:
    """Adds start_ns and end_ns from tick, duration_ticks and a segment's columns, rounded outwards."""
    require(semantics in ("frame_start", "exposure_midpoint", "instant"), f"unknown semantics {semantics}")
    den = F.col("scale_den").cast("decimal(20,0)")
    u = F.col("uncertainty_ns").cast("decimal(20,0)")
    at = nominal(F.col("tick"))
    span = (F.col("duration_ticks").cast("decimal(20,0)") * F.col("scale_num").cast("decimal(20,0)")).cast(WIDE)
    instant = F.col("duration_ticks") == 0 if semantics != "instant" else F.lit(True)
    if semantics == "exposure_midpoint":
        two = (den * 2).cast("decimal(21,0)")
        start, end = floor_div((at * 2 - span).cast(WIDE), two), ceil_div((at * 2 + span).cast(WIDE), two)
    else:
        start, end = floor_div(at, den), ceil_div((at + span).cast(WIDE), den)
    return items.withColumns({
        "start_ns": F.when(instant, floor_div(at, den)).otherwise(start) - u,
        "end_ns": F.when(instant, ceil_div(at, den)).otherwise(end) + u,
    })


def _wide_product(a: Column, b: Column) -> tuple[Column, Column]:
    """(high, low) of a product of two unsigned 64-bit numbers, which may have 39 digits, in base 10^10."""
    base = F.lit(10**10).cast("decimal(20,0)")
    high, low = F.call_function("div", b, base).cast("decimal(20,0)"), (b % base).cast("decimal(20,0)")
    lower = (a * low).cast(WIDE)
    carried = F.call_function("div", lower, base).cast(WIDE)
    return ((a * high).cast(WIDE) + carried).cast(WIDE), (lower - carried * base).cast(WIDE)


def validate_segments(segments: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """The segments with ``problem``: null, or why a segment contradicts itself or the one before it.

    Times at a boundary are compared exactly: whole nanoseconds first, then the fractions crosswise.
    """
    w = Window.partitionBy(*keys).orderBy("start_tick", "end_tick")
    den = F.col("scale_den").cast("decimal(20,0)")

    def mapped(tick: str) -> tuple[Column, Column]:
        d = lambda name: F.col(name).cast("decimal(20,0)")
        moved = ((d(tick) - d("source_origin_tick")) * d("scale_num")).cast(WIDE)
        whole = floor_div(moved, den)
        return (d("host_origin_ns") + whole).cast(WIDE), (moved - whole * den).cast("decimal(20,0)")

    made = {"__den": den}
    for name, tick in (("start", "start_tick"), ("end", "end_tick")):
        made[f"__{name}"], made[f"__{name}_rest"] = mapped(tick)
    rows = segments.withColumns(made)
    prev = {c: F.lag(c).over(w) for c in ("end_tick", "__end", "__end_rest", "__den")}
    here, there = _wide_product(F.col("__start_rest"), prev["__den"]), _wide_product(prev["__end_rest"], F.col("__den"))
    less = (here[0] < there[0]) | ((here[0] == there[0]) & (here[1] < there[1]))
    backwards = (F.col("__start") < prev["__end"]) | ((F.col("__start") == prev["__end"]) & less)
    problem = (
        F.when(F.col("start_tick") >= F.col("end_tick"), "empty")
        .when(~F.col("source_origin_tick").between(F.col("start_tick"), F.col("end_tick") - 1), "origin outside")
        .when(F.col("start_tick") < prev["end_tick"], "overlap")
        .when(backwards, "moves backwards")
    )
    return rows.withColumn("problem", problem).drop(*made)


def accepted_items(items: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("session_id", "source_id")) -> DataFrame:
    """Items that a commit covers: their source ended complete, with more items than their index."""
    done = ends.filter(F.col("outcome") == "complete").select(*keys, F.col("item_count").alias("__count"))
    return items.join(done, list(keys)).filter(F.col("item_index") < F.col("__count")).select(items.columns)


def event_cardinality(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """(source_id, sync_event_id, n) outside the (minimum, maximum) of (source_id, required, minimum, maximum).

    Required sources are held against every event of the session, others against their own events.
    """
    counts = items.filter(F.col("sync_event_id").isNotNull()).groupBy("source_id", "sync_event_id").agg(F.count(F.lit(1)).alias("n"))
    # a session has some ten sources; each event is held against the required ones it lacks
    required = F.array(*[F.lit(r.source_id) for r in bounds.filter("required").select("source_id").distinct().collect()]).cast("array<string>")
    lacking = counts.groupBy("sync_event_id").agg(F.collect_set("source_id").alias("found"))
    lacking = lacking.select(F.explode(F.array_except(required, "found")).alias("source_id"), "sync_event_id")
    wanted = lacking.unionByName(counts.select("source_id", "sync_event_id"))
    full = wanted.join(counts, ["source_id", "sync_event_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.join(bounds, "source_id").filter(~F.col("n").between(F.col("minimum"), F.col("maximum"))).select("source_id", "sync_event_id", "n")


def live_interval(items: DataFrame, host_start_ns: str, num: int, den: int) -> DataFrame:
    """Intervals of live items: a start instant plus ticks at a rational rate, rounded outwards."""
    at = (F.col("tick").cast("decimal(20,0)") * F.lit(num).cast("decimal(18,0)")).cast(WIDE)
    end = ((F.col("tick") + F.col("duration_ticks")).cast("decimal(20,0)") * F.lit(num).cast("decimal(18,0)")).cast(WIDE)
    d = F.lit(den).cast("decimal(18,0)")
    return items.withColumns({"start_ns": F.col(host_start_ns) + floor_div(at, d), "end_ns": F.col(host_start_ns) + ceil_div(end, d)})
