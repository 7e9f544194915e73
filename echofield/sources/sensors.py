"""Sessions of several sensors: binary item indices beside payload files.

``spark.read.format("sensor_items")`` reads an index by ranges of entries; payloads are read only if wanted.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.intervals import assert_monotone, causal_pairs, map_interval, segment_of, unwrap_ticks
from ..plans.contracts import require
from .files import read_all, read_range, regular_size, sha256_of, strict_json

# Fixed values of the format.
HEADER, HEADER_BYTES = "<8sHHHHQQ", 32
ENTRY, ENTRY_BYTES = "<QQQQQQQII", 64
NO_EVENT = (1 << 64) - 1
ITEMS = "source_id string, item_index bigint, payload_offset bigint, payload_size bigint, ticks decimal(20,0), wrap_count decimal(20,0), duration_ticks decimal(20,0), sync_event_id decimal(20,0)"
ENTRIES_PER_PARTITION = 1 << 16


class ItemsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.payload, self.source = options["path"], options.get("payload"), options.get("source_id", "")
        magic, major, header, entry, flags, self.count, self.total = struct.unpack(HEADER, read_range(self.index, 0, HEADER_BYTES))
        require(major == 1 and header == HEADER_BYTES and entry == ENTRY_BYTES and flags == 0, "unknown index header")
        require("magic" not in options or magic == options["magic"].encode(), "the index has another magic")
        require(regular_size(self.index) == HEADER_BYTES + self.count * ENTRY_BYTES, "the index has another length than declared")

    def partitions(self):
        step = ENTRIES_PER_PARTITION
        return [InputPartition((a, min(self.count, a + step))) for a in range(0, self.count, step)]

    def read(self, partition):
        first, stop = partition.value
        data = read_range(self.index, HEADER_BYTES + first * ENTRY_BYTES, (stop - first) * ENTRY_BYTES)
        rows, expected = [], None
        for i, entry in enumerate(struct.iter_unpack(ENTRY, data), first):
            item, offset, size, ticks, wraps, duration, event, flags, reserved = entry
            require(item == i and size > 0 and flags == 0 and reserved == 0, "a damaged index entry")
            require(expected is None or offset == expected, "payloads are not contiguous")
            require(i != 0 or offset == 0, "the first payload must start at 0")
            expected = offset + size
            rows.append((self.source, i, offset, size, Decimal(ticks), Decimal(wraps), Decimal(duration), None if event == NO_EVENT else Decimal(event)))
        require(stop != self.count or expected in (None, self.total), "the index does not cover the payload")
        wide = pa.decimal128(20, 0)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), wide, wide, wide, wide]
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            columns = [pa.array(c, k) for c, k in zip(zip(*part), kinds)]
            if self.payload:
                body = read_range(self.payload, part[0][2], part[-1][2] + part[-1][3] - part[0][2])
                columns.append(pa.array([body[r[2] - part[0][2] : r[2] - part[0][2] + r[3]] for r in part], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "payload"][: len(columns)])


class ItemsSource(DataSource):
    """Format ``sensor_items``: options path (the index), source_id, payload (its file, if wanted), magic."""

    @classmethod
    def name(cls):
        return "sensor_items"

    def schema(self):
        return ITEMS + (", payload binary" if self.options.get("payload") else "")

    def reader(self, schema):
        return ItemsReader(dict(self.options))


def read_items(spark: SparkSession, index: str, source_id: str, payload: str | None = None) -> DataFrame:
    spark.dataSource.register(ItemsSource)
    reader = spark.read.format("sensor_items").option("source_id", source_id)
    return (reader.option("payload", payload) if payload else reader).load(index)


def timeline(items: DataFrame, segments: DataFrame, wrap_ticks: int, semantics: str) -> DataFrame:
    """Items with the interval that their clock gives them: (source_id, id, start_ns, end_ns, ...)."""
    ticked = items.withColumn("tick", unwrap_ticks(F.col("ticks"), F.col("wrap_count"), wrap_ticks))
    mapped = map_interval(segment_of(ticked, segments), semantics)
    return mapped.withColumn("id", F.col("item_index")).select(*items.columns, "id", "start_ns", "end_ns")


# --- sessions


@dataclass(frozen=True)
class Session:
    """A published session: ``session.json`` and a folder of artifacts for each complete source."""

    path: str
    record: dict

    @property
    def session_id(self) -> str:
        return self.record["session_id"]

    def source(self, source_id: str) -> dict:
        found = [s for s in self.record["sources"] if s["source_id"] == source_id]
        require(len(found) == 1, f"no source {source_id}")
        return found[0]

    def sources(self, spark: SparkSession) -> DataFrame:
        rows = [(self.session_id, s["source_id"], s["kind"], s["required"], s["outcome"], s["item_count"], s["payload_bytes"], s["clock"]["wrap_ticks"], s["clock"]["timestamp_semantics"]) for s in self.record["sources"]]
        return spark.createDataFrame(rows, "session_id string, source_id string, kind string, required boolean, outcome string, item_count bigint, payload_bytes bigint, wrap_ticks bigint, semantics string")

    def segments(self, spark: SparkSession) -> DataFrame:
        names = ("start_unwrapped_tick", "end_unwrapped_tick", "source_origin_tick", "host_origin_ns", "scale_num", "scale_den", "uncertainty_ns")
        rows = [(s["source_id"], *[Decimal(a[n]) for n in names]) for s in self.record["sources"] for a in s["affine_segments"]]
        wide = "decimal(20,0)"
        columns = ("start_tick", "end_tick", *names[2:])
        return spark.createDataFrame(rows, ", ".join(["source_id string", *[f"{c} {wide}" for c in columns]]))

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(Decimal(e["sync_event_id"]),) for e in self.record["sync_events"]], "sync_event_id decimal(20,0)")

    def items(self, spark: SparkSession, source_id: str, payload: bool = False) -> DataFrame:
        """The source's index, with payloads only if wanted; a source that is not complete has none."""
        s = self.source(source_id)
        if s["outcome"] != "complete":
            return spark.createDataFrame([], ITEMS + (", payload binary" if payload else ""))
        folder = f"{self.path}/{source_id}"
        return read_items(spark, f"{folder}/index.bin", source_id, f"{folder}/{s['payload']['filename']}" if payload else None)

    def timeline(self, spark: SparkSession, source_id: str, payload: bool = False) -> DataFrame:
        clock = self.source(source_id)["clock"]
        semantics = "instant" if clock["timestamp_semantics"] == "delivery_observed" else clock["timestamp_semantics"]
        return timeline(self.items(spark, source_id, payload), self.segments(spark), clock["wrap_ticks"], semantics)

    def causal_pairs(self, spark: SparkSession, earlier: str, later: str, lag_min_ns: int, lag_max_ns: int, bucket_ns: int) -> DataFrame:
        """(earlier_id, later_id) item numbers of two distinct, complete sources."""
        require(earlier != later, "two distinct sources are needed")
        for s in (earlier, later):
            require(self.source(s)["outcome"] == "complete", f"{s} is not complete")
        sides = []
        for s in (earlier, later):
            rows = self.timeline(spark, s).select("id", F.col("start_ns").cast("bigint").alias("start_ns"), F.col("end_ns").cast("bigint").alias("end_ns"))
            sides.append(assert_monotone(rows, [], "id"))  # a timeline's neighbours by stretches of items
        return causal_pairs(*sides, lag_min_ns, lag_max_ns, bucket_ns)

    def check_events(self, spark: SparkSession) -> None:
        """Items name known events, as often as their source's cardinality allows; indices are counted by executors."""
        known = self.events(spark)
        counts = {s["source_id"]: {} for s in self.record["sources"]}
        for source, of_source in counts.items():
            items = self.items(spark, source).filter(F.col("sync_event_id").isNotNull()).select("sync_event_id")
            require(items.join(known, "sync_event_id", "left_anti").limit(1).count() == 0, "an item names an unknown event")
            for r in items.groupBy("sync_event_id").agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row an event
                of_source[int(r.sync_event_id)] = r.n
        check_cardinalities(self.record, counts)

    def revalidate(self, spark: SparkSession | None = None) -> None:
        check_session(self.path, self.record)
        if spark is not None:
            self.check_events(spark)


TOTALS = {
    "source_count": lambda s: len(s),
    "required_source_count": lambda s: sum(x["required"] for x in s),
    "complete_source_count": lambda s: sum(x["outcome"] == "complete" for x in s),
    "item_count": lambda s: sum(x["item_count"] for x in s),
    "payload_bytes": lambda s: sum(x["payload_bytes"] for x in s),
}


def check_session(path: str, record: dict) -> None:
    """Sizes and digests of all artifacts of complete sources."""
    for s in record["sources"]:
        for a in s["artifacts"] if s["outcome"] == "complete" else []:
            name = f"{path}/{s['source_id']}/{a['path']}"
            require(regular_size(name) == a["size_bytes"], f"{a['path']} has another size")
            require(sha256_of(name) == a["sha256"], f"{a['path']} has another digest")


U64 = (1 << 64) - 1
SEMANTICS = {"radar": ("frame_start",), "camera": ("exposure_midpoint", "delivery_observed")}


def _mapped(segment: dict, tick: int) -> int:
    """The host time of a tick times the segment's denominator; whole numbers of any length."""
    return segment["host_origin_ns"] * segment["scale_den"] + (tick - segment["source_origin_tick"]) * segment["scale_num"]


def check_clock(source: dict) -> None:
    """Observations and segments of a source: ranges, cover, order at boundaries, the domain, and delivery anchors."""
    clock, name = source["clock"], source["source_id"]
    wrap = clock["wrap_ticks"]
    require(0 <= wrap <= U64 and wrap != 1, f"{name}: a clock wraps at none or more than one tick")
    seen: dict[str, tuple[int, dict]] = {}
    for o in source.get("clock_observations", []):
        require(all(0 <= o[k] <= U64 for k in ("tick", "wrap_count", "host_before_ns", "host_after_ns")), f"{name}: an observation out of range")
        require(o["wrap_count"] == 0 if wrap == 0 else o["tick"] < wrap, f"{name}: an observation contradicts the wrap")
        require(o["host_before_ns"] <= o["host_after_ns"], f"{name}: an observation ends before it starts")
        require(o["observation_id"] not in seen, f"{name}: two observations share an id")
        seen[o["observation_id"]] = (o["wrap_count"] * wrap + o["tick"], o)
    before = None
    for s in source["affine_segments"]:
        ids, den = s["observation_ids"], s["scale_den"]
        start, end = s["start_unwrapped_tick"], s["end_unwrapped_tick"]
        require(all(0 <= s[k] <= U64 for k in ("start_unwrapped_tick", "end_unwrapped_tick", "source_origin_tick", "host_origin_ns", "uncertainty_ns")), f"{name}: a segment out of range")
        require(1 <= s["scale_num"] <= U64 and 1 <= den <= U64, f"{name}: a scale out of range")
        require(bool(ids) and len(set(ids)) == len(ids) and set(ids) <= set(seen), f"{name}: a segment needs its own, known observations")
        require(start < end, f"{name}: an empty segment")
        require(start <= s["source_origin_tick"] < end, f"{name}: an origin outside its segment")
        slack = s["uncertainty_ns"] * den
        for tick, o in (seen[i] for i in ids):
            require(start <= tick < end, f"{name}: an observation outside its segment")
            at = _mapped(s, tick)
            require(at - slack <= o["host_before_ns"] * den and at + slack >= o["host_after_ns"] * den, f"{name}: an observation that its segment's uncertainty does not cover")
        if before is not None:
            require(start >= before["end_unwrapped_tick"], f"{name}: overlapping segments")
            require(_mapped(s, start) * before["scale_den"] >= _mapped(before, before["end_unwrapped_tick"]) * den, f"{name}: time moves backwards at a segment's start")
        require(_mapped(s, start) - slack >= 0 and _mapped(s, end) + slack <= U64 * den, f"{name}: a segment leaves the unsigned 64-bit time")
        before = s
    if clock["timestamp_semantics"] == "delivery_observed":
        _check_delivery(source, seen)


def _check_delivery(source: dict, seen: dict[str, tuple[int, dict]]) -> None:
    """Sources timed on delivery map their ticks to host time as they are, from one exact anchor."""
    name, segments = source["source_id"], source["affine_segments"]
    c = source["clock"]
    require((c["clock_id"], c["tick_hz"], c["wrap_ticks"]) == (f"{name}-delivery-observed", 10**9, 0), f"{name}: delivery is counted in host nanoseconds")
    if source["item_count"] == 0:
        require(not seen and not segments, f"{name}: no item, so no clock mapping")
        return
    anchor = f"{name}-delivery-anchor"
    require(set(seen) == {anchor}, f"{name}: delivery needs its one anchor")
    tick, o = seen[anchor]
    require(o["wrap_count"] == 0 and o["host_before_ns"] == tick == o["host_after_ns"], f"{name}: an anchor that is not exact")
    require(len(segments) == 1, f"{name}: delivery has one identity segment")
    s = segments[0]
    same = all(s[k] == tick for k in ("start_unwrapped_tick", "source_origin_tick", "host_origin_ns"))
    require(same and (s["scale_num"], s["scale_den"], s["uncertainty_ns"]) == (1, 1, 0), f"{name}: delivery has one identity segment")


def check_cardinalities(record: dict, counts: dict[str, dict[int, int]]) -> None:
    """Counts of items by source and event against the sources' bounds and the session's grade."""
    events = {e["sync_event_id"] for e in record["sync_events"]}
    triggered, sets = record.get("synchronization_grade") == "external_trigger", []
    for s in record["sources"]:
        found, bounds = counts[s["source_id"]], s.get("sync_event_cardinality")
        if bounds is None:
            require(not found, "events without a cardinality")
            require(not (triggered and s["required"]), "a triggered, required source needs a cardinality")
            continue
        require(0 <= bounds["min_items"] <= bounds["max_items"] and 1 <= bounds["max_items"] <= s["limits"]["max_items"], "bad cardinality bounds")
        for event in events if bounds["required"] else found:
            require(bounds["min_items"] <= found.get(event, 0) <= bounds["max_items"], "an event's items are outside their bounds")
        if triggered and s["required"]:
            require(bounds["required"], "a triggered, required source must require its events")
            sets.append(set(found))
    require(all(x == sets[0] for x in sets), "triggered sources differ in their events")


def open_session(path: str, schema: str | None = None, with_artifacts: bool = True, spark: SparkSession | None = None) -> Session:
    """Open a session directory; without artifacts only ``session.json`` is read and checked.

    With ``spark``, the items' events are counted from the indices and held against the sources' cardinalities.
    """
    path = path.rstrip("/")
    record = strict_json(read_all(f"{path}/session.json", 1 << 20))
    require(schema is None or record.get("schema") == schema, "the session has another schema")
    sources = record["sources"]
    ids = [s["source_id"] for s in sources]
    require(bool(ids) and len(set(ids)) == len(ids), "sources must be unique")
    clocks = [record["host_clock"]["clock_id"], *[s["clock"]["clock_id"] for s in sources]]
    require(len(set(clocks)) == len(clocks), "clocks must be unique")
    host = record["host_clock"]
    require(host["tick_hz"] == 10**9 and host["wrap_ticks"] == 0, "the host clock counts nanoseconds")
    for s in sources:
        require(s["kind"] in ("radar", "camera") and s["outcome"] in ("complete", "failed", "omitted"), "unknown kind or outcome")
        require(not s["required"] or s["outcome"] == "complete", "a required source is not complete")
        require((s["item_count"] == 0) == (s["payload_bytes"] == 0), "items and bytes contradict each other")
        require(s["clock"]["timestamp_semantics"] in SEMANTICS[s["kind"]], "the kind has other timestamps")
        check_clock(s)
        require(s["item_count"] <= s["limits"]["max_items"] and s["payload_bytes"] <= s["limits"]["max_payload_bytes"], "a source beyond its limits")
    events = [e["sync_event_id"] for e in record["sync_events"]]
    require(events == sorted(set(events)), "events must be unique and increasing")
    for name, total in TOTALS.items():
        require(record["totals"][name] == total(sources), f"{name} contradicts the sources")
    if with_artifacts:
        check_session(path, record)
    session = Session(path, record)
    if spark is not None:
        session.check_events(spark)
    return session


def radar_items_with_frames(items: DataFrame, frames: DataFrame) -> DataFrame:
    """Radar items joined with the frames of their nested capture, by item number."""
    return items.join(frames.withColumnRenamed("frame_id", "item_index"), "item_index")
