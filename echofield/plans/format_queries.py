"""Queries over wire formats, codecs, recipes, records and streams."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..operators import intervals as I, packets as P, tracking as T
from ..operators.adc import frames_from_words, words_from_bytes
from ..operators.dense import dense_range_doppler
from ..sources import codecs, radar_cfg, track_files
from ..sources.files import shared_dir
from ..streaming import records as R, trackers as ST
from . import runners
from .contracts import AdcFrame, AntennaGeometry, Fft, RangeDopplerRecipe, VirtualArray
from .cube_queries import CHAIN, COMP, KEYS, _select
from .signals import WORDS, dft_sql, r4, raw_frames, read, rounded
from .track_queries import LAG, PAIR_SPEC, PAIR_SQL, paired_clusters, shown, SCENERY, TRACKS_SQL, tracks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def le_bytes(value: Column, size: int) -> Column:
    """Hexadecimal little-endian bytes of an unsigned integer."""
    h = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def word_bytes(words: Column) -> Column:
    """Binary of an array of int16 words."""
    return F.unhex(F.array_join(F.transform(words, lambda w: le_bytes(F.pmod(w.cast("bigint"), F.lit(65536)), 2)), ""))


WORD_TEXT = "frames AS (SELECT capture_id, string_agg(w::INT::VARCHAR, ',' ORDER BY i) AS words FROM words GROUP BY ALL)"


def word_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- words and codecs


@query("adc_words_from_bytes", f"WITH {WORDS}, {WORD_TEXT} SELECT * FROM frames")
def _(spark, sf_dir):
    raw = raw_frames(spark, sf_dir).select("capture_id", word_bytes(F.col("samples")).alias("b"))
    return raw.select("capture_id", words_from_bytes(F.col("b")).alias("w")).select("capture_id", word_text("w").alias("words"))


@query("adc_frames_from_words", f"WITH {WORDS}, {WORD_TEXT} SELECT * FROM frames")
def _(spark, sf_dir):
    words = raw_frames(spark, sf_dir).select("capture_id", F.posexplode("samples").alias("word_index", "word"))
    return frames_from_words(words).select("capture_id", word_text("samples").alias("words"))


for _codec in codecs.CODECS:

    def _round_trip(spark, sf_dir, codec=_codec):
        raw = raw_frames(spark, sf_dir).select("capture_id", word_bytes(F.col("samples")).alias("b"))
        back = codecs.transform_column(codecs.transform_column(raw, "b", "encode", codec, 32), "b", "decode", codec, 32)
        return back.select("capture_id", word_text_of_bytes().alias("words"))

    query(f"adc_codec_{_codec.replace('-', '_')}", f"WITH {WORDS}, {WORD_TEXT} SELECT * FROM frames")(_round_trip)


def word_text_of_bytes() -> Column:
    return F.array_join(F.transform(words_from_bytes(F.col("b")), lambda x: x.cast("string")), ",")


@query("byte_shuffle", f"""WITH {WORDS}, x AS (SELECT capture_id, i, ((w::BIGINT + 65536) % 65536) AS u FROM words)
SELECT capture_id, string_agg(lpad(upper(printf('%x', u % 256)), 2, '0'), '' ORDER BY i) || string_agg(lpad(upper(printf('%x', u // 256)), 2, '0'), '' ORDER BY i) AS shuffled FROM x GROUP BY capture_id""")
def _(spark, sf_dir):
    raw = raw_frames(spark, sf_dir).select("capture_id", word_bytes(F.col("samples")).alias("b"))
    return raw.select("capture_id", F.hex(codecs.shuffle_expr(F.col("b"))).alias("shuffled"))


@query("frame_delta", f"""WITH {WORDS}, d AS (SELECT capture_id // 8 AS chunk, capture_id, i, w - coalesce(lag(w) OVER (PARTITION BY capture_id // 8, i ORDER BY capture_id), 0) AS d FROM words)
SELECT chunk, capture_id, i::INT AS word_index, (d - 65536 * floor(d / 65536))::BIGINT AS delta FROM d""")
def _(spark, sf_dir):
    words = raw_frames(spark, sf_dir).select(F.floor(F.col("capture_id") / 8).alias("chunk"), "capture_id", F.posexplode("samples").alias("word_index", "word"))
    out = codecs.frame_delta(words.withColumn("word", F.col("word").cast("bigint")), ["chunk"], "capture_id", "word_index", "word")
    return out.select("chunk", "capture_id", "word_index", "delta")


# --- datagrams

_HEAD = "h AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey * 65537) % 4294967296 AS packet_number, (l_suppkey * 1000003 + l_orderkey) % 281474976710656 AS byte_count, l_quantity::INT AS q FROM lineitem)"


@query("parse_packets", f"WITH {_HEAD} SELECT packet_number, byte_count, q - 32 AS first_word, 2 AS n_words, count(*) AS n FROM h GROUP BY ALL")
def _(spark, sf_dir):
    number = F.pmod(F.col("l_partkey") * 65537, F.lit(1 << 32))
    count = F.pmod(F.col("l_suppkey") * 1000003 + F.col("l_orderkey"), F.lit(1 << 48))
    first = F.col("l_quantity").cast("int") - 32
    body = F.concat(le_bytes(F.pmod(first.cast("bigint"), F.lit(65536)), 2), F.lit("0100"))
    raw = read(spark, sf_dir, "lineitem").select(F.unhex(F.concat(le_bytes(number, 4), le_bytes(count, 6), body)).alias("data"))
    out = P.parse_packets(raw)
    return out.groupBy("packet_number", "byte_count", F.col("payload")[0].cast("int").alias("first_word"), F.size("payload").alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


def split_packets(spark, sf_dir):
    """Each frame's 64 words in four datagrams that arrive out of order; numbers and byte counts wrap on the way."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p")
    rows = raw_frames(spark, sf_dir).select("capture_id", "samples", part)
    return rows.select(
        "capture_id", ((F.col("p") * 3 + F.col("capture_id")) % 4).alias("arrival"), F.pmod(F.col("p") + F.lit((1 << 32) - 2), F.lit(1 << 32)).alias("packet_number"),
        F.pmod(F.col("p") * 32 + F.lit((1 << 48) - 64), F.lit(1 << 48)).alias("byte_count"), F.slice("samples", F.col("p") * 16 + 1, 16).alias("payload"),
    )


@query("assemble_packets", f"WITH {WORDS}, {WORD_TEXT} SELECT * FROM frames")
def _(spark, sf_dir):
    return P.assemble_frames(split_packets(spark, sf_dir), (1 << 48) - 64, 4, 16).select("capture_id", word_text("samples").alias("words"))


@query("take_packets", "SELECT vec_id AS capture_id, a::BIGINT AS arrival FROM embeddings, range(2) t(a)")
def _(spark, sf_dir):
    return P.take_frame(split_packets(spark, sf_dir), 2).select("capture_id", F.col("arrival").cast("bigint").alias("arrival"))


# --- recipes

_VIRTUAL = VirtualArray(AntennaGeometry(((0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), ((0.0, 0.0, 0.0), (0.5, 0.0, 0.0))), (0, 1))
RECIPE = RangeDopplerRecipe(AdcFrame(4, 2, 4), Fft(), Fft(fftshift=True), _VIRTUAL)
_RECIPE_SQL = f"WITH {CHAIN}, {COMP} {_select('cmp', 'doppler_bin', 'virtual_rx', 'range_bin')}"


@query("adc_to_range_doppler", _RECIPE_SQL)
def _(spark, sf_dir):
    return rounded(runners.adc_to_range_doppler(raw_frames(spark, sf_dir), RECIPE).df, "re", "im")


@query("adc_to_range_doppler_dense", _RECIPE_SQL)
def _(spark, sf_dir):
    return rounded(dense_range_doppler(raw_frames(spark, sf_dir), RECIPE).long().df, "re", "im")


# --- configuration and JSON


@query("config_commands", r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations),
b AS (SELECT conv_id, turn, line_no, trim(regexp_replace(line, '[%#].*$', '')) AS line FROM l)
SELECT conv_id, turn, line_no::INT AS line_no, string_split_regex(line, '\s+')[1] AS command, len(string_split_regex(line, '\s+')) - 1 AS n_args, count(*) AS n FROM b WHERE line <> '' GROUP BY ALL""")
def _(spark, sf_dir):
    rows = radar_cfg.config_commands(read(spark, sf_dir, "conversations"), "text", ("conv_id", "turn"))
    return rows.groupBy("conv_id", "turn", "line_no", "command", F.size("args").cast("bigint").alias("n_args")).agg(F.count(F.lit(1)).alias("n"))


@query("json_contract", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def _(spark, sf_dir):
    parsed = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"}).alias("j"))
    return parsed.select("event_id", "j.k")


@query("track_records_round_trip", f"WITH {TRACKS_SQL} SELECT frame_id::BIGINT AS frame_id, track_id, {', '.join(r4(c, 6) for c in ('px', 'py', 'pz', 'vx', 'vy'))}, status FROM trk")
def _(spark, sf_dir):
    empty = F.array().cast("array<array<double>>")
    rows = tracks(spark, sf_dir).withColumns({"capture_id": F.lit("c"), "pos_cov": empty, "ext_cov": empty, "age": F.lit(1), "missed": F.lit(0)})
    back = track_files.tracks_from_records(track_files.track_records(rows))
    return rounded(back.select("frame_id", "track_id", "px", "py", "pz", "vx", "vy", "status"), "px", "py", "pz", "vx", "vy", digits=6)


@query("tlv_points", """WITH p AS (SELECT vec_id AS frame_id, i::INT AS point_idx, abs(embedding[4 * i + 1])::DOUBLE AS r, embedding[4 * i + 2]::DOUBLE AS a, embedding[4 * i + 3]::DOUBLE AS velocity, embedding[4 * i + 4]::DOUBLE AS snr FROM embeddings, range(3) t(i))
SELECT frame_id, point_idx, round(r * sin(a), 6) + 0.0 AS x, round(r * cos(a), 6) + 0.0 AS y, round(velocity, 6) + 0.0 AS velocity, round(snr, 6) + 0.0 AS snr FROM p""")
def _(spark, sf_dir):
    """Frames packed as type-length-value and parsed again."""

    def run(batches):
        for batch in batches:
            for frame, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = b"".join(struct.pack(track_files.POINT, abs(values[4 * i]), *values[4 * i + 1 : 4 * i + 4]) for i in range(3))
                data = struct.pack("<II", frame, 1) + struct.pack("<II", track_files.POINTS, len(body)) + body
                for number, points, _ in track_files.tlv_frames(data):
                    yield pa.RecordBatch.from_pydict({"path": ["t"] * len(points), "frame_id": [number] * len(points), "kind": ["point"] * len(points), "idx": pa.array(range(len(points)), pa.int32()), "values": [list(p) for p in points]})

    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "path string, frame_id bigint, kind string, idx int, values array<double>")
    return rounded(track_files.tlv_points(rows).select("frame_id", "point_idx", "x", "y", "velocity", "snr"), "x", "y", "velocity", "snr", digits=6)


# --- expressions of the trackers


@query("radial_velocity", f"WITH {TRACKS_SQL} SELECT frame_id, track_id, round(CASE WHEN px = 0 AND py = 0 THEN 0 ELSE (px * vx + py * vy) / sqrt(px * px + py * py) END, 6) + 0.0 AS v FROM trk")
def _(spark, sf_dir):
    d = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py"))
    v = F.when(d > 0, (F.col("px") * F.col("vx") + F.col("py") * F.col("vy")) / d).otherwise(0.0)
    return rounded(tracks(spark, sf_dir).select("frame_id", "track_id", v.alias("v")), "v", digits=6)


@query("scenery_filter", f"WITH {TRACKS_SQL} SELECT frame_id, track_id FROM trk WHERE (px BETWEEN 1 AND 4 AND py BETWEEN 2 AND 8) OR (px BETWEEN 5 AND 9 AND py BETWEEN 5 AND 20)")
def _(spark, sf_dir):
    return tracks(spark, sf_dir).filter(T.in_scenery_column(SCENERY, F.col("px"), F.col("py"))).select("frame_id", "track_id")


@query("live_item_interval", """WITH it AS (SELECT event_id, event_id::HUGEINT * 7 AS t, round(value)::HUGEINT AS d FROM events)
SELECT event_id, (1000 + (t * 1000000000 // 30000))::BIGINT AS start_ns, (1000 + ((t + d) * 1000000000 + 29999) // 30000)::BIGINT AS end_ns FROM it""")
def _(spark, sf_dir):
    items = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7).cast("decimal(20,0)").alias("tick"), F.round("value").cast("decimal(20,0)").alias("duration_ticks"), F.lit(1000).alias("host"))
    out = I.live_interval(items, "host", 1_000_000_000, 30_000)
    return out.select("event_id", F.col("start_ns").cast("bigint").alias("start_ns"), F.col("end_ns").cast("bigint").alias("end_ns"))


# --- streams: 25 embeddings are the frames of a stream


def stream_records(spark, sf_dir):
    """Records of well-formed, aborted (every third) and broken (every seventh: a frame is missing) streams."""
    frames = raw_frames(spark, sf_dir).select(F.floor(F.col("capture_id") / 25).alias("s"), (F.col("capture_id") % 25).alias("i"), word_bytes(F.col("samples")).alias("payload"))
    config = F.lit("cfg").cast("binary")
    whole = frames.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", F.hex("payload").alias("h")))).alias("a"), F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.unhex(F.array_join(F.transform("a", lambda x: x["h"]), "")), 256)
    sid = F.concat(F.lit("stream-"), F.col("s"))
    zeros = [F.lit(0).alias(o) for o in R.ORIGINS]
    shape = F.struct(F.col("n").alias("frame_count"), F.lit(128).alias("frame_bytes"), (F.col("n") * 128).alias("expected_bytes"), *zeros)
    end = F.when(F.col("s") % 3 == 0, "ABORT").otherwise("COMMIT")
    session = F.to_json(F.struct(sid.alias("stream_id"), shape.alias("capture"), F.struct(F.lit(3).alias("size_bytes"), F.sha2(config, 256).alias("sha256")).alias("radar_config")))
    terminal = F.to_json(F.struct(sid.alias("stream_id"), F.lower(end).alias("outcome"), F.col("n").alias("frames"), (F.col("n") * 128).alias("adc_bytes"), digest.alias("adc_sha256")))
    zero = F.lit(0).cast("bigint")
    rows = whole.select(sid.alias("stream_id"), F.explode(F.array(
        F.struct(zero.alias("sequence"), F.lit("SESSION").alias("kind"), zero.alias("item_index"), session.cast("binary").alias("payload")),
        F.struct((zero + 1).alias("sequence"), F.lit("RADAR_CONFIG").alias("kind"), zero.alias("item_index"), config.alias("payload")),
        F.struct((F.col("n") + 2).alias("sequence"), end.alias("kind"), F.col("n").alias("item_index"), terminal.cast("binary").alias("payload")),
    )).alias("r")).select("stream_id", "r.*")
    body = frames.filter(~((F.col("s") % 7 == 5) & (F.col("i") == 3))).select(sid.alias("stream_id"), (F.col("i") + 2).alias("sequence"), F.lit("FRAME").alias("kind"), F.col("i").alias("item_index"), "payload")
    return rows.unionByName(body)


_STREAMS = """st AS (SELECT vec_id // 25 AS s, count(*) AS n FROM embeddings GROUP BY ALL)"""


@query("capture_stream_outcomes", f"""WITH {_STREAMS} SELECT 'stream-' || s AS stream_id, CASE WHEN s % 7 = 5 AND n > 3 THEN 'broken' WHEN s % 3 = 0 THEN 'abort' ELSE 'commit' END AS outcome,
  CASE WHEN s % 7 = 5 AND n > 3 THEN 3 ELSE n END AS frames, 128 * CASE WHEN s % 7 = 5 AND n > 3 THEN 3 ELSE n END AS adc_bytes FROM st""")
def _(spark, sf_dir):
    return R.stream_outcomes(stream_records(spark, sf_dir)).select("stream_id", "outcome", "frames", "adc_bytes")


@query("capture_stream_committed_frames", f"""WITH {_STREAMS}, {WORDS}, {WORD_TEXT}, ok AS (SELECT s FROM st WHERE NOT (s % 7 = 5 AND n > 3) AND s % 3 <> 0)
SELECT 'stream-' || (capture_id // 25) AS stream_id, capture_id % 25 AS frame_id, words FROM frames WHERE capture_id // 25 IN (SELECT s FROM ok)""")
def _(spark, sf_dir):
    return R.committed_frames(stream_records(spark, sf_dir)).select("stream_id", "frame_id", word_text("samples").alias("words"))


_SDOP = dft_sql("rng", "dop", "chirp", "doppler_bin", [*KEYS, "rx", "range_bin"], 4, shift=True)


@query("capture_stream_range_doppler", "WITH " + CHAIN.split(", tdm AS")[0] + f", {_SDOP} SELECT 'stream-' || (capture_id // 25) AS stream_id, capture_id % 25 AS frame_id, round(sum(sqrt(re * re + im * im)), 2) AS total FROM dop WHERE NOT (capture_id // 25 % 7 = 5 AND capture_id % 25 = 3) GROUP BY ALL")
def _(spark, sf_dir):
    out = R.stream_range_doppler(stream_records(spark, sf_dir), RangeDopplerRecipe(AdcFrame(4, 2, 4)))
    size = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
    return out.select("stream_id", "frame_id", F.round(F.aggregate(size, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("causal_pairs_stream", """WITH ev AS (SELECT event_id AS id, event_type, epoch_us(ts) AS s, epoch_us(ts) + round(value * 1000)::BIGINT AS e FROM events)
SELECT a.id AS earlier_id, b.id AS later_id FROM ev a JOIN ev b ON b.s - a.e <= 600000000 AND b.e - a.s >= 0 WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def _(spark, sf_dir):
    """The stream join over the events as a finite stream, all of it in one trigger."""
    schema = read(spark, sf_dir, "events").schema

    def side(kind):
        ev = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").filter(F.col("event_type") == kind)
        ts = F.col("ts").cast("timestamp")
        start = F.unix_micros(ts) * 1000
        return ev.select(F.col("event_id").alias("id"), ts.alias("ts"), start.alias("start_ns"), (start + F.round(F.col("value") * 1000).cast("bigint") * 1000).alias("end_ns"))

    out = shared_dir(spark, "causal")
    joined = ST.causal_pairs_stream(side("click"), side("purchase"), 0, LAG * 1000, LAG * 1000, "1 hour")
    # nothing follows this stream, so the batch that would only clear its state is left out
    clearing = "spark.sql.streaming.noDataMicroBatches.enabled"
    usual = spark.conf.get(clearing)
    spark.conf.set(clearing, "false")
    try:
        run = joined.writeStream.trigger(availableNow=True).option("checkpointLocation", out + "/ck").format("parquet").option("path", out + "/rows").start()
    finally:
        spark.conf.set(clearing, usual)
    run.awaitTermination()
    return spark.read.schema("earlier_id bigint, later_id bigint").parquet(out + "/rows")


@query("kalman_lifecycle_stream", PAIR_SQL)
def _(spark, sf_dir):
    """The stateful cluster tracker over a finite stream of the same frames."""
    out = shared_dir(spark, "tracks")
    rows = paired_clusters(spark, sf_dir)
    rows.write.parquet(out + "/frames")
    tracked = ST.track_clusters_stream(spark.readStream.schema(rows.schema).parquet(out + "/frames"), PAIR_SPEC)
    tracked.writeStream.trigger(availableNow=True).option("checkpointLocation", out + "/ck").format("parquet").option("path", out + "/rows").start().awaitTermination()
    return shown(spark.read.schema(tracked.schema).parquet(out + "/rows"))
