"""Files, archives, codecs and streams: round trips and damage."""

import hashlib
import io
import json
import os
import struct

import numpy as np
import pytest

from echofield.plans import presets
from echofield.plans.contracts import AdcFrame, RangeDopplerRecipe
from echofield.sources import adc_archive, adc_files, codecs, radar_cfg, sensors, track_files
from echofield.sources.files import strict_json
from echofield.streaming import records as R, sensor_stream as S

CFG = """% a comment
flushCfg
dfeDataOutputMode 1
channelCfg 15 5 0
adcCfg 2 1
adcbufCfg -1 0 1 1 1
profileCfg 0 60 10 6 60 0 0 30 1 8 4400 0 0 30
chirpCfg 0 0 0 0 0 0 0 1
chirpCfg 1 1 0 0 0 0 0 4 # the second
frameCfg 0 1 4 0 100 1 0
lvdsStreamCfg -1 0 1 0
unknownCfg 1 2 3
"""


@pytest.fixture(scope="module")
def capture_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("capture")
    contract = radar_cfg.parse_capture(CFG, "group2_i_then_q", "xwr68xx")
    words = np.random.default_rng(1).integers(-3000, 3000, contract.adc.words * 5).astype("<i2")
    (d / "adc.bin").write_bytes(words.tobytes())
    (d / "radar.cfg").write_text(CFG)
    manifest = {
        "hardware": {"family": "xwr68xx"},
        "adc": {"path": "adc.bin", "size_bytes": len(words) * 2, "sha256": hashlib.sha256(words.tobytes()).hexdigest()},
        "radar_config": {"path": "radar.cfg", "sha256": hashlib.sha256(CFG.encode()).hexdigest()},
    }
    (d / "capture.json").write_text(json.dumps(manifest))
    return str(d), contract, words


def test_config(capture_dir):
    _, c, _ = capture_dir
    assert c.adc == AdcFrame(8, 4, 8, "group2_i_then_q") and c.tx_order == (0, 2) and c.frame_periodicity_s == 0.1 and c.num_frames is None


@pytest.mark.parametrize("old,new", [
    ("adcCfg 2 1", "adcCfg 1 1"), ("channelCfg 15 5 0", "channelCfg 5 5 0"), ("chirpCfg 1 1 0 0 0 0 0 4", "chirpCfg 1 1 0 0 0 0 0 1"),
    ("chirpCfg 1 1 0 0 0 0 0 4", "chirpCfg 1 1 0 0 0 0 0 2"), ("chirpCfg 1 1 0", "chirpCfg 0 1 0"), ("frameCfg 0 1 4", "frameCfg 0 2 4"), ("profileCfg 0 60", "profileCfg 0 77"),
    ("flushCfg", "adcCfg 2 1\nflushCfg"), ("lvdsStreamCfg -1 0 1 0", ""), ("unknownCfg", "advFrameCfg"), ("frameCfg 0 1 4 0 100 1 0", "frameCfg 0 1 4 0 100 1"),
])
def test_config_contradictions(old, new):
    with pytest.raises(ValueError):
        radar_cfg.parse_capture(CFG.replace(old, new), "group2_i_then_q", "xwr68xx")


def test_config_table(spark):
    rows = radar_cfg.config_commands(spark.createDataFrame([("p", CFG)], "path string, value string")).orderBy("line_no").collect()
    assert [r.command for r in rows] == [c.name for c in radar_cfg.commands_of(CFG)]
    assert rows[-3].args == ["0", "1", "4", "0", "100", "1", "0"]


def test_capture_directory(spark, capture_dir, tmp_path):
    path, contract, words = capture_dir
    c = adc_files.open_capture(path)
    n = contract.adc.words
    rows = c.frames(spark, 1, 3).orderBy("frame_id").collect()
    assert [r.frame_id for r in rows] == [1, 2] and rows[0].samples == words[n : 2 * n].tolist() and rows[1].ts == 0.2
    rd = c.range_doppler(spark, RangeDopplerRecipe(contract.adc, virtual=presets.virtual_array(tx_order=(0, 2))), 0, 1)
    assert rd.df.count() == 4 * 8 * 8
    c.revalidate()
    assert adc_files.load_adc_file(spark, c.adc_path).first().samples == words.tolist()
    bad = tmp_path / "bad"
    os.mkdir(bad)
    for name in ("adc.bin", "radar.cfg", "capture.json"):
        data = open(f"{path}/{name}", "rb").read()
        (bad / name).write_bytes(data[:-1] + b"x" if name == "adc.bin" else data)
    with pytest.raises(ValueError, match="digest"):
        adc_files.open_capture(str(bad))
    assert adc_files.open_capture(str(bad), with_adc=False).num_frames == 5


def test_archive(spark, capture_dir, tmp_path):
    path, contract, words = capture_dir
    out = str(tmp_path / "a.arc")
    a = adc_archive.write_archive(f"{path}/adc.bin", out, contract, expected_sha256=hashlib.sha256(words.tobytes()).hexdigest())
    n = contract.adc.words
    with pytest.raises(ValueError):
        a.read_frames(0, 1, verify=False)
    a.verify_all()
    assert a.read_frames(0, 5, verify=False) == words.tobytes()
    rows = adc_archive.read_archive(spark, out).filter("frame_id >= 3").orderBy("frame_id").collect()
    assert [r.frame_id for r in rows] == [3, 4] and rows[1].samples == words[4 * n :].tolist()
    with pytest.raises(FileExistsError):
        adc_archive.write_archive(f"{path}/adc.bin", out, contract)
    assert os.listdir(tmp_path) == ["a.arc"]
    data = open(out, "rb").read()
    for at in (10, 120, len(data) - 300, len(data) - 20, 700):
        damaged = tmp_path / f"d{at}"
        damaged.write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises((ValueError, Exception)):
            adc_archive.Archive(str(damaged)).verify_all()
    cut = tmp_path / "cut"
    cut.write_bytes(data[:-1])
    with pytest.raises(ValueError):
        adc_archive.Archive(str(cut))


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codecs(codec):
    data = np.random.default_rng(0).integers(-9, 9, 96).astype("<i2").tobytes()
    for size in (32, 64, 192):
        chunk = data[: max(size, 64)] if len(data) % size == 0 else data
        assert codecs.decode(codecs.encode(chunk, codec, size), codec, size) == chunk
    with pytest.raises(ValueError):
        codecs.encode(data, "other", 32)


def test_codec_damage():
    stored = codecs.encode(bytes(64), "shuffle-zlib", 64)
    for bad in (stored[:-1], stored + b"x"):
        with pytest.raises(Exception):
            codecs.decode(bad, "shuffle-zlib", 64)
    with pytest.raises(ValueError):
        codecs.decode(b"", "adaptive-shuffle-zlib", 64)
    first = np.random.default_rng(1).integers(-9000, 9000, 512)
    drift = np.concatenate([first + 3 * i for i in range(4)]).astype("<i2").tobytes()
    assert codecs.encode(drift, "adaptive-shuffle-zlib", 1024)[0] == codecs.DELTA
    assert codecs.encode(drift[:1024], "adaptive-shuffle-zlib", 1024)[0] == codecs.PLAIN


def test_sensor_index(spark, tmp_path):
    index = struct.pack(sensors.HEADER, b"ANYMAGIC", 1, 32, 64, 0, 2, 9)
    index += struct.pack(sensors.ENTRY, 0, 0, 4, 10, 0, 1, sensors.NO_EVENT, 0, 0) + struct.pack(sensors.ENTRY, 1, 4, 5, 20, 0, 0, 7, 0, 0)
    (tmp_path / "i").write_bytes(index)
    (tmp_path / "p").write_bytes(b"abcdefghi")
    rows = sensors.read_items(spark, str(tmp_path / "i"), "s", str(tmp_path / "p")).orderBy("item_index").collect()
    assert [bytes(r.payload) for r in rows] == [b"abcd", b"efghi"] and rows[0].sync_event_id is None and rows[1].sync_event_id == 7
    (tmp_path / "j").write_bytes(index[:-1])
    with pytest.raises(Exception, match="length"):
        sensors.read_items(spark, str(tmp_path / "j"), "s").collect()


def test_strict_json():
    for bad in (b'{"a":1,"a":2}', b'{"a":NaN}', b"[1]"):
        with pytest.raises(ValueError):
            strict_json(bad)


def test_tlv(spark, tmp_path):
    data = struct.pack("<II", 1, 2) + struct.pack("<II", 6, 16) + struct.pack("<4f", 1, 0, 0.5, 10) + struct.pack("<II", 9, 2) + b"zz" + struct.pack("<II", 2, 0)
    (tmp_path / "t").write_bytes(data)
    points = track_files.tlv_points(track_files.read_tlv(spark, str(tmp_path / "t"))).orderBy("frame_id").collect()
    assert [(p.frame_id, p.point_idx, p.y) for p in points] == [(1, 0, 1.0), (2, None, None)]
    for bad in (data[:-1], data[:20], struct.pack("<II", 1, 2) + struct.pack("<II", 9, 0) * 2):
        with pytest.raises(ValueError):
            list(track_files.tlv_frames(bad))


# --- streams


def stream(frames=3, terminal=R.COMMIT, **changes):
    body = [bytes([i]) * 64 for i in range(frames)]
    session = {"stream_id": "a", "capture": {"frame_count": 3, "frame_bytes": 64, "expected_bytes": 192} | dict.fromkeys(R.ORIGINS, 0), "radar_config": {"size_bytes": 3, "sha256": hashlib.sha256(b"cfg").hexdigest()}}
    end = {"stream_id": "a", "outcome": R.NAMES[terminal].lower(), "frames": frames, "adc_bytes": 64 * frames, "adc_sha256": hashlib.sha256(b"".join(body)).hexdigest(), "reason_code": "cancelled"} | changes
    out = [R.Record(R.SESSION, 0, 0, json.dumps(session).encode()), R.Record(R.CONFIG, 1, 0, b"cfg")]
    out += [R.Record(R.FRAME, 2 + i, i, f) for i, f in enumerate(body)]
    return [*out, R.Record(terminal, 2 + frames, frames, json.dumps(end).encode())]


def read(records, tail=b"", damage=None):
    data = bytearray(b"".join(map(R.pack_record, records)) + tail)
    if damage is not None:
        data[damage] ^= 1
    s = R.CaptureStream(io.BytesIO(bytes(data)))
    s.contract()
    return [i for i, _ in s.frames()], s.require_commit()


def test_stream():
    assert read(stream())[0] == [0, 1, 2]


@pytest.mark.parametrize("records,tail,damage", [
    (stream(2), b"", None), (stream(adc_bytes=1), b"", None), (stream(stream_id="b"), b"", None), (stream(outcome="abort"), b"", None), (stream(), b"x", None), (stream(), b"", 500), (stream()[:-1], b"", None),
    ([stream()[0], *stream()[2:]], b"", None), ([*stream()[:3], stream()[2], *stream()[3:]], b"", None),
])
def test_stream_damage(records, tail, damage):
    with pytest.raises(R.StreamError):
        read(records, tail, damage)


def test_stream_binds_its_command_file():
    cfg = CFG.replace("frameCfg 0 1 4 0", "frameCfg 0 1 4 3").encode()
    size = 2 * radar_cfg.parse_capture(cfg.decode(), "group2_i_then_q", "xwr68xx").adc.words
    for frame_bytes in (size, size + 2):
        shape = {"frame_count": 3, "frame_bytes": frame_bytes, "expected_bytes": 3 * frame_bytes} | dict.fromkeys(R.ORIGINS, 0)
        head = {"stream_id": "a", "capture": shape, "adc": {"layout": "group2_i_then_q"}, "hardware": {"family": "xwr68xx"}, "radar_config": {"size_bytes": len(cfg), "sha256": hashlib.sha256(cfg).hexdigest()}}
        data = R.pack_record(R.Record(R.SESSION, 0, 0, json.dumps(head).encode())) + R.pack_record(R.Record(R.CONFIG, 1, 0, cfg))
        s = R.CaptureStream(io.BytesIO(data))
        s.contract()
        if frame_bytes == size:
            assert s.radar_capture().num_frames == 3
        else:
            with pytest.raises(R.StreamError):
                s.radar_capture()


def test_stream_abort():
    with pytest.raises(R.StreamAborted, match="cancelled"):
        read(stream(2, R.ABORT))


def test_growing_stream_is_published_once(spark, tmp_path):
    data = b"".join(map(R.pack_record, stream()))
    path = tmp_path / "s.bin"
    path.write_bytes(data[:400])
    source = R.read_record_stream(spark, str(path))
    q = R.publish_commits(source, f"{tmp_path}/stage", f"{tmp_path}/out", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    assert not os.path.exists(tmp_path / "out")
    path.write_bytes(data)
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("frame_id").collect()
    assert [(r.frame_id, r.provisional) for r in rows] == [(0, False), (1, False), (2, False)]


def test_ended_streams_leave_the_staging(spark, tmp_path):
    """A published stream's records go with the next epoch; another stream's stay, and an aborted one's are not published."""
    source = tmp_path / "in"
    os.mkdir(source)
    schema = "stream_id string, sequence bigint, kind string, item_index bigint, payload binary"
    one = [(name, r.sequence, R.NAMES[r.kind], r.item, bytes(r.payload)) for name in ("a=1/x", "b") for r in stream()]
    parts = [one[: len(one) // 2 + 2], one[len(one) // 2 + 2 :], [("c", 0, "FRAME", 0, b"")]]
    q = R.publish_commits(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), f"{tmp_path}/stage", f"{tmp_path}/out", f"{tmp_path}/ck").start()
    names = lambda: sorted(x for x in os.listdir(tmp_path / "stage" / "records") if x.startswith("stream_id="))
    seen = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/made{i}")
        file = next(x for x in os.listdir(tmp_path / f"made{i}") if x.startswith("part-"))
        os.replace(tmp_path / f"made{i}" / file, source / f"{i}.parquet")
        q.processAllAvailable()
        seen.append(names())
    q.stop()
    # the first epoch ends the first stream, the second one the other
    assert len(seen[0]) == 2 and seen[1:] == [["stream_id=b"], ["stream_id=c"]]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.stream_id, r.frame_id) for r in got.collect()) == [(name, i) for name in ("a=1/x", "b") for i in range(3)]


LIMITS = {"max_items": 10, "max_item_bytes": 100, "max_payload_bytes": 1000}
SOURCES = [
    {"source_id": "radar-0", "kind": "radar", "required": True, "limits": LIMITS, "clock": {"timestamp_semantics": "frame_start", "tick_hz": 1000, "wrap_ticks": 100}},
    {"source_id": "cam", "kind": "camera", "required": False, "limits": LIMITS, "clock": {"timestamp_semantics": "delivery_observed", "tick_hz": 10**9, "wrap_ticks": 0}},
]


def item(source, index, tick, wraps=0, duration=0):
    return {"source_id": source, "item_index": index, "provisional": True, "tick": tick, "wrap_count": wraps, "duration_ticks": duration, "sync_event_id": S.NO_EVENT}


def end(source, outcome, body):
    return {"source_id": source, "outcome": outcome, "item_count": 1, "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest()}


def session():
    return [
        ("SESSION", {"session_id": "x", "sources": SOURCES}, b""),
        ("RADAR_CONFIG", {"source_id": "radar-0", "size_bytes": 3, "sha256": hashlib.sha256(b"cfg").hexdigest()}, b"cfg"),
        ("RADAR_START", {"source_id": "radar-0", "host_lower_ns": 1000, "host_upper_ns": 1010}, b""),
        ("ITEM", item("radar-0", 0, 5, 1, 2), b"aa"),
        ("ITEM", item("cam", 0, 77), b"b"),
        ("END", end("radar-0", "complete", b"aa"), b""),
        ("END", end("cam", "failed", b"b"), b""),
        ("COMMIT", {"session_id": "x"}, b""),
        ("EOF", {"session_id": "x"}, b""),
    ]


def read_session(records):
    s = S.SensorStream(io.BytesIO(b"".join(S.pack(k, i, m, p) for i, (k, m, p) in enumerate(records))))
    s.contract()
    return s, list(s.items())


def test_sensor_stream(spark):
    s, items = read_session(session())
    s.require_commit()
    assert [(i["start_ns"], i["end_ns"], s.machine.accepts(i)) for i in items] == [(105001000, 107001010, True), (77, 77, False)]
    kept = S.committed_items(S.items_table(spark, items), s.machine).collect()
    assert [r.source_id for r in kept] == ["radar-0"]


@pytest.mark.parametrize("change", [
    lambda r: r.pop(2), lambda r: r.pop(5), lambda r: r.insert(5, r[3]), lambda r: r.append(r[-1]), lambda r: r[5][1].update(item_count=2),
    lambda r: r[3][1].update(provisional=False), lambda r: r[3][1].update(tick=100), lambda r: r[5][1].update(outcome="failed"), lambda r: r.insert(6, r.pop(4)),
])
def test_sensor_stream_damage(change):
    records = session()
    change(records)
    with pytest.raises(R.StreamError):
        read_session(records)


# --- sessions and chunks


def segment(start, end, observations, **more):
    return {"start_unwrapped_tick": start, "end_unwrapped_tick": end, "source_origin_tick": start, "host_origin_ns": start, "scale_num": 1, "scale_den": 1, "observation_ids": observations, "uncertainty_ns": 0} | more


def observation(name, tick, **more):
    return {"observation_id": name, "tick": tick, "wrap_count": 0, "host_before_ns": tick, "host_after_ns": tick} | more


@pytest.fixture
def session_dir(tmp_path):
    """A radar whose clock has two segments, and a camera timed on delivery; items 0 and 2 of both carry event 7."""
    sources = []
    for name, kind, ticks, duration in (("radar-0", "radar", (0, 100, 200), 50), ("cam", "camera", (60, 140, 900), 0)):
        os.mkdir(tmp_path / name)
        body = b"".join(bytes([i]) * 3 for i in range(3))
        index = struct.pack(sensors.HEADER, b"ANYMAGIC", 1, 32, 64, 0, 3, 9)
        for i, t in enumerate(ticks):
            index += struct.pack(sensors.ENTRY, i, 3 * i, 3, t, 0, duration, sensors.NO_EVENT if i == 1 else 7, 0, 0)
        artifacts = []
        for role, file, data in (("index", "index.bin", index), ("payload", "p.bin", body)):
            (tmp_path / name / file).write_bytes(data)
            artifacts.append({"role": role, "path": file, "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        radar = kind == "radar"
        sources.append({
            "source_id": name, "kind": kind, "required": radar, "outcome": "complete", "item_count": 3, "payload_bytes": 9, "artifacts": artifacts,
            "limits": {"max_items": 9, "max_payload_bytes": 99}, "payload": {"filename": "p.bin", "format": "raw"},
            "sync_event_cardinality": {"required": True, "min_items": 1, "max_items": 2},
            "clock": {"clock_id": name + ("-clock" if radar else "-delivery-observed"), "tick_hz": 10**9, "wrap_ticks": 0, "timestamp_semantics": "frame_start" if radar else "delivery_observed"},
            "clock_observations": [observation("a", 10), observation("b", 150, host_before_ns=149, host_after_ns=151)] if radar else [observation("cam-delivery-anchor", 60)],
            "affine_segments": [segment(0, 130, ["a"]), segment(130, 1000, ["b"], uncertainty_ns=1)] if radar else [segment(60, 1000, ["cam-delivery-anchor"])],
        })
    record = {
        "session_id": "x", "host_clock": {"clock_id": "host", "tick_hz": 10**9, "wrap_ticks": 0}, "sources": sources, "sync_events": [{"sync_event_id": 7}], "synchronization_grade": "external_trigger",
        "totals": {"source_count": 2, "required_source_count": 1, "complete_source_count": 2, "item_count": 6, "payload_bytes": 18},
    }
    (tmp_path / "session.json").write_text(json.dumps(record))
    return tmp_path


def test_session(spark, session_dir):
    s = sensors.open_session(str(session_dir), spark=spark)
    pairs = s.causal_pairs(spark, "radar-0", "cam", 0, 20, 64).collect()
    assert {(r.earlier_id, r.later_id) for r in pairs} == {(0, 0), (1, 1)}
    assert s.sources(spark).count() == 2 and s.items(spark, "cam", payload=True).count() == 3
    with pytest.raises(ValueError):
        s.causal_pairs(spark, "cam", "cam", 0, 1, 1)
    s.revalidate(spark)
    joined = sensors.radar_items_with_frames(s.items(spark, "radar-0"), spark.range(2).withColumnRenamed("id", "frame_id"))
    assert joined.count() == 2


def test_session_damage(session_dir):
    (session_dir / "cam" / "p.bin").write_bytes(b"x" * 9)
    with pytest.raises(ValueError, match="digest"):
        sensors.open_session(str(session_dir))
    assert sensors.open_session(str(session_dir), with_artifacts=False).session_id == "x"
    record = json.loads((session_dir / "session.json").read_text())
    record["totals"]["item_count"] = 5
    (session_dir / "session.json").write_text(json.dumps(record))
    with pytest.raises(ValueError, match="item_count"):
        sensors.open_session(str(session_dir), with_artifacts=False)


RADAR, CAM = 0, 1
BIG = (1 << 64) - 1
CLOCK_DAMAGE = [
    (lambda s: s[RADAR]["affine_segments"][0].update(end_unwrapped_tick=0), "empty"),
    (lambda s: s[RADAR]["affine_segments"][0].update(source_origin_tick=130), "origin outside"),
    (lambda s: s[RADAR]["affine_segments"][1].update(start_unwrapped_tick=129), "overlapping"),
    (lambda s: s[RADAR]["affine_segments"][1].update(host_origin_ns=129, uncertainty_ns=2), "backwards"),
    (lambda s: s[RADAR]["affine_segments"][1].update(host_origin_ns=BIG, uncertainty_ns=BIG), "64-bit"),
    (lambda s: s[RADAR]["affine_segments"][1].update(uncertainty_ns=0), "does not cover"),
    (lambda s: s[RADAR]["affine_segments"][0].update(observation_ids=["b"]), "observation outside"),
    (lambda s: s[RADAR]["affine_segments"][0].update(observation_ids=[]), "known observations"),
    (lambda s: s[RADAR]["affine_segments"][0].update(observation_ids=["nobody"]), "known observations"),
    (lambda s: s[RADAR]["affine_segments"][0].update(scale_den=0), "scale"),
    (lambda s: s[RADAR]["clock_observations"][0].update(host_before_ns=11), "before it starts"),
    (lambda s: s[RADAR]["clock_observations"][0].update(wrap_count=1), "wrap"),
    (lambda s: s[RADAR]["clock_observations"].append(observation("a", 11)), "share an id"),
    (lambda s: s[RADAR]["clock"].update(wrap_ticks=1), "wraps"),
    (lambda s: s[RADAR]["clock"].update(timestamp_semantics="exposure_midpoint"), "other timestamps"),
    (lambda s: s[CAM]["clock"].update(tick_hz=1000), "host nanoseconds"),
    (lambda s: s[CAM]["clock"].update(clock_id="cam-clock"), "host nanoseconds"),
    (lambda s: s[CAM]["affine_segments"][0].update(scale_num=2), "identity"),
    (lambda s: s[CAM]["affine_segments"].append(segment(1000, 1001, ["cam-delivery-anchor"])), "observation outside"),
    (lambda s: s[CAM]["clock_observations"].append(observation("other", 61)), "one anchor"),
    (lambda s: s[CAM]["clock_observations"][0].update(host_after_ns=61) or s[CAM]["affine_segments"][0].update(uncertainty_ns=1), "not exact"),
    (lambda s: s[CAM].update(item_count=0, payload_bytes=0), "no item"),
]


@pytest.mark.parametrize("case", range(len(CLOCK_DAMAGE)))
def test_session_clock_damage(session_dir, case):
    change, why = CLOCK_DAMAGE[case]
    record = json.loads((session_dir / "session.json").read_text())
    change(record["sources"])
    (session_dir / "session.json").write_text(json.dumps(record))
    with pytest.raises(ValueError, match=why):
        sensors.open_session(str(session_dir), with_artifacts=False)


EVENT_DAMAGE = [
    (lambda r: r["sources"][RADAR]["sync_event_cardinality"].update(max_items=1), "outside their bounds"),
    (lambda r: r["sync_events"].append({"sync_event_id": 8}), "outside their bounds"),
    (lambda r: r.update(sync_events=[]), "unknown event"),
    (lambda r: r["sources"][CAM].pop("sync_event_cardinality"), "without a cardinality"),
    (lambda r: r["sources"][RADAR]["sync_event_cardinality"].update(required=False), "must require"),
    (lambda r: r["sources"][RADAR]["sync_event_cardinality"].update(min_items=3), "cardinality bounds"),
]


@pytest.mark.parametrize("case", range(len(EVENT_DAMAGE)))
def test_session_event_damage(spark, session_dir, case):
    change, why = EVENT_DAMAGE[case]
    record = json.loads((session_dir / "session.json").read_text())
    change(record)
    (session_dir / "session.json").write_text(json.dumps(record))
    with pytest.raises(ValueError, match=why):
        sensors.open_session(str(session_dir), spark=spark)


@pytest.mark.parametrize("codec", ["raw", "adaptive-shuffle-zlib"])
def test_chunks(spark, tmp_path, codec):
    rows = [("c", i, bytes([i, 0]) * 8) for i in range(10)]
    frames = spark.createDataFrame(rows, "capture_id string, frame_id bigint, data binary")
    codecs.write_chunks(frames, f"{tmp_path}/chunks", codec, 16)
    got = codecs.read_window(spark, f"{tmp_path}/chunks", codec, 16, "c", 3, 9).orderBy("frame_id").collect()
    assert [(r.frame_id, bytes(r.data)) for r in got] == [(i, d) for _, i, d in rows[3:9]]
    starts = codecs.window_starts(1, 50, 10, 4)
    assert starts == codecs.window_starts(1, 50, 10, 4) and 0 <= min(starts) and max(starts) <= 6
    times = spark.createDataFrame([("a", float(i)) for i in range(1, 102)], "codec string, seconds double")
    assert tuple(codecs.latency_report(times).first())[1:] == (51.0, 96.0, 101)


def test_stream_tracker_refuses_late_frames(spark, tmp_path):
    from echofield.operators import tracking as T
    from echofield.plans.contracts import Gating
    from echofield.streaming import trackers as ST

    names = "capture_id bigint, frame_id bigint, cluster_id bigint, cx double, cy double, cz double, ex double, ey double, ez double, mean_velocity double, point_count bigint"
    row = lambda f: (1, f, 0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3)
    source = f"{tmp_path}/in"
    spark.createDataFrame([row(0), row(2)], names).coalesce(1).write.parquet(source)
    rows = spark.readStream.schema(names).parquet(source)
    out = ST.track_clusters_stream(rows, T.TrackerSpec(T.Dynamics(0.1), Gating(0.6)))
    q = out.writeStream.option("checkpointLocation", f"{tmp_path}/ck").format("parquet").option("path", f"{tmp_path}/out").start()
    q.processAllAvailable()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([row(1)], names).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="came after"):
        q.processAllAvailable()
    q.stop()
