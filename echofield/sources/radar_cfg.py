"""Command files of radar boards: as a table of commands, and as a capture contract."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.contracts import RadarCapture, RadarProfile, require

# Fixed values of the command language: words in each command, and values that this reader accepts.
ARITY = {"flushCfg": 1, "dfeDataOutputMode": 2, "channelCfg": 4, "adcCfg": 3, "adcbufCfg": 6, "profileCfg": 15, "chirpCfg": 9, "frameCfg": 8, "lvdsStreamCfg": 5}
EXACT = {"dfeDataOutputMode": (1,), "adcCfg": (2, 1), "adcbufCfg": (-1, 0, 1, 1, 1), "lvdsStreamCfg": (-1, 0, 1, 0)}
REPEATED = {"profileCfg", "chirpCfg"}
REFUSED = {"advFrameCfg", "subFrameCfg"}
# Start frequencies in GHz and the transmitters of each family.
FAMILIES = {"xwr16xx": (76, 81, 2), "xwr18xx": (76, 81, 3), "xwr68xx": (57, 64, 3)}


def config_commands(files: DataFrame, text: str = "value", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., line_no, command, args) of every command; comments start with ``%`` or ``#``."""
    lines = files.select(*keys, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))
    bare = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[%#].*$", ""))).filter(F.col("line") != "")
    words = F.split("line", r"\s+")
    return bare.select(*keys, "line_no", words[0].alias("command"), F.slice(words, 2, 1000).alias("args"))


@dataclass(frozen=True)
class Command:
    name: str
    args: tuple[str, ...]

    def ints(self) -> tuple[int, ...]:
        return tuple(int(a) for a in self.args)


def commands_of(text: str) -> list[Command]:
    out = []
    for line in text.splitlines():
        for mark in "%#":
            line = line.partition(mark)[0]
        words = line.split()
        if words:
            out.append(Command(words[0], tuple(words[1:])))
    return out


def parse_capture(text: str, layout: str, family: str) -> RadarCapture:
    """The capture that a command file sets up; whatever it cannot represent is an error."""
    require(family in FAMILIES, f"unknown family {family}")
    low, high, transmitters = FAMILIES[family]
    known: dict[str, list[Command]] = {name: [] for name in ARITY}
    for c in commands_of(text):
        require(c.name not in REFUSED, f"{c.name} is not supported")
        if c.name not in ARITY:
            continue
        require(len(c.args) + 1 == ARITY[c.name], f"{c.name} has a wrong number of words")
        if c.name == "flushCfg":
            require(not any(known.values()), "flushCfg must come first and once")
        require(c.name in REPEATED or not known[c.name], f"{c.name} occurs twice")
        if c.name in EXACT:
            require(c.ints() == EXACT[c.name], f"{c.name} must be {EXACT[c.name]}")
        known[c.name].append(c)
    missing = [n for n in ARITY if n != "flushCfg" and not known[n]]
    require(not missing, f"missing {', '.join(missing)}")

    rx_mask, tx_mask, cascade = known["channelCfg"][0].ints()
    require(cascade == 0, "cascades are not supported")
    require(1 <= rx_mask <= 15 and rx_mask & (rx_mask + 1) == 0, "receivers must be the first ones")
    require(1 <= tx_mask < 1 << transmitters, "a transmitter that the family lacks")

    profiles: dict[int, tuple[str, ...]] = {}
    for c in known["profileCfg"]:
        number = int(c.args[0])
        require(0 <= number <= 3 and number not in profiles, "profile numbers are 0 to 3, each once")
        require(all(math.isfinite(float(c.args[i])) for i in (1, 2, 3, 4, 7, 10)), "profile values must be finite")
        require(low <= float(c.args[1]) <= high, f"{family} starts between {low} and {high} GHz")
        profiles[number] = c.args

    chirps: dict[int, tuple[int, int]] = {}
    for c in known["chirpCfg"]:
        first, last, profile = (int(a) for a in c.args[:3])
        require(0 <= first <= last <= 511, "chirp numbers are 0 to 511")
        require(all(float(v) == 0 for v in c.args[3:7]), "chirp variations are not supported")
        mask = int(c.args[7])
        require(0 <= mask < 1 << transmitters, "a chirp with a transmitter that the family lacks")
        for i in range(first, last + 1):
            require(i not in chirps, f"chirp {i} is defined twice")
            chirps[i] = (profile, mask)

    start, end, loops, frames, period, trigger, delay = known["frameCfg"][0].args
    used = range(int(start), int(end) + 1)
    require(0 <= int(start) <= int(end) <= 511 and 1 <= int(loops) <= 255 and 0 <= int(frames) <= 65535, "frameCfg is out of range")
    require(int(trigger) == 1 and float(delay) == 0, "frames must start by software without delay")
    require(math.isfinite(float(period)) and float(period) > 0, "the period must be positive")
    require(all(i in chirps for i in used), "a frame uses an undefined chirp")
    require(len({chirps[i][0] for i in used}) == 1, "a frame must use one profile")
    number = chirps[used[0]][0]
    require(number in profiles, f"profile {number} is not defined")
    masks = [chirps[i][1] for i in used]
    require(all(m.bit_count() == 1 for m in masks), "each chirp must use one transmitter")
    require(all(m & tx_mask for m in masks), "a chirp uses a disabled transmitter")
    order = tuple(m.bit_length() - 1 for m in masks)
    require(len(set(order)) == len(order), "each transmitter fires once a loop")

    p = profiles[number]
    profile = RadarProfile(
        start_frequency_hz=float(p[1]) * 1e9,
        frequency_slope_hz_per_s=float(p[7]) * 1e12,
        adc_sample_rate_hz=float(p[10]) * 1e3,
        adc_start_time_s=float(p[3]) * 1e-6,
        ramp_end_time_s=float(p[4]) * 1e-6,
        idle_time_s=float(p[2]) * 1e-6,
        num_adc_samples=int(p[9]),
        num_chirps_per_tx=int(loops),
        num_tx=len(order),
        num_rx=rx_mask.bit_count(),
    )
    return RadarCapture(profile, profile.adc_frame(layout), order, float(period) / 1e3, int(frames) or None)


