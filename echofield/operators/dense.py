"""Dense cubes: one frame per row, transformed by NumPy in one Arrow stage without any shuffle.

The long form is a row per cell; a production frame of 128 x 12 x 129 cells makes 200,000 of them. Here a chain of
steps is collected and runs in one ``mapInArrow`` over whole frames; only what detection needs (a magnitude map, the
antenna lines of detected cells) is expanded. Both forms give the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.contracts import AdcFrame, Fft, RangeDopplerRecipe, require
from .cube import Cube

_WINDOWS = {"none": (1.0, 0.0), "hann": (0.5, 0.5), "hamming": (0.54, 0.46)}


def decode(words: np.ndarray, spec: AdcFrame) -> np.ndarray:
    """(frame, chirp, rx, sample) complex cells of whole frames of int16 words."""
    c, r, s = spec.chirps, spec.rx, spec.samples
    w = words.astype(np.float64)
    if spec.layout == "iq_interleaved":
        pairs = w.reshape(-1, c, r, s, 2)
        return pairs[..., 0] + 1j * pairs[..., 1]
    if spec.layout == "sample_i_then_q":
        pairs = w.reshape(-1, c, s, 2, r)
        return (pairs[:, :, :, 0] + 1j * pairs[:, :, :, 1]).swapaxes(2, 3)
    if spec.layout == "group2_i_then_q":
        pairs = w.reshape(-1, c, r, s // 2, 2, 2)
        return (pairs[..., 0, :] + 1j * pairs[..., 1, :]).reshape(-1, c, r, s)
    groups = w.reshape(len(w) // spec.words, -1, 2, 4)
    return (groups[:, :, 0] + 1j * groups[:, :, 1]).reshape(-1, c, s, r).swapaxes(2, 3)


def transform(x: np.ndarray, axis: int, spec: Fft) -> np.ndarray:
    length, n = x.shape[axis], spec.n_fft or x.shape[axis]
    if spec.remove_dc:
        x = x - x.mean(axis=axis, keepdims=True)
    a, b = _WINDOWS[spec.window]
    if b and length > 1:
        shape = [1] * x.ndim
        shape[axis] = length
        x = x * (a - b * np.cos(2 * np.pi * np.arange(length) / (length - 1))).reshape(shape)
    out = np.fft.fft(x, n, axis=axis)
    if spec.fftshift:
        out = np.roll(out, -((n + 1) // 2), axis=axis)
    return out.take(range(n // 2 + 1), axis=axis) if spec.one_sided else out


@dataclass(frozen=True)
class DenseCube:
    """Frames as rows of (capture_id, samples) and the steps still to be applied to them."""

    raw: DataFrame
    adc: AdcFrame
    steps: tuple = ()
    drop_incomplete: bool = False

    @property
    def shape(self) -> dict[str, int]:
        return self._walk(None)[1]

    def then(self, *step) -> DenseCube:
        out = DenseCube(self.raw, self.adc, (*self.steps, step), self.drop_incomplete)
        out.shape  # noqa: B018  contradictions show while the plan is built
        return out

    def range_fft(self, spec: Fft = Fft()) -> DenseCube:
        return self.then("fft", "sample", "range_bin", spec)

    def doppler_fft(self, spec: Fft = Fft(fftshift=True)) -> DenseCube:
        return self.then("fft", "loop" if "loop" in self.shape else "chirp", "doppler_bin", spec)

    def angle_fft(self, spec: Fft = Fft(fftshift=True)) -> DenseCube:
        return self.then("fft", "virtual_rx" if "virtual_rx" in self.shape else "rx", "azimuth_bin", spec)

    def _walk(self, x: np.ndarray | None) -> tuple[np.ndarray | None, dict[str, int]]:
        """Apply the steps to frames (frame, axes...), or to the axes alone."""
        shape = {"chirp": self.adc.chirps, "rx": self.adc.rx, "sample": self.adc.samples}
        for kind, *args in self.steps:
            if kind == "fft":
                axis, out, spec = args
                n = spec.n_fft or shape[axis]
                n = n // 2 + 1 if spec.one_sided else n
                if x is not None:
                    x = transform(x, 1 + list(shape).index(axis), spec)
                shape = {out if a == axis else a: n if a == axis else s for a, s in shape.items()}
            elif kind == "tdm":
                tx, rest = args[0], [s for a, s in shape.items() if a not in ("chirp", "rx")]
                require(list(shape)[:2] == ["chirp", "rx"] and shape["chirp"] % tx == 0, "chirps must be whole loops")
                if x is not None:
                    x = x.reshape(len(x), shape["chirp"] // tx, tx * shape["rx"], *rest)
                shape = {"loop": shape["chirp"] // tx, "virtual_rx": tx * shape["rx"], **{a: s for a, s in shape.items() if a not in ("chirp", "rx")}}
            elif kind == "clutter":
                if x is not None:
                    x = x - x.mean(axis=1 + list(shape).index(args[0]), keepdims=True)
            elif kind == "channels":  # one factor for each channel
                require(len(args[0]) == shape["virtual_rx"], "one coefficient for each channel")
                if x is not None:
                    x = x * _along(np.array(args[0]), list(shape).index("virtual_rx"), x.ndim)
            elif kind == "compensate":
                num_tx, num_rx, shifted = args
                n = shape["doppler_bin"]
                if x is not None:
                    bins = np.arange(n) - n // 2 if shifted else (np.arange(n) + n // 2) % n - n // 2
                    slots = np.arange(shape["virtual_rx"]) // num_rx
                    phase = np.exp(-2j * np.pi * bins[:, None] * slots[None, :] / (n * num_tx))
                    at = [list(shape).index(a) for a in ("doppler_bin", "virtual_rx")]
                    full = phase if at[0] < at[1] else phase.T
                    dims = [1] * x.ndim
                    for a, name in zip(at, ("doppler_bin", "virtual_rx")):
                        dims[1 + a] = shape[name]
                    x = x * full.reshape(dims)
        return x, shape

    def _frames(self, samples: np.ndarray) -> np.ndarray:
        n, extra = divmod(len(samples), self.adc.words)
        if not n or extra and not self.drop_incomplete:
            raise ValueError("incomplete ADC frame")
        return self._walk(decode(samples[: n * self.adc.words], self.adc))[0]

    def _map(self, make, schema: str, fields: list[pa.Field]) -> DataFrame:
        kind = self.raw.schema["capture_id"].dataType.simpleString()
        me = DenseCube(None, self.adc, self.steps, self.drop_incomplete)  # type: ignore[arg-type]

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    words = one.column(1).flatten().to_numpy(zero_copy_only=False)
                    for frame, x in enumerate(me._frames(words)):
                        yield pa.RecordBatch.from_arrays([one.column(0), pa.array([frame], pa.int32()), *make(x)], names=["capture_id", "frame", *[f.name for f in fields]])

        return self.raw.select("capture_id", "samples").mapInArrow(run, f"capture_id {kind}, frame int, {schema}")

    def frames(self) -> DataFrame:
        """(capture_id, frame, re, im): arrays in row-major order of the axes."""

        def make(x):
            flat = x.reshape(-1)
            return [pa.array([np.ascontiguousarray(v)], pa.list_(pa.float64())) for v in (flat.real, flat.imag)]

        kind = pa.list_(pa.float64())
        return self._map(make, "re array<double>, im array<double>", [pa.field("re", kind), pa.field("im", kind)])

    def magnitude(self, aggregate: str = "max") -> Cube:
        """The range-Doppler magnitude map over all channels, as a cube with one channel."""
        axes = list(self.shape)
        channels = tuple(1 + i for i, a in enumerate(axes) if a not in ("doppler_bin", "range_bin"))
        how = {"max": np.max, "sum": np.sum, "mean": np.mean}[aggregate]
        swap = axes.index("doppler_bin") > axes.index("range_bin")

        def make(x):
            m = how(np.abs(x), axis=tuple(c - 1 for c in channels))
            return [pa.array([np.ascontiguousarray(m.T if swap else m).reshape(-1)], pa.list_(pa.float64()))]

        nd, nr = self.shape["doppler_bin"], self.shape["range_bin"]
        maps = self._map(make, "m array<double>", [pa.field("m", pa.list_(pa.float64()))])
        cells = maps.repartition("capture_id", "frame").select("capture_id", "frame", F.posexplode("m").alias("i", "re"))
        df = cells.select("capture_id", "frame", F.floor(F.col("i") / nr).cast("int").alias("doppler_bin"), (F.col("i") % nr).cast("int").alias("range_bin"), F.lit(0).alias("rx"), "re", F.lit(0.0).alias("im"))
        return Cube(df, {"doppler_bin": nd, "range_bin": nr, "rx": 1})

    def long(self) -> Cube:
        """One row per cell."""
        cells = self.frames().select("capture_id", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("i", "c"))
        df = cells.select("capture_id", "frame", *self._indices(F.col("i")), "c.re", "c.im")
        return Cube(df, self.shape)

    def _indices(self, i):
        out, below = [], 1
        for a, n in reversed(self.shape.items()):
            out.append((F.floor(i / below) % n).cast("int").alias(a))
            below *= n
        return out[::-1]

    def lines_at(self, detections: DataFrame) -> Cube:
        """The channel lines of detected cells alone, picked out of the frames' arrays."""
        shape = self.shape
        stride, below = {}, 1
        for a, n in reversed(shape.items()):
            stride[a] = below
            below *= n
        base = F.col("doppler_bin") * stride["doppler_bin"] + F.col("range_bin") * stride["range_bin"]
        cut = detections.select("capture_id", "frame", "range_bin", "doppler_bin").distinct()
        rest = [a for a in shape if a not in ("doppler_bin", "range_bin")]
        require(rest == ["virtual_rx"], "lines are along the virtual array")
        picked = cut.join(self.frames(), ["capture_id", "frame"]).withColumn("virtual_rx", F.explode(F.sequence(F.lit(0), F.lit(shape["virtual_rx"] - 1))))
        at = (base + F.col("virtual_rx") * stride["virtual_rx"]).cast("int")
        df = picked.select("capture_id", "frame", *shape, F.get("re", at).alias("re"), F.get("im", at).alias("im"))
        return Cube(df, shape)


def _along(values: np.ndarray, axis: int, ndim: int) -> np.ndarray:
    dims = [1] * ndim
    dims[1 + axis] = len(values)
    return values.reshape(dims)


def dense_range_doppler(raw: DataFrame, recipe: RangeDopplerRecipe) -> DenseCube:
    """The recipe's chain in one Arrow stage."""
    cube = DenseCube(raw, recipe.adc, (), recipe.drop_incomplete).range_fft(recipe.range_fft)
    if recipe.virtual is not None:
        cube = cube.then("tdm", len(recipe.virtual.tx_order))
    if recipe.remove_clutter:
        cube = cube.then("clutter", "loop" if recipe.virtual is not None else "chirp")
    cube = cube.doppler_fft(recipe.doppler_fft)
    if recipe.calibration is not None:
        cube = cube.then("channels", tuple(complex(a, b) for a, b in recipe.calibration))
    if recipe.virtual is not None and len(recipe.virtual.tx_order) > 1:
        cube = cube.then("compensate", len(recipe.virtual.tx_order), recipe.adc.rx, recipe.doppler_fft.fftshift)
    return cube
