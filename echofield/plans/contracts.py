"""Physical contracts: frozen descriptions that are validated before any plan is built."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

LAYOUTS = ("iq_interleaved", "sample_i_then_q", "group2_i_then_q", "group4_i_then_q")
WINDOWS = ("none", "hann", "hamming")
CFAR_MODES = ("ca", "go", "so", "cacc")
AGGREGATES = ("max", "sum", "mean")
INPUT_SCALES = ("magnitude", "power")
DETECTION_METHODS = ("threshold", "cfar")


class ContractError(ValueError):
    """A contract contradicts itself or its data."""


def require(ok: bool, why: str) -> None:
    if not ok:
        raise ContractError(why)


def _positive(name: str, value) -> None:
    require(math.isfinite(value) and value > 0, f"{name} must be positive and finite")


@dataclass(frozen=True)
class AdcFrame:
    """Shape and word order of one ADC frame."""

    chirps: int
    rx: int
    samples: int
    layout: str = "iq_interleaved"

    def __post_init__(self):
        require(min(self.chirps, self.rx, self.samples) > 0, "frame dimensions must be positive")
        require(self.layout in LAYOUTS, f"unknown layout {self.layout}")
        require(self.layout != "group2_i_then_q" or self.samples % 2 == 0, "group2 needs an even number of samples")
        require(self.layout != "group4_i_then_q" or self.chirps * self.rx * self.samples % 4 == 0, "group4 needs a multiple of 4 cells")

    @property
    def words(self) -> int:
        return 2 * self.chirps * self.rx * self.samples


@dataclass(frozen=True)
class CascadeFrame:
    """Shape of a frame that several devices record together."""

    samples: int
    loops: int
    tx: int
    rx_per_device: int
    devices: tuple[str, ...]
    layout: str = "iq_interleaved"

    def __post_init__(self):
        require(min(self.samples, self.loops, self.tx, self.rx_per_device) > 0, "frame dimensions must be positive")
        require(len(self.devices) > 0 and len(set(self.devices)) == len(self.devices), "device names must be unique")
        require(self.layout in LAYOUTS, f"unknown layout {self.layout}")

    @property
    def rx(self) -> int:
        return self.rx_per_device * len(self.devices)


@dataclass(frozen=True)
class RadarProfile:
    """Chirp waveform of one profile."""

    # The default profile is the board's published one.
    start_frequency_hz: float = 60e9
    frequency_slope_hz_per_s: float = 60.012e12
    adc_sample_rate_hz: float = 4.4e6
    adc_start_time_s: float = 6e-6
    ramp_end_time_s: float = 65e-6
    idle_time_s: float = 360e-6
    num_adc_samples: int = 256
    num_chirps_per_tx: int = 64
    num_tx: int = 3
    num_rx: int = 4
    speed_of_light_mps: float = 299792458.0

    def __post_init__(self):
        for name in ("start_frequency_hz", "frequency_slope_hz_per_s", "adc_sample_rate_hz", "ramp_end_time_s", "speed_of_light_mps"):
            _positive(name, getattr(self, name))
        require(self.adc_start_time_s >= 0 and self.idle_time_s >= 0, "times must not be negative")
        require(self.ramp_end_time_s > self.adc_start_time_s, "the ramp must end after sampling starts")
        require(min(self.num_adc_samples, self.num_chirps_per_tx, self.num_tx, self.num_rx) > 0, "counts must be positive")

    @property
    def wavelength_m(self) -> float:
        return self.speed_of_light_mps / self.start_frequency_hz

    @property
    def chirp_time_s(self) -> float:
        return self.idle_time_s + self.ramp_end_time_s

    @property
    def bandwidth_hz(self) -> float:
        sampled = self.num_adc_samples / self.adc_sample_rate_hz
        return self.frequency_slope_hz_per_s * min(sampled, self.ramp_end_time_s - self.adc_start_time_s)

    @property
    def range_resolution_m(self) -> float:
        return self.speed_of_light_mps / (2 * self.bandwidth_hz)

    @property
    def max_velocity_mps(self) -> float:
        return self.wavelength_m / (4 * self.chirp_time_s * self.num_tx)

    @property
    def velocity_resolution_mps(self) -> float:
        return 2 * self.max_velocity_mps / self.num_chirps_per_tx

    def adc_frame(self, layout: str = "iq_interleaved") -> AdcFrame:
        return AdcFrame(self.num_chirps_per_tx * self.num_tx, self.num_rx, self.num_adc_samples, layout)

    def projection(self, center: bool = True, doppler_bins: int | None = None, shifted: bool = False) -> Projection:
        return Projection(self.range_resolution_m, self.velocity_resolution_mps, center, doppler_bins or self.num_chirps_per_tx, shifted)


@dataclass(frozen=True)
class AntennaGeometry:
    """Positions (x, y, z) in wavelengths."""

    tx: tuple[tuple[float, float, float], ...]
    rx: tuple[tuple[float, float, float], ...]
    name: str = "antenna_array"

    def __post_init__(self):
        require(bool(self.tx) and bool(self.rx), "an array needs transmitters and receivers")
        require(all(len(p) == 3 and all(map(math.isfinite, p)) for p in (*self.tx, *self.rx)), "positions are finite triples")


@dataclass(frozen=True)
class VirtualArray:
    """Time-division virtual array: transmitters in the order they fire."""

    geometry: AntennaGeometry
    tx_order: tuple[int, ...]

    def __post_init__(self):
        require(len(self.tx_order) > 0 and len(set(self.tx_order)) == len(self.tx_order), "tx order must be unique")
        require(all(0 <= t < len(self.geometry.tx) for t in self.tx_order), "tx order names an unknown transmitter")

    @property
    def positions(self) -> list[tuple[float, float, float]]:
        g = self.geometry
        return [tuple(a + b for a, b in zip(g.tx[t], r)) for t in self.tx_order for r in g.rx]


@dataclass(frozen=True)
class Subarray:
    """An ordered choice of virtual antennas, with their positions."""

    indices: tuple[int, ...]
    positions: tuple[tuple[float, float, float], ...]
    axis: str = "azimuth"

    def __post_init__(self):
        require(len(self.indices) == len(self.positions) > 0, "a position for each antenna")
        require(len(set(self.indices)) == len(self.indices) and min(self.indices) >= 0, "antenna indices must be unique")


@dataclass(frozen=True)
class PlanarAperture:
    """Grid cell (elevation row, azimuth column) of each virtual antenna."""

    grid: tuple[tuple[int, int], ...]

    def __post_init__(self):
        require(bool(self.grid) and all(r >= 0 and c >= 0 for r, c in self.grid), "grid cells must not be negative")

    @property
    def shape(self) -> tuple[int, int]:
        return max(r for r, _ in self.grid) + 1, max(c for _, c in self.grid) + 1


@dataclass(frozen=True)
class Fft:
    n_fft: int | None = None
    window: str = "none"
    fftshift: bool = False
    one_sided: bool = False
    remove_dc: bool = False

    def __post_init__(self):
        require(self.n_fft is None or self.n_fft > 0, "n_fft must be positive")
        require(self.window in WINDOWS, f"unknown window {self.window}")


@dataclass(frozen=True)
class PeakDetection:
    threshold: float
    aggregate_rx: str = "max"
    azimuth_peak_radius: int = 1
    azimuth_peak_strict: bool = True

    def __post_init__(self):
        require(math.isfinite(self.threshold) and self.threshold >= 0, "threshold must be finite and not negative")
        require(self.aggregate_rx in AGGREGATES and self.azimuth_peak_radius >= 0, "bad aggregate or radius")


@dataclass(frozen=True)
class Cfar1D:
    training: int
    guard: int
    scale: float
    mode: str = "ca"
    cyclic: bool = False
    left_skip: int = 0
    right_skip: int = 0

    def __post_init__(self):
        require(self.training > 0 and self.guard >= 0, "training cells must be positive, guard cells not negative")
        _positive("scale", self.scale)
        require(self.mode in CFAR_MODES, f"unknown mode {self.mode}")
        require(min(self.left_skip, self.right_skip) >= 0, "skips must not be negative")


@dataclass(frozen=True)
class Cfar2D:
    training: int
    guard: int
    scale: float
    aggregate_rx: str = "max"

    def __post_init__(self):
        require(self.training > 0 and self.guard >= 0 and self.aggregate_rx in AGGREGATES, "bad cell counts or aggregate")
        _positive("scale", self.scale)


@dataclass(frozen=True)
class RangeDopplerCfar:
    range: Cfar1D
    doppler: Cfar1D | None = None
    input_scale: str = "power"
    aggregate_rx: str = "sum"

    def __post_init__(self):
        require(self.input_scale in INPUT_SCALES and self.aggregate_rx in AGGREGATES, "bad input scale or aggregate")


@dataclass(frozen=True)
class PeakGrouping:
    range_radius: int = 1
    doppler_radius: int = 1
    cyclic_doppler: bool = True
    strict: bool = True
    aggregate_rx: str = "sum"

    def __post_init__(self):
        require(min(self.range_radius, self.doppler_radius) >= 0 and self.aggregate_rx in AGGREGATES, "bad radius or aggregate")


@dataclass(frozen=True)
class Projection:
    range_resolution_m: float = 1.0
    doppler_resolution_mps: float = 1.0
    center_doppler: bool = False
    doppler_bins: int | None = None
    doppler_fftshifted: bool = False

    def __post_init__(self):
        _positive("range resolution", self.range_resolution_m)
        _positive("Doppler resolution", self.doppler_resolution_mps)
        require(not self.center_doppler or (self.doppler_bins or 0) > 0, "centring needs the number of Doppler bins")


@dataclass(frozen=True)
class Sparsification:
    min_snr_db: float = 0.0
    max_points: int = 256
    spatial_peak_radius: int = 1
    doppler_peak_radius: int = 0
    max_doppler_peaks_per_spatial: int | None = None
    boundary_margin_voxels: int = 0
    noise_floor_scale: float = 1.0
    static_point_capacity_fraction: float = 1.0
    static_velocity_threshold_mps: float = 0.0
    strongest_point_fallback: bool = True

    def __post_init__(self):
        require(math.isfinite(self.min_snr_db) and self.max_points > 0, "bad SNR or point limit")
        require(min(self.spatial_peak_radius, self.doppler_peak_radius, self.boundary_margin_voxels) >= 0, "radii must not be negative")
        require(self.max_doppler_peaks_per_spatial is None or self.max_doppler_peaks_per_spatial > 0, "peak limit must be positive")
        _positive("noise floor scale", self.noise_floor_scale)
        require(0 <= self.static_point_capacity_fraction <= 1 and self.static_velocity_threshold_mps >= 0, "bad static limits")


@dataclass(frozen=True)
class Dbscan:
    eps_m: float
    min_samples: int
    velocity_scale_s: float = 0.0
    use_z: bool = True

    def __post_init__(self):
        _positive("eps", self.eps_m)
        require(self.min_samples > 0 and self.velocity_scale_s >= 0, "bad sample count or velocity scale")


@dataclass(frozen=True)
class Gating:
    max_distance_m: float
    max_radial_velocity_difference_mps: float | None = None
    max_mahalanobis_distance: float | None = None


@dataclass(frozen=True)
class Allocation:
    min_points: int = 1
    min_abs_radial_velocity_mps: float = 0.0
    min_total_snr: float | None = None
    max_new_tracks_per_frame: int | None = None


@dataclass(frozen=True)
class Lifecycle:
    confirmation_hits: int = 4
    tentative_max_misses: int = 4
    confirmed_max_misses: int = 11


@dataclass(frozen=True)
class Box2D:
    x_min_m: float
    x_max_m: float
    y_min_m: float
    y_max_m: float

    def __post_init__(self):
        require(self.x_min_m < self.x_max_m and self.y_min_m < self.y_max_m, "a box needs an extent")

    def holds(self, x: float, y: float) -> bool:
        return self.x_min_m <= x <= self.x_max_m and self.y_min_m <= y <= self.y_max_m


@dataclass(frozen=True)
class Scenery:
    boxes: tuple[Box2D, ...] = ()
    outside_max_frames: int = 5


# Fixed values of the JSON form: names of the frame's fields.
ADC_FIELDS = {"chirps": "num_chirps", "rx": "num_rx", "samples": "num_samples"}


@dataclass(frozen=True)
class RadarCapture:
    """Profile, frame shape and transmitter order of a capture."""

    profile: RadarProfile
    adc: AdcFrame
    tx_order: tuple[int, ...]
    frame_periodicity_s: float | None = None
    num_frames: int | None = None

    def __post_init__(self):
        p, a = self.profile, self.adc
        require(len(self.tx_order) == p.num_tx and len(set(self.tx_order)) == p.num_tx, "tx order must name each transmitter once")
        require(a.rx == p.num_rx and a.samples == p.num_adc_samples, "frame shape contradicts the profile")
        require(a.chirps == p.num_chirps_per_tx * p.num_tx, "chirps contradict the profile")
        if self.frame_periodicity_s is not None:
            _positive("frame periodicity", self.frame_periodicity_s)
            require(self.frame_periodicity_s >= a.chirps * p.chirp_time_s, "a frame must not be shorter than its chirps")
        require(self.num_frames is None or self.num_frames > 0, "number of frames must be positive")

    @property
    def expected_size_bytes(self) -> int | None:
        return None if self.num_frames is None else 2 * self.adc.words * self.num_frames

    def to_record(self) -> dict:
        """The contract as a JSON object; ``from_record`` takes no other field."""
        adc = {ADC_FIELDS.get(k, k): v for k, v in asdict(self.adc).items()}
        return {
            "profile": asdict(self.profile),
            "adc": adc,
            "tx_order": list(self.tx_order),
            "frame_periodicity_s": self.frame_periodicity_s,
            "num_frames": self.num_frames,
            "expected_size_bytes": self.expected_size_bytes,
        }

    @classmethod
    def from_record(cls, record: dict) -> RadarCapture:
        def strict(kind, data, names):
            require(isinstance(data, dict) and set(data) == set(names), f"wrong fields for {kind.__name__}")
            return kind(**{names[k]: v for k, v in data.items()})

        fields = ("profile", "adc", "tx_order", "frame_periodicity_s", "num_frames", "expected_size_bytes")
        require(isinstance(record, dict) and set(record) == set(fields), "wrong fields for a capture")
        profile = strict(RadarProfile, record["profile"], {n: n for n in RadarProfile.__dataclass_fields__})
        adc = strict(AdcFrame, record["adc"], {ADC_FIELDS.get(n, n): n for n in AdcFrame.__dataclass_fields__})
        out = cls(profile, adc, tuple(record["tx_order"]), record["frame_periodicity_s"], record["num_frames"])
        require(out.expected_size_bytes == record["expected_size_bytes"], "the size contradicts the frames")
        return out


@dataclass(frozen=True)
class RangeDopplerRecipe:
    """Decode, range FFT, optional virtual array and clutter removal, Doppler FFT, optional calibration."""

    adc: AdcFrame
    range_fft: Fft = field(default_factory=Fft)
    doppler_fft: Fft = field(default_factory=lambda: Fft(fftshift=True))
    virtual: VirtualArray | None = None
    calibration: tuple[tuple[float, float], ...] | None = None
    remove_clutter: bool = False
    drop_incomplete: bool = False

    def __post_init__(self):
        require(not self.range_fft.fftshift, "a range FFT is never shifted")
        if self.virtual is not None:
            require(len(self.virtual.geometry.rx) == self.adc.rx, "receivers contradict the frame")
            require(self.adc.chirps % len(self.virtual.tx_order) == 0, "chirps must be whole loops")
        if self.calibration is not None:
            channels = self.adc.rx * (len(self.virtual.tx_order) if self.virtual else 1)
            require(len(self.calibration) == channels, "one coefficient for each channel")


@dataclass(frozen=True)
class DetectionRecipe:
    transform: RangeDopplerRecipe
    peak: PeakDetection | None = None
    method: str = "threshold"
    cfar: RangeDopplerCfar | Cfar2D | None = None
    grouping: PeakGrouping | None = None
    min_snr: float | None = None
    angle: Fft | None = None
    azimuth: Subarray | None = None
    elevation: Subarray | None = None

    def __post_init__(self):
        require(self.method in DETECTION_METHODS, f"unknown method {self.method}")
        require((self.method == "threshold") == (self.peak is not None), "the threshold method needs a threshold, no other does")
        require((self.method == "cfar") == (self.cfar is not None), "the CFAR method needs its cells, no other does")
        require(self.min_snr is None or isinstance(self.cfar, RangeDopplerCfar), "an SNR limit needs composed CFAR")
        require(self.elevation is None or self.azimuth is not None, "elevation needs an azimuth row")


@dataclass(frozen=True)
class PointCloudRecipe:
    detection: DetectionRecipe
    projection: Projection = field(default_factory=Projection)


def with_changes(contract, **changes):
    """A copy of a contract with some fields changed, validated again."""
    return replace(contract, **changes)
