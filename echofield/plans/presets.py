"""Boards: antenna positions, profiles, and recipes made of them."""

from __future__ import annotations

from ..operators.tracking import Dynamics, TrackerSpec
from .contracts import (
    Allocation,
    AntennaGeometry,
    Box2D,
    Dbscan,
    DetectionRecipe,
    Fft,
    Gating,
    Lifecycle,
    PeakDetection,
    PeakGrouping,
    PlanarAperture,
    PointCloudRecipe,
    RadarProfile,
    RangeDopplerCfar,
    RangeDopplerRecipe,
    Scenery,
    Subarray,
    VirtualArray,
    require,
)

# Fixed values: (azimuth, elevation) of transmitters and receivers in half wavelengths, from the boards' data sheets.
ANTENNAS = {
    "xwr1642": (((0, 0), (4, 0)), ((0, 0), (1, 0), (2, 0), (3, 0))),
    "xwr1843_evm": (((0, 1), (2, 0), (4, 1)), ((0, 0), (1, 0), (2, 0), (3, 0))),
    "iwr6843_isk": (((0, 1), (2, 0), (4, 1)), ((0, 0), (1, 0), (2, 0), (3, 0))),
    "iwr6843_aop": (((0, 0), (2, 2), (0, 2)), ((1, 1), (1, 0), (0, 1), (0, 0))),
    "awr1843_aop": (((0, 0), (0, 1), (0, 2)), ((3, 0), (2, 0), (1, 0), (0, 0))),
}


def geometry(board: str) -> AntennaGeometry:
    tx, rx = ANTENNAS[board]
    place = lambda cells: tuple((0.5 * a, 0.0, 0.5 * e) for a, e in cells)
    return AntennaGeometry(place(tx), place(rx), board)


def virtual_array(board: str = "iwr6843_isk", tx_order: tuple[int, ...] = (0, 2, 1)) -> VirtualArray:
    return VirtualArray(geometry(board), tx_order)


def planar_aperture(board: str = "iwr6843_isk", tx_order: tuple[int, ...] = (0, 2, 1)) -> PlanarAperture:
    return PlanarAperture(tuple((round(p[2] / 0.5), round(p[0] / 0.5)) for p in virtual_array(board, tx_order).positions))


def subarray(transmitters: tuple[int, ...], board: str = "iwr6843_isk", tx_order: tuple[int, ...] = (0, 2, 1)) -> Subarray:
    """The channels of some transmitters, one after the other."""
    array = virtual_array(board, tx_order)
    n = len(array.geometry.rx)
    channels = tuple(tx_order.index(t) * n + r for t in transmitters for r in range(n))
    return Subarray(channels, tuple(array.positions[c] for c in channels))


def azimuth_row(tx_order: tuple[int, ...] = (0, 2, 1)) -> Subarray:
    return subarray((0, 2), tx_order=tx_order)


def elevation_row(tx_order: tuple[int, ...] = (0, 2, 1)) -> Subarray:
    return subarray((1,), tx_order=tx_order)


def iwr6843_profile(**changes) -> RadarProfile:
    return RadarProfile(**changes)


def range_doppler(
    profile: RadarProfile | None = None, layout: str = "iq_interleaved", window: str = "hann", remove_dc: bool = False,
    tx_order: tuple[int, ...] = (0, 2, 1), doppler_window: str | None = None, **more,
) -> RangeDopplerRecipe:
    """One-sided range FFT over all samples, shifted Doppler FFT over all chirps of a transmitter."""
    p = profile or iwr6843_profile()
    require(p.num_rx == 4, "the board has four receivers")
    require(p.num_tx == len(tx_order), "the transmitter order contradicts the profile")
    ranges = Fft(p.num_adc_samples, window, one_sided=True, remove_dc=remove_dc)
    doppler = Fft(p.num_chirps_per_tx, doppler_window or window, fftshift=True)
    return RangeDopplerRecipe(p.adc_frame(layout), ranges, doppler, virtual_array(tx_order=tx_order), **more)


def _point_cloud(detection: DetectionRecipe, profile: RadarProfile | None) -> PointCloudRecipe:
    p = profile or iwr6843_profile()
    return PointCloudRecipe(detection, p.projection(True, p.num_chirps_per_tx, True))


def detection(
    threshold: float, profile: RadarProfile | None = None, elevation: bool = False, angle_bins: int = 64, angle_window: str = "hann",
    peak_radius: int = 1, peak_strict: bool = True, tx_order: tuple[int, ...] = (0, 2, 1), **more,
) -> DetectionRecipe:
    """Peaks above a threshold, and their angles: with ``elevation`` both of them, else azimuth alone."""
    return DetectionRecipe(
        range_doppler(profile, tx_order=tx_order, **more), PeakDetection(threshold, azimuth_peak_radius=peak_radius, azimuth_peak_strict=peak_strict),
        angle=Fft(angle_bins, angle_window, True), azimuth=azimuth_row(tx_order), elevation=elevation_row(tx_order) if elevation else None,
    )


def point_cloud(threshold: float, profile: RadarProfile | None = None, **more) -> PointCloudRecipe:
    """Points of a threshold; with ``elevation=True`` they have three coordinates."""
    return _point_cloud(detection(threshold, profile, **more), profile)


def cfar_point_cloud(
    cfar: RangeDopplerCfar, grouping: PeakGrouping | None = None, profile: RadarProfile | None = None, min_snr: float | None = None,
    elevation: bool = False, angle_bins: int = 64, angle_window: str = "hann", tx_order: tuple[int, ...] = (0, 2, 1), **more,
) -> PointCloudRecipe:
    """Points of CFAR cells; with ``elevation`` they have three coordinates."""
    found = DetectionRecipe(
        range_doppler(profile, tx_order=tx_order, **more), None, "cfar", cfar, grouping, min_snr, Fft(angle_bins, angle_window, True),
        azimuth_row(tx_order), elevation_row(tx_order) if elevation else None,
    )
    return _point_cloud(found, profile)


def people_counting() -> tuple[TrackerSpec, Dbscan, float]:
    """Tracker, clustering and match distance of the public people-counting example."""
    # Fixed values of that example.
    tracker = TrackerSpec(
        Dynamics(0.05, (0.1, 0.1)),
        Gating(1.5, 2.0),
        Allocation(6, 0.1, None, 1),
        Lifecycle(10, 5, 50),
        Scenery((Box2D(-4.0, 4.0, 0.5, 7.5),), 5),
        20,
    )
    return tracker, Dbscan(1.5, 6, 0.75, False), 1.0
