"""Parameters of the hotspot engine. Fixed values of the detectors stand here, in the order of the steps that use them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Region:
    west: float = 140.9
    south: float = -38.0
    east: float = 154.0
    north: float = -28.0


@dataclass(frozen=True)
class DayNight:
    """A threshold by day and one by night."""

    day: float
    night: float


@dataclass(frozen=True)
class ContextualConfig:
    cloud_bt14: float = 270.0
    cloud_buffer: int = 2
    day_sza: float = 85.0
    glint_degrees: float = 12.0
    absolute_any: float = 400.0
    absolute: DayNight = DayNight(360.0, 320.0)
    candidate_bt7: DayNight = DayNight(315.0, 290.0)
    candidate_btd: DayNight = DayNight(22.0, 10.0)
    background_fire_bt7: DayNight = DayNight(335.0, 300.0)
    background_fire_btd: DayNight = DayNight(30.0, 10.0)
    windows: tuple[int, ...] = (11, 15, 21, 31)
    min_background_share: float = 0.25
    std_floor: float = 2.0
    sigma: DayNight = DayNight(3.5, 3.0)
    btd_floor: DayNight = DayNight(10.0, 8.0)
    bt7_floor: DayNight = DayNight(310.0, 295.0)
    bt14_margin: float = 4.0
    nominal_btd: float = 15.0


@dataclass(frozen=True)
class CusumConfig:
    min_clear: int = 48
    k_slow: float = 0.5
    k_fast: float = 1.5
    noise: DayNight = DayNight(0.25, 0.09)
    decay_seconds: float = 3 * 3600.0
    prior: float = 0.00001
    confidence: float = 0.5
    z14_low: float = 3.0
    z14_high: float = 6.0
    ema_seconds: float = 4 * 3600.0
    ema_dt_fix: bool = False  # True: the time since the last clear frame instead of the floor of one second
    process_std: tuple[float, ...] = (0.001, 0.0001, 0.0001, 0.00005, 0.00005, 0.0001)
    start_variance: tuple[float, ...] = (25.0, 4.0, 4.0, 1.0, 1.0, 1.0)
    anomaly_z: float = 1.0
    log_odds_scale: float = 2.0
    min_weight: float = 0.01
    ema_max_confidence: float = 0.5
    require_adjacent: bool = True
    heatmap_floor: float = 0.05


@dataclass(frozen=True)
class PersistenceConfig:
    window: int = 3
    min_frames: int = 2
    km: float = 4.0
    bypass_high: bool = True

    def __post_init__(self):
        if self.min_frames > self.window:
            raise ValueError(f"min_frames {self.min_frames} cannot exceed window {self.window}")


@dataclass(frozen=True)
class EventConfig:
    radius_km: float = 2.0
    pass_gap_minutes: int = 30
    hotspot_uncertainty_m: float = 4000.0
    point_uncertainty_m: float = 2000.0
    merge_degrees: float = 0.02
    match_km: float = 5.0
    match_hours: int = 24


@dataclass(frozen=True)
class FusionConfig:
    """Several sensors: radii and uncertainties (km) of the coarse one and the fine ones, time windows, buffer of a match."""

    coarse_source: str = "HIMAWARI"
    coarse_km: float = 5.0
    fine_km: float = 2.0
    coarse_uncertainty_km: float = 4.0
    fine_uncertainty_km: float = 2.0
    window_days: int = 5
    buffer_km: float = 2.0
    match_hours: tuple[tuple[str, int], ...] = (("DEA", 3), ("FIRMS", 6))


#: Status ranks (monotone ladder) and confidence ranks.
STATUS_RANK = {"RETRACTED": -1, "CLOSED": 0, "PROVISIONAL": 1, "LIKELY": 2, "CONFIRMED": 3, "MONITORING": 4}
CONFIDENCE_RANK = {"low": 0, "nominal": 1, "high": 2}
INACTIVE = ("RETRACTED", "CLOSED")


@dataclass(frozen=True)
class Config:
    region: Region = field(default_factory=Region)
    contextual: ContextualConfig = field(default_factory=ContextualConfig)
    cusum: CusumConfig = field(default_factory=CusumConfig)
    persistence: PersistenceConfig = field(default_factory=PersistenceConfig)
    events: EventConfig = field(default_factory=EventConfig)
