"""Detector settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class DetectorParams:
    """The tuned thresholds of the detectors (km/h, metres, seconds, shares)."""

    stop_ratio: float = 0.30
    stop_sustain_s: float = 1.5
    stop_max_kmh: float = 60.0
    recover_ratio: float = 0.60
    recover_s: float = 5.0
    impact_drop_kmh: float = 80.0
    impact_brake_window_s: float = 1.0
    impact_end_ratio: float = 0.40
    impact_confirm_s: float = 0.5
    impact_hard_kmh: float = 180.0
    impact_hard_confirm_ratio: float = 0.85
    spin_heading_deg: float = 35.0
    spin_min_kmh: float = 25.0
    spin_loss_kmh: float = 30.0
    spin_lat_m: float = 10.0
    spin_sustain_s: float = 0.5
    slowdown_lap_ratio: float | None = 0.6
    slowdown_loss_kmh: float = 40.0
    slowdown_sustain_s: float = 1.0
    slowdown_rel_ratio: float = 0.6
    dropout_s: float = 2.0
    dropout_min_kmh: float = 30.0
    field_live_min: float = 0.6
    multi_window_s: float = 5.0
    cooldown_s: float = 20.0
    grid_field_slow: float = 0.5
    grid_field_ratio: float = 0.3
    grid_hold_s: float = 15.0
    resume_min_susp_s: float = 60.0
    resume_max_s: float = 240.0
    stop_lap_ratio: float = 0.5
    impact_lap_ratio: float = 0.6
    anomaly_sustain: int = 2
    anomaly_slow_ratio: float | None = 0.85
    on_line_m: float = 8.0

    def with_saved(self, saved: dict) -> "DetectorParams":
        """Saved overrides; unknown names are ignored."""
        return replace(self, **{k: v for k, v in saved.items() if k in asdict(self)})


def candidate_grid() -> list[dict]:
    """The detector settings tried in tuning: two stop ratios by two impact drops, each without the
    slowdown rule and with eight settings of it."""
    out = []
    for stop in (0.3, 0.4):
        for impact in (60.0, 80.0):
            base = {"stop_ratio": stop, "impact_drop_kmh": impact}
            out.append({**base, "slowdown_lap_ratio": None, "slowdown_rel_ratio": 0.6, "slowdown_sustain_s": 1.0})
            out += [{**base, "slowdown_lap_ratio": lap, "slowdown_rel_ratio": rel, "slowdown_sustain_s": sus}
                    for lap in (0.35, 0.5) for rel in (0.4, 0.55) for sus in (1.0, 2.0)]
    return out


BASELINE_KMH = (20.0, 30.0, 40.0, 50.0)
SWEPT = ("stop_ratio", "impact_drop_kmh", "slowdown_lap_ratio", "slowdown_rel_ratio", "slowdown_sustain_s")
