"""Engine settings.  One frozen object; nothing in the engine reads mutable globals."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values: results depend on them."""

    base_fps: float = 25.0

    # association of detections to tracks
    match_thresh: float = 0.08
    max_gap: int = 3
    max_jump_per_frame: float = 0.04
    fill_max_dist: float = 0.12
    handedness_penalty: float = 1.25
    rot_avg_thresh: float = 0.001

    # landmark cleaning
    visibility_threshold: float = 0.35
    visibility_percentile: float = 20.0
    visibility_floor: float = 0.15
    smooth_window: int = 3
    outlier_window: int = 7
    outlier_thresh: float = 0.06
    one_euro_min_cutoff: float = 1.5
    one_euro_beta: float = 50.0
    one_euro_d_cutoff: float = 2.0

    # signal filters
    cutoff_hz: float = 2.5
    highpass_hz: float = 0.10
    filter_order: int = 4
    detrend_order: int = 3
    hampel_window: int = 5
    hampel_sigma: float = 3.0
    spike_jump_rad: float = 1.5707963267948966

    # cycle detection
    prominence_deg: float = 15.0
    adaptive_prominence: float = 0.20
    max_movement_hz: float = 2.0
    min_half_cycle_s: float = 0.20
    max_half_cycle_s: float = 4.0
    zcr_dc_window_cycles: float = 2.0
    startup_transient_factor: float = 4.0
    parabolic_heights: bool = False  # refine the heights of extrema by a parabola
    cycle_nan_threshold: float = 0.40
    peak_velocity_percentile: float = 95.0
    decrement_split: float = 1.0 / 3.0
    hesitation_ratio: float = 1.25
    hesitation_floor_s: float = 0.40
    arrest_ratio: float = 1.5
    arrest_floor_s: float = 0.8
    wrist_z_window: int = 5
    wrist_z_boost: float = 1.5
    wrist_z_min_valid: float = 0.50
    wrist_z_min_snr: float = 1.5

    # activity trimming
    max_task_s: float = 10.0
    min_task_s: float = 4.0
    activity_window_s: float = 1.0
    activity_percentile: float = 75.0
    activity_ratio: float = 0.15
    merge_gap_s: float = 2.5

    # physiological range of the movement
    freq_low_hz: float = 0.3
    freq_high_hz: float = 4.0

    # event matching, curation
    match_tolerance_s: float = 0.16
    min_mcp_conf: float = 0.70
    frame_margin: float = 0.02
    min_bbox_share: float = 0.01
    label_padding: float = 0.15

    def __post_init__(self) -> None:
        if self.base_fps <= 0:
            raise ValueError("base_fps must be positive")
        if not 0 <= self.cycle_nan_threshold <= 1:
            raise ValueError("cycle_nan_threshold must lie in [0, 1]")
        if self.freq_low_hz >= self.freq_high_hz:
            raise ValueError("freq_low_hz must be below freq_high_hz")

    def with_overrides(self, overrides: dict[str, Any]) -> Settings:
        """Apply a tuning profile; keys match field names in any letter case."""
        names = {f.name: f for f in dataclasses.fields(self)}
        known = {}
        for key, value in overrides.items():
            name = key.lower()
            if name not in names:
                raise KeyError(f"unknown setting {key}")
            known[name] = type(getattr(self, name))(value)
        return dataclasses.replace(self, **known)


DEFAULTS = Settings()


def load_settings(path: str | None = None, env_var: str = "OSCILLA_CONFIG") -> tuple[dict, Settings]:
    """Read a YAML file (``paths``, ``processing``, ``tuning`` or ``tuning_profile``).

    Returns the path/processing options as one flat dict and the tuned settings.  A relative
    ``tuning_profile`` is looked up beside the config file.
    """
    import yaml

    chosen = os.path.expandvars(os.path.expanduser(path or os.environ.get(env_var, "")))
    if not chosen:
        return {}, DEFAULTS
    with open(chosen, encoding="utf-8") as handle:
        doc = yaml.safe_load(handle) or {}
    flat: dict[str, Any] = {}
    for section in ("paths", "processing"):
        flat.update(doc.get(section) or {})
    flat = {k: os.path.expandvars(v) if isinstance(v, str) else v for k, v in flat.items()}
    tuning = dict(doc.get("tuning") or {})
    profile = doc.get("tuning_profile")
    if profile:
        if not os.path.isabs(profile):
            profile = os.path.join(os.path.dirname(os.path.abspath(chosen)), profile)
        with open(profile, encoding="utf-8") as handle:
            tuning = {**(yaml.safe_load(handle) or {}), **tuning}
    return flat, DEFAULTS.with_overrides(tuning)
