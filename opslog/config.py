"""Constants of the operational-log domain. Operators take them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Config:
    # fixed values of the domain
    approach_tracks: int = 2
    wait_lookahead_s: int = 30
    pass_buffer_s: int = 1800
    fallback_gap_s: int = 21600
    reward_weights: dict = field(
        default_factory=lambda: {"delay": 1.0, "throughput": 0.5, "headway": 1.0, "wait": 0.3}
    )
    discount: float = 0.95
    hops: int = 3
    candidate_hops: int = 2
    windows_min: tuple = (1, 5, 10, 15, 30)
    outlook_s: int = 900
    outlook_rows: int = 5
    platforms: tuple = (1, 2, 3, 4, 5, 6, 7)
    node_caps: dict = field(
        default_factory=lambda: {"track": 60, "signal": 15, "route": 15, "trts": 8, "train": 14}
    )
    last_events: int = 256
    delay_clip_s: int = 1800
    headway_limit_s: float = 147.0
    distance_p50: int = 6
    distance_p90: int = 16
    train_end: datetime = datetime(2024, 1, 20)
    validation_end: datetime = datetime(2024, 1, 25)


DEFAULT = Config()
