"""Settings of all jobs; pass a changed copy to override."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # fixed values throughout: weights of the five dimensions; each in (0, 1], their sum 1 within 0.01
    weights: dict[str, float] = field(
        default_factory=lambda: {"timing": 0.20, "sequence": 0.35, "protocol": 0.25, "credential": 0.10, "target": 0.10}
    )
    auto_threshold: float = 0.80
    uncertain_threshold: float = 0.60
    six_month_threshold: float = 0.85
    twelve_month_threshold: float = 0.90
    min_events: int = 10
    min_confidence: float = 0.20
    active_days: int = 7
    dormant_days: int = 90
    nudge: float = 0.02
    weight_floor: float = 0.05
    weight_ceiling: float = 0.60
    min_reviews: int = 3
    review_gate: float = 0.70
    drift_composite: float = 0.65
    drift: dict[str, float] = field(
        default_factory=lambda: {"timing": 0.60, "sequence": 0.55, "protocol": 0.60, "credential": 0.55, "target": 0.60}
    )
    density_observations: int = 20
    density_ips: int = 5
    density_hours: float = 168.0
    suggestion_score: float = 0.85
    suggestion_limit: int = 20
    session_gap_seconds: int = 1800
    port_sequence: int = 50
    port_freq: int = 20
    credentials: int = 50
    event_types: int = 50

    def __post_init__(self) -> None:
        if any(not 0 < w <= 1 for w in self.weights.values()) or abs(sum(self.weights.values()) - 1) > 0.01:
            raise ValueError("weights are in (0, 1] and add up to 1")


DIMENSIONS = ("timing", "sequence", "protocol", "credential", "target")
DEFAULT = Config()
