"""Settings of the estimators and of visual matching."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults below are fixed values: results depend on them.


@dataclass(frozen=True)
class DemandPolicy:
    """Settings of the demand model."""

    censor_sell_through: float = 0.95
    group_shrinkage_rows: float = 8.0
    similarity_exponent: float = 4.0
    minimum_log_sigma: float = 0.55
    maximum_log_sigma: float = 1.50
    fallback_horizon_weeks: float = 38.0
    maximum_analogues: int = 4
    wide_effective_n: float = 2.0
    wide_skew_ratio: float = 1.5
    ceiling_multiplier: float = 1.25
    ceiling_floor: float = 500.0
    point_skew: float = 0.75
    pack: int = 25
    flat_ceiling: int = 2000
    target_sell_through: float = 0.70


@dataclass(frozen=True)
class MatchPolicy:
    """Settings of candidate retrieval, gates and score blending."""

    candidates: int = 50
    same_item_type: bool = True
    same_design: bool = False
    visual_only: bool = True
    pattern_gate: bool = True
    pattern_limit: float = 0.42
    colour_gate: bool = True
    colour_limit: float = 0.20
    palette_least: float = 1e-6
    detail_weight: float = 0.5833333333
    neural_weight: float = 0.45
    colour_weight: float = 0.45
    texture_weight: float = 0.10
    minimum_score: float = 0.50
    high_score: float = 0.84
    published: int = 4

    def __post_init__(self) -> None:
        weights = (self.neural_weight, self.colour_weight, self.texture_weight)
        if min(weights) < 0 or abs(sum(weights) - 1) > 1e-6:
            raise ValueError("weights must not be negative and must sum to 1")
        if not 0 <= self.detail_weight <= 1:
            raise ValueError("detail_weight must be between 0 and 1")


DEMAND, MATCH = DemandPolicy(), MatchPolicy()
