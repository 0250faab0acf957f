"""Frozen configuration and its identities: SHA-256 over canonical JSON."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

# The versions and limits that identities are derived from.
RESOLVER_VERSION = "entity-resolver-v1"
RULE_VERSION = "channel-filter-v1"
RUBRIC_VERSION = "score_rubric_2026_06_v1"
OPPORTUNITY_VERSION = "opportunity-rules-2026_06_v1"
PIPELINE_VERSION = "pipeline-wiring-2026_06_v1"
MANIFEST_FORMAT = "sg8-compute-manifest-v1"
COMPARISON_CONTRACT = "sg8-pass-v1"


# The bodies that are hashed below, and the manifest, are fixed values too: their keys and texts make the identities.


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, non-ASCII and nulls kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


class ConfigError(ValueError):
    """A configuration that contradicts itself (gate G19)."""


@dataclass(frozen=True)
class FilterRule:
    version: str = RULE_VERSION
    most_videos: int = 60

    @property
    def hash(self) -> str:
        off = dict.fromkeys(("MIN_PUBLIC_UPLOADS", "MIN_SUBSCRIBERS", "MIN_CHANNEL_VIEWS", "DUP_TITLE_CAP"), "disabled")
        return digest(
            {
                "rule_version": self.version,
                "normalizer": f"{RESOLVER_VERSION}:normalize_for_match",
                "gates_ordered": ["self_channel", "run_domination"],
                "reason_codes": ["eligible", "self_channel", "run_domination", "human_override"],
                "constants": off | {"MAX_RUN_VIDEOS_PER_CHANNEL": self.most_videos},
            }
        )


@dataclass(frozen=True)
class Rubric:
    version: str = RUBRIC_VERSION
    velocity: Decimal = Decimal("0.40")
    signals: Decimal = Decimal("0.25")
    engagement: Decimal = Decimal("0.20")
    diversity: Decimal = Decimal("0.15")
    velocity_percentile: Decimal = Decimal("0.90")
    engagement_percentile: Decimal = Decimal("0.90")
    signals_cap: int = 20
    diversity_target: int = 15
    half_life_days: Decimal = Decimal("15")
    age_floor_days: Decimal = Decimal("1")
    precision: int = 50

    def __post_init__(self) -> None:
        if self.velocity + self.signals + self.engagement + self.diversity != 1:
            raise ConfigError("the weights must add up to 1")
        if min(self.signals_cap, self.diversity_target, self.precision) < 1 or min(self.half_life_days, self.age_floor_days) <= 0:
            raise ConfigError("caps, precision, half-life and age floor must be positive")

    @property
    def hash(self) -> str:
        return digest(
            {
                "rubric_version": self.version,
                "weights": {"velocity": str(self.velocity), "signals": str(self.signals), "engagement": str(self.engagement), "diversity": str(self.diversity)},
                "components_ordered": ["velocity_normalized", "signals", "engagement_recency_weighted", "channel_diversity"],
                "constants": {"AGE_FLOOR_DAYS": str(self.age_floor_days), "P_VEL": str(self.velocity_percentile), "P_ENG": str(self.engagement_percentile), "SIGNALS_SAT_CAP": self.signals_cap, "DIVERSITY_TARGET": self.diversity_target, "HALF_LIFE_DAYS": str(self.half_life_days)},
                "curves": {"velocity": "percentile_anchor_cap", "engagement": "percentile_anchor_cap", "signals": "ln_saturating", "diversity": "ln_saturating", "recency": "exponential_half_life"},
                "method": {"percentile": "linear_interpolation_inclusive", "recency": "exp_ln_decimal_correctly_rounded", "decimal_precision": self.precision, "intermediate_rounding": "ROUND_HALF_EVEN", "final_rounding": "ROUND_HALF_UP"},
                "reference_set": "run_scored_artists",
                "temporal_reference": "report_runs.window_end",
                "null_policy": "null_never_zero",
            }
        )


@dataclass(frozen=True)
class ReportRules:
    version: str = OPPORTUNITY_VERSION
    hot_above: int = 90
    hot_most: int = 2
    shown_from: int = 83
    items_most: int = 10
    low_channels: int = 5
    high_channels: int = 15
    growth_above: Decimal = Decimal("0.50")
    growth_days: int = 7

    def __post_init__(self) -> None:
        if self.hot_most < 0 or self.items_most < 1 or self.hot_above < self.shown_from:
            raise ConfigError("HOT must imply shown, and limits must be positive")
        if not 0 <= self.low_channels < self.high_channels or self.growth_above < 0 or self.growth_days < 1:
            raise ConfigError("competition thresholds must be ordered")

    @property
    def hash(self) -> str:
        return digest(
            {
                "opportunity_version": self.version,
                "ranking_key": ["final_score_desc", "velocity_component_desc", "signals_component_desc", "artist_id_asc"],
                "hot": {"score_min_exclusive": self.hot_above, "max": self.hot_most},
                "display_gate": {"score_min_inclusive": self.shown_from},
                "composition": {"max_report_items": self.items_most, "insufficient_status": "insufficient_opportunity"},
                "competition": {"low_channel_max": self.low_channels, "high_channel_max": self.high_channels, "growth_high_pct": str(self.growth_above), "growth_window_days": self.growth_days, "prior_zero_rule": "no-trigger"},
                "example": {"candidate_order": "vel_desc, video_id_asc", "top_n": 3, "select_primary": "most_recent_published_at", "select_secondary": "max_views_absolute", "select_final": "min_video_id"},
                "formatting": {"title_suffix": " Type Beat", "velocity_thousand_threshold": "1000", "velocity_thousand_suffix": "k/day", "velocity_below_suffix": "/day", "velocity_rounding": "ROUND_HALF_UP", "example_url_prefix": "https://www.youtube.com/watch?v=", "score_display_format": "{final_score}/100"},
            }
        )


def manifest_hash(engine_name: str, rule: FilterRule | None = None, rubric: Rubric | None = None, rules: ReportRules | None = None) -> str:
    """The identity of all that determines a result but its data. The engine's name is the caller's."""
    rule, rubric, rules = rule or FilterRule(), rubric or Rubric(), rules or ReportRules()
    return digest(
        {
            "manifest_format_version": MANIFEST_FORMAT,
            "engine_name": engine_name,
            "engine_version": PIPELINE_VERSION,
            "pipeline_version": PIPELINE_VERSION,
            "resolver_version": RESOLVER_VERSION,
            "rule_version": rule.version,
            "rule_hash": rule.hash,
            "rubric_version": rubric.version,
            "rubric_hash": rubric.hash,
            "opportunity_version": rules.version,
            "opportunity_hash": rules.hash,
        }
    )
