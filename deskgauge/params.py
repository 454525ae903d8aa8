"""Fixed policy values and tunable parameters.

Everything here is plain driver-side configuration; operators take these objects as arguments and turn them into
literals, so a changed rate or threshold never needs a changed plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: ticket states, targets and money rates --------------------------------------------------------
COMPLETED_STATUSES = ("resolved", "closed")
OPEN_STATUSES = ("open", "pending")
SLA_TARGET_MINUTES = {"chat": 15, "voice": 120, "social": 240, "email": 480}
CONTACT_COST = {"chat": 210.0, "email": 260.0, "voice": 520.0, "social": 240.0}
TRANSFER_COST = 305.0
SLA_CREDIT = 350.0
REPLACEMENT_LOGISTICS_COST = 340.0
REPORTING_ZONE = "Asia/Kolkata"
LEGACY_SOURCE = "legacy_fd"

# --- fixed values: columns that identify one effective-dated assignment of an agent ------------------------------
ASSIGNMENT = (
    "agent_id",
    "agent_team",
    "agent_tier",
    "agent_site",
    "agent_shift",
    "agent_from_date",
    "agent_to_date",
)


@dataclass(frozen=True)
class Outcome:
    """One adjusted outcome: where its value lives and how its columns are named in results."""

    name: str
    eligible: str
    value: str
    raw: str
    peer: str
    bounds: tuple[float, float] | None
    gap_bounds: tuple[float, float] | None
    adverse_sign: int
    # sums of squares are taken about this value; it only has to be of the order of the data
    centre: float = 0.0

    @property
    def gap(self) -> str:
        return f"{self.name}_gap"


OUTCOMES = (
    Outcome("csat", "valid_for_csat", "csat_score_numeric", "raw_mean_csat", "peer_mean_csat", (1, 5), (-4, 4), -1, 3.0),
    Outcome(
        "handle_time",
        "valid_for_handle_time",
        "handle_time_minutes",
        "raw_handle_time_mean",
        "peer_handle_time_mean",
        None,
        None,
        1,
    ),
    Outcome(
        "sla", "valid_for_sla", "sla_breach_flag", "raw_sla_breach_rate", "peer_sla_breach_rate", (0, 1), (-1, 1), 1
    ),
)


@dataclass(frozen=True)
class ServicePolicy:
    """Rates and targets applied to tickets."""

    zone: str = REPORTING_ZONE
    sla_targets: dict = field(default_factory=lambda: dict(SLA_TARGET_MINUTES))
    contact_cost: dict = field(default_factory=lambda: dict(CONTACT_COST))
    transfer_cost: float = TRANSFER_COST
    sla_credit: float = SLA_CREDIT
    logistics_cost: float = REPLACEMENT_LOGISTICS_COST
    repeat_window_days: int = 30
    minimum_support: int = 30


@dataclass(frozen=True)
class PeerSpec:
    """Support floors for peer pools and work-mix cells."""

    min_agents: int = 3
    min_cell_observations: int = 5
    min_cell_agents: int = 2
    z: float = 1.96


@dataclass(frozen=True)
class DecisionConfig:
    """Gates, weights and scales of the priority decision."""

    minimum_agent_tickets: int = 30
    minimum_metric_observations: int = 30
    minimum_adjustment_coverage: float = 0.70
    minimum_roster_coverage: float = 0.70
    minimum_peer_agents: int = 3
    high_evidence_observations: int = 60
    high_evidence_peer_agents: int = 5
    require_interval_excludes_zero: bool = True
    weight_csat: float = 0.40
    weight_handle_time: float = 0.35
    weight_sla: float = 0.25
    csat_gap_scale: float = 0.5
    handle_time_relative_gap_scale: float = 0.25
    sla_gap_scale: float = 0.05
    medium_priority_score: float = 25.0
    high_priority_score: float = 55.0
    factor_persistent: float = 1.0
    factor_mixed: float = 0.8
    factor_single_period: float = 0.65
    factor_no_clear_adverse_period_signal: float = 0.55
    factor_insufficient_history: float = 0.4
    training_budget: float = 400000.0
    goal_reduction_points: float = 1.0


# --- fixed values: decision scenarios, as overrides of the default configuration ---------------------------------
_CONSERVATIVE = {
    "factor_mixed": 0.5,
    "factor_single_period": 0.35,
    "factor_no_clear_adverse_period_signal": 0.35,
    "factor_insufficient_history": 0.2,
}
_CSAT_HEAVY = {"weight_csat": 0.6, "weight_handle_time": 0.25, "weight_sla": 0.15}
_OPERATIONAL = {"weight_csat": 0.25, "weight_handle_time": 0.4, "weight_sla": 0.35}
SENSITIVITY_SCENARIOS = {
    "default": {},
    "alternate_weights_csat_heavy": _CSAT_HEAVY,
    "alternate_weights_operational": _OPERATIONAL,
    "gap_scales_narrower": {"csat_gap_scale": 0.4, "handle_time_relative_gap_scale": 0.20, "sla_gap_scale": 0.04},
    "gap_scales_wider": {"csat_gap_scale": 0.7, "handle_time_relative_gap_scale": 0.35, "sla_gap_scale": 0.07},
    "minimum_evidence_20": {"minimum_metric_observations": 20, "minimum_agent_tickets": 20},
    "minimum_evidence_60": {"minimum_metric_observations": 60, "minimum_agent_tickets": 60},
    "point_estimate_only_exploratory": {"require_interval_excludes_zero": False},
    "conservative_stability": _CONSERVATIVE,
}
DECISION_SCENARIOS = {
    "default_uncertainty_gate": {},
    "point_estimate_only_exploratory": {"require_interval_excludes_zero": False},
    "minimum_evidence_20": {"minimum_metric_observations": 20, "minimum_agent_tickets": 20},
    "strict_evidence_60": {"minimum_metric_observations": 60, "minimum_agent_tickets": 60},
    "alternate_weights_csat_heavy": _CSAT_HEAVY,
    "alternate_weights_operational": _OPERATIONAL,
    "conservative_stability_penalty": _CONSERVATIVE,
}
EXPLORATORY_SCENARIO = "point_estimate_only_exploratory"
