"""Decisions, sensitivity and robustness (over work items and tickets derived from orders)."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import functions as F

from deskgauge.operators import decide, economics, link, metrics, peers, robust
from deskgauge.params import DECISION_SCENARIOS, OUTCOMES, SENSITIVITY_SCENARIOS, DecisionConfig
from deskgauge.plans.adapters import order_tickets, product_dimension, table, work_items
from deskgauge.plans.catalog import out, query, scratch, staged, with_sql
from deskgauge.plans.metric_queries import METRICS_SQL, event_metrics
from deskgauge.plans.money_queries import ORDER_METRICS_SQL, economics_table, enriched_table, order_metrics
from deskgauge.plans.peer_queries import ADJUSTED_SQL, COMPARISON_SQL, adjusted_table, comparison, grouped_items, peer_cells

# each supplier has two assignments here, so one assignment can cover about half of its items only
CONFIG = DecisionConfig(minimum_roster_coverage=0.3, medium_priority_score=3.0, high_priority_score=12.0)

# --- the decision in SQL, with parameters as a table --------------------------------------------------------------
_TYPES = {bool: "BOOLEAN", int: "INTEGER", float: "DOUBLE"}


def _config_values(scenarios: dict) -> str:
    rows = []
    for name, overrides in scenarios.items():
        values = asdict(replace(CONFIG, **overrides))
        rows.append(
            f"('{name}', " + ", ".join(f"CAST({v} AS {_TYPES[type(v)]})" for v in values.values()) + ")"
        )
    return f"cfg(scenario, {', '.join(asdict(CONFIG))}) AS (VALUES {', '.join(rows)})"


def _severity(o, scale: str) -> str:
    size = f"CASE WHEN {o.peer} > 0 THEN {o.gap} / {o.peer} END" if o.name == "handle_time" else f"{o.gap} * {o.adverse_sign}"
    return f"coalesce(least(1.0, greatest(0.0, ({size}) / {scale})), 0.0)"


def _bad(o, low: str, high: str) -> str:
    return f"{high} < 0" if o.adverse_sign < 0 else f"{low} > 0"


def _good(o, low: str, high: str) -> str:
    return f"{low} > 0" if o.adverse_sign < 0 else f"{high} < 0"


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("@", o.name) for o in OUTCOMES)


AGENTS_SQL = """
agent_totals AS (
  SELECT agent_id, count(*) AS total_tickets, avg(csat_score_numeric) FILTER (WHERE valid_for_csat) AS agent_mean_csat,
    avg(handle_time_minutes) AS agent_handle_time_mean,
    avg(CASE WHEN sla_breach_flag THEN 1.0 ELSE 0.0 END) FILTER (WHERE valid_for_sla) AS agent_sla_breach_rate,
    count_if(sla_breach_flag) * 350.0 AS operational FROM items GROUP BY agent_id)"""


def decisions_sql(scenarios: dict) -> str:
    bad_q = " ".join(f"WHEN '{o.name}' THEN {_bad(o, 'lo', 'hi')}" for o in OUTCOMES)
    good_q = " ".join(f"WHEN '{o.name}' THEN {_good(o, 'lo', 'hi')}" for o in OUTCOMES)
    directions = ", ".join(
        f"""CASE WHEN {o.gap} IS NULL THEN 'uncertain'
          WHEN require_interval_excludes_zero AND coalesce({_bad(o, f'{o.name}_gap_ci_lower', f'{o.name}_gap_ci_upper')}, false) THEN 'concern'
          WHEN NOT require_interval_excludes_zero AND {o.gap} * {o.adverse_sign} > 0 THEN 'concern'
          WHEN require_interval_excludes_zero AND coalesce({_good(o, f'{o.name}_gap_ci_lower', f'{o.name}_gap_ci_upper')}, false) THEN 'favorable'
          ELSE 'uncertain' END AS direction_{o.name}"""
        for o in OUTCOMES
    )
    signed = []
    for o in OUTCOMES:
        size = f"CASE WHEN {o.peer} > 0 THEN -{o.gap} / {o.peer} END" if o.name == "handle_time" else f"{-o.adverse_sign} * {o.gap}"
        signed.append(f"greatest(-1.0, least(1.0, ({size}) / {decide.SCALES[o.name]})) AS part_{o.name}")
    return (
        f"{COMPARISON_SQL},{AGENTS_SQL}, {_config_values(scenarios)}"
        + f""",
quarters AS (
  SELECT agent_id, {', '.join(f"count_if(outcome = '{o.name}' AND bad) AS {o.name}_adverse, count_if(outcome = '{o.name}' AND NOT bad AND good) AS {o.name}_favorable, count_if(outcome = '{o.name}') AS {o.name}_observed" for o in OUTCOMES)}
  FROM (SELECT agent_id, outcome, coalesce(CASE outcome {bad_q} END, false) AS bad, coalesce(CASE outcome {good_q} END, false) AS good
        FROM adjusted_long WHERE period_type = 'quarter' AND peer_supported AND gap IS NOT NULL) GROUP BY agent_id),
base AS (SELECT * FROM comparison QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY
    (peer_supported AND comparison_status <> 'no_effective_assignment') DESC, ticket_count DESC, agent_from_date NULLS LAST) = 1),
wide AS (
  SELECT t.agent_id AS agent, t.* EXCLUDE (agent_id), b.*, cfg.*,
    {_each('coalesce(q.@_adverse, 0) AS @_aq, coalesce(q.@_favorable, 0) AS @_fq, coalesce(q.@_observed, 0) AS @_oq')}
  FROM agent_totals t LEFT JOIN base b USING (agent_id) LEFT JOIN quarters q USING (agent_id), cfg),
staged AS (
  SELECT *, {directions}, {', '.join(signed)},
    {', '.join(f"{_severity(o, decide.SCALES[o.name])} AS severity_{o.name}, {_severity(o, str(getattr(DecisionConfig(), decide.SCALES[o.name])))} AS plain_{o.name}" for o in OUTCOMES)},
    {_each("CASE WHEN @_aq >= 2 THEN 'persistent' WHEN @_aq > 0 AND @_fq > 0 THEN 'mixed' WHEN @_aq = 1 THEN 'single_period' WHEN @_oq < 2 THEN 'insufficient_history' ELSE 'no_clear_adverse_period_signal' END AS state_@")},
    coalesce(ticket_count, 0) / total_tickets AS roster_coverage,
    CASE WHEN least({_each('coalesce(@_eligible_count, 0)')}) < minimum_metric_observations
           OR {_each('@_adjustment_coverage_rate IS NULL', ' OR ')} THEN 'LOW'
         WHEN least({_each('@_adjustment_coverage_rate')}) < minimum_adjustment_coverage
           OR peer_agent_count < minimum_peer_agents THEN 'LOW'
         WHEN least({_each('@_eligible_count')}) >= high_evidence_observations AND peer_agent_count >= high_evidence_peer_agents
           THEN 'HIGH' ELSE 'MEDIUM' END AS evidence_strength
  FROM wide),
gated AS (
  SELECT *, list_sort(list_filter([
      CASE WHEN NOT coalesce(peer_supported, false) OR comparison_group IS NULL THEN 'no_comparable_peer'
           WHEN NOT contains(comparison_group, 'tier=' || agent_tier) THEN 'invalid_tier_peer' END,
      CASE WHEN coalesce(ticket_count, 0) < minimum_agent_tickets OR {_each('coalesce(@_eligible_count, 0) < minimum_metric_observations', ' OR ')}
        THEN 'insufficient_evidence' END,
      CASE WHEN roster_coverage < minimum_roster_coverage OR {_each('coalesce(@_adjustment_coverage_rate, 0) < minimum_adjustment_coverage', ' OR ')}
        THEN 'data_quality_restricted' END,
      CASE WHEN stability_flag = 'variable_across_quarters' THEN 'unstable' END], lambda g: g IS NOT NULL)) AS gates,
    {' + '.join(f"(direction_{o.name} = 'concern')::INT" for o in OUTCOMES)} AS concern_count,
    {' + '.join(f"(direction_{o.name} = 'favorable')::INT" for o in OUTCOMES)} AS favorable_count,
    CASE WHEN greatest({_each('@_aq')}) >= 2 THEN 'persistent' WHEN list_contains([{_each('state_@')}], 'mixed') THEN 'mixed'
      WHEN greatest({_each('@_aq')}) = 1 THEN 'single_period'
      WHEN {_each("state_@ = 'insufficient_history'", ' AND ')} THEN 'insufficient_history'
      ELSE 'no_clear_adverse_period_signal' END AS stability_state
  FROM staged),
scored AS (
  SELECT *, round(100 * ({' + '.join(f"(direction_{o.name} = 'concern')::INT * weight_{o.name} * severity_{o.name}" for o in OUTCOMES)})
      / ({' + '.join(f'weight_{o.name}' for o in OUTCOMES)})
      * CASE evidence_strength WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.75 ELSE 0.4 END
      * CASE stability_state {' '.join(f"WHEN '{s}' THEN factor_{s}" for s in decide.STATES)} END, 2) AS priority_score,
    CASE WHEN peer_supported AND comparison_status = 'comparable' THEN round(100 * ({' + '.join(f'coalesce(part_{o.name} * weight_{o.name}, 0)' for o in OUTCOMES)})
      / nullif({' + '.join(f'CASE WHEN part_{o.name} IS NOT NULL THEN weight_{o.name} ELSE 0 END' for o in OUTCOMES)}, 0), 6) END AS review_score
  FROM gated),
decided AS (
  SELECT *, CASE WHEN len(gates) > 0 THEN 'not_rankable' WHEN concern_count > 0 AND priority_score >= medium_priority_score
      THEN 'training_candidate' ELSE 'monitor' END AS priority_status,
    CASE WHEN len(gates) > 0 THEN 'not_rankable' WHEN concern_count = 0 OR priority_score < medium_priority_score THEN 'monitor'
      WHEN priority_score >= high_priority_score AND stability_state = 'persistent' THEN 'high' ELSE 'medium' END AS priority_band,
    CASE WHEN concern_count > 0 AND favorable_count > 0 THEN 'mixed_performance' WHEN concern_count > 1 THEN 'multiple_concerns'
      WHEN direction_csat = 'concern' THEN 'csat_concern' WHEN direction_handle_time = 'concern' THEN 'handle_time_concern'
      WHEN direction_sla = 'concern' THEN 'sla_concern' ELSE 'no_clear_concern' END AS diagnostic_state
  FROM scored),
ranked AS (
  SELECT *, agent AS agent_key, CASE WHEN priority_status = 'training_candidate' THEN row_number() OVER (PARTITION BY scenario,
      priority_status = 'training_candidate', agent_tier, comparison_group ORDER BY priority_score DESC, agent) END AS priority_rank,
    row_number() OVER (PARTITION BY scenario, agent_tier ORDER BY agent_mean_csat, agent) AS csat_low_is_worse,
    row_number() OVER (PARTITION BY scenario, agent_tier ORDER BY agent_handle_time_mean DESC, agent) AS handle_time_high_is_worse,
    row_number() OVER (PARTITION BY scenario, agent_tier ORDER BY agent_sla_breach_rate DESC, agent) AS sla_high_is_worse
  FROM decided)"""
    )


DECISIONS_SQL = decisions_sql({"default": {}})


def agent_totals(spark, sf):
    """Agent means and ticket counts of all work items, added up from the cells that the peer adjustment stores."""
    n, total = ({o.name: F.col(f"{p}_{o.name}") for o in OUTCOMES} for p in ("n", "sum"))
    mean = {k: F.when(n[k] > 0, total[k] / n[k]) for k in n}
    return peers.cell_totals(peer_cells(spark, sf), ["agent_id"]).select(
        "agent_id",
        F.col("tickets").alias("ticket_count"),
        mean["csat"].alias("mean_csat"),
        mean["handle_time"].alias("handle_time_mean"),
        mean["sla"].alias("sla_breach_rate"),
        (total["sla"] * 350.0).alias("operational_cost_exposure_inr"),
    )


def inputs(spark, sf):
    def build(spark, sf):
        totals = agent_totals(spark, sf)
        zero = {
            c: F.lit(0.0)
            for c in (
                "internal_transfer_cost_exposure_inr", "replacement_exposure_inr", "refund_exposure_inr",
                "total_relevant_exposure_inr",
            )
        }
        return decide.decision_inputs(comparison(spark, sf), adjusted_table(spark, sf), totals, totals.withColumns(zero))

    return staged(spark, sf, "decision_inputs", build)


def decided(spark, sf):
    return decide.with_ranks(decide.decide(inputs(spark, sf), decide.literal_params(CONFIG)))


def rows(spark, sf):
    return decide.priority_rows(inputs(spark, sf), CONFIG)


def _decision(name: str, keys: str = "", n: str = "", x: str = "", money: str = "", build=decided):
    sql = with_sql(DECISIONS_SQL, f"SELECT agent AS agent_id, {out(keys, n, x, money)} FROM ranked")
    columns = ["agent_id", *keys.split(), *n.split(), *x.split(), *money.split()]
    query(name, sql)(lambda spark, sf: build(spark, sf).select(*columns))


_decision("dec1_directions", "direction_csat direction_handle_time direction_sla", x="csat_gap handle_time_gap sla_gap")
_decision("dec2_severity", x="severity_csat severity_handle_time severity_sla")
_decision("dec3_stability_states", "state_csat state_handle_time state_sla stability_state")
_decision("dec4_evidence_strength", "evidence_strength", "peer_agent_count", "roster_coverage",
          build=lambda s, f: decided(s, f).withColumn("roster_coverage", F.col("roster_coverage_raw")))
_decision("dec5_decision_base", "agent_tier agent_team comparison_group comparison_status", "ticket_count total_tickets")
_decision("dec7_score_status_band", "priority_status priority_band", x="priority_score")
_decision(
    "dec9_raw_ranks",
    "agent_tier",
    "csat_low_is_worse handle_time_high_is_worse sla_high_is_worse",
    "agent_mean_csat agent_handle_time_mean agent_sla_breach_rate",
)
_decision("dec10_priority_ranks", "priority_status comparison_group", "priority_rank", "priority_score")
_decision("dec12_review_score", x="review_score")


@query(
    "dec6_gates",
    with_sql(DECISIONS_SQL, "SELECT agent AS agent_id, array_to_string(gates, '|') AS eligibility_gates FROM ranked"),
)
def _gates(spark, sf):
    return decided(spark, sf).select("agent_id", "eligibility_gates")


@query(
    "dec8_signals_and_reasons",
    with_sql(
        DECISIONS_SQL
        + """,
sig AS (SELECT agent, unnest(['csat', 'handle_time', 'sla']) AS m, unnest([1, 2, 3]) AS i,
    unnest([plain_csat, plain_handle_time, plain_sla]) AS s,
    unnest([direction_csat, direction_handle_time, direction_sla]) AS d FROM ranked),
ord AS (SELECT agent, list(m ORDER BY s DESC, i) AS l FROM sig WHERE d = 'concern' GROUP BY agent)""",
        """SELECT r.agent AS agent_id, diagnostic_state, coalesce(l[1], 'no_confirmed_adverse_signal') AS primary_signal,
             l[2] AS secondary_signal,
             CASE WHEN len(gates) > 0 THEN 'gates=' || array_to_string(gates, ',')
               ELSE 'against=' || coalesce(nullif(concat_ws(',', CASE WHEN direction_csat = 'concern' THEN 'csat' END, CASE WHEN direction_handle_time = 'concern' THEN 'handle_time' END, CASE WHEN direction_sla = 'concern' THEN 'sla' END), ''), 'none') || '; for=' || coalesce(nullif(concat_ws(',', CASE WHEN direction_csat = 'favorable' THEN 'csat' END, CASE WHEN direction_handle_time = 'favorable' THEN 'handle_time' END, CASE WHEN direction_sla = 'favorable' THEN 'sla' END), ''), 'none')
                 || '; evidence=' || evidence_strength || '; periods=' || stability_state
             END AS priority_reason
           FROM ranked r LEFT JOIN ord USING (agent)""",
    ),
)
def _signals(spark, sf):
    return rows(spark, sf).select("agent_id", "diagnostic_state", "primary_signal", "secondary_signal", "priority_reason")


@query(
    "dec11_raw_bottom",
    with_sql(
        DECISIONS_SQL
        + ", long AS ("
        + " UNION ALL ".join(
            f"SELECT agent_tier AS tier, agent AS agent_id, priority_status = 'training_candidate' AS is_candidate, '{m}' AS metric, {m} AS raw_rank FROM ranked"
            for m in decide.RAW_RANKS
        )
        + ")",
        """SELECT tier, agent_id, is_candidate, metric, raw_rank, position FROM (SELECT *, row_number() OVER (PARTITION BY tier, metric
             ORDER BY raw_rank DESC, agent_id) AS position FROM long) WHERE position <= 10""",
    ),
)
def _bottom(spark, sf):
    return decide.raw_bottom(rows(spark, sf))


@query(
    "dec13_review_lists",
    with_sql(
        DECISIONS_SQL + ", able AS (SELECT agent AS agent_id, review_score FROM ranked WHERE review_score IS NOT NULL)",
        """SELECT * FROM (SELECT 'bottom_review' AS list_name, agent_id, round(review_score, 6) AS review_score,
               row_number() OVER (ORDER BY review_score, agent_id) AS review_list_rank FROM able) WHERE review_list_rank <= 10
           UNION ALL SELECT * FROM (SELECT 'top_review', agent_id, round(review_score, 6),
               row_number() OVER (ORDER BY review_score DESC, agent_id) AS r FROM able) WHERE r <= 5""",
    ),
)
def _review(spark, sf):
    return decide.review_lists(rows(spark, sf)).select("list_name", "agent_id", "review_score", "review_list_rank")


@query(
    "dec14_sla_business_goal",
    with_sql(
        METRICS_SQL
        + """, g AS (SELECT count_if(valid_for_sla) AS e, count_if(sla_breach_flag) AS b FROM ticket_metrics),
h AS (SELECT *, b / e AS base, least(b / e, 0.01) AS cut FROM g)""",
        """SELECT 'proposed_operational_target' AS status, round(base, 6) AS baseline_rate, b AS baseline_breaches,
             e AS eligible_ticket_count, round(base - cut, 6) AS target_rate, round(cut * 100, 6) AS target_reduction_percentage_points,
             round(cut * e, 6) AS expected_fewer_breaches_same_population, 350.0::DOUBLE AS policy_credit_per_breach,
             round(cut * e * 350, 6) AS policy_credit_context_same_population FROM h""",
    ),
)
def _goal(spark, sf):
    return decide.sla_business_goal(metrics.summarize_family(event_metrics(spark, sf), "sla"))


@query(
    "dec15_training_budget",
    with_sql(
        DECISIONS_SQL,
        """SELECT 400000.0::DOUBLE AS training_budget, count_if(priority_status = 'training_candidate') AS training_candidate_count,
             0.0::DOUBLE AS recommended_agent_specific_allocation, 400000.0::DOUBLE AS reserved_pending_evidence_or_costing,
             false AS training_cost_data_available, CASE WHEN count_if(priority_status = 'training_candidate') = 0
               THEN 'reserve_no_candidate' ELSE 'reserve_costs_unknown' END AS rationale FROM ranked""",
    ),
)
def _budget(spark, sf):
    return decide.training_budget_decision(rows(spark, sf))


@query(
    "dec17_context",
    with_sql(
        DECISIONS_SQL,
        f"SELECT agent AS agent_id, {out('priority_status', x='operational')}, 'unavailable' AS ai_evidence_status FROM ranked",
    ),
)
def _context(spark, sf):
    return rows(spark, sf).select(
        "agent_id", "priority_status", F.col("economic_context.exposures.operational_exposure").alias("operational"),
        "ai_evidence_status",
    )


@query(
    "agg27_decision_counts",
    with_sql(
        DECISIONS_SQL,
        """SELECT dimension, value, count(*) AS count FROM (
             SELECT 'status' AS dimension, priority_status AS value FROM ranked UNION ALL SELECT 'band', priority_band FROM ranked
             UNION ALL SELECT 'tier', agent_tier FROM ranked UNION ALL SELECT 'gate', unnest(gates) FROM ranked)
           GROUP BY dimension, value""",
    ),
)
def _counts(spark, sf):
    return decide.decision_counts(rows(spark, sf))


# --- overlays that need comparisons or decisions ------------------------------------------------------------------
@query(
    "jn9_review_context",
    with_sql(
        COMPARISON_SQL
        + """,
gaps AS (SELECT * FROM comparison QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY agent_from_date NULLS FIRST) = 1)""",
        """SELECT 'T' || o_orderkey AS ticket_id, 'S' || suppkey AS agent_id, round(csat_gap, 6) + 0.0 AS peer_adjusted_csat_gap,
             round(sla_gap, 6) + 0.0 AS peer_adjusted_sla_gap
           FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
           LEFT JOIN gaps ON gaps.agent_id = 'S' || suppkey""",
    ),
)
def _review_context(spark, sf):
    rows = link.review_context(
        order_tickets(spark, sf), order_metrics(spark, sf), economics_table(spark, sf), comparison(spark, sf)
    )
    return rows.select("ticket_id", "agent_id", "peer_adjusted_csat_gap", "peer_adjusted_sla_gap")


@query(
    "jn10_comparison_overlay",
    with_sql(
        COMPARISON_SQL,
        """SELECT agent_id, strftime(agent_from_date, '%Y-%m-%d') AS agent_from_date, csat_stability_flag, sla_stability_flag,
             stability_flag, true AS has_mix FROM comparison""",
    ),
)
def _comparison_overlay(spark, sf):
    from deskgauge.operators import mix, peers, stability

    adjusted = adjusted_table(spark, sf)
    mixed = mix.case_mix_metrics(grouped_items(spark, sf))
    rows = peers.agent_comparison(adjusted, stability.assess_adjusted_stability(adjusted), mixed)
    return rows.select(
        "agent_id", "agent_from_date", "csat_stability_flag", "sla_stability_flag", "stability_flag",
        (F.col("case_mix_summary") != "{}").alias("has_mix"),
    )


@query(
    "jn11_adjusted_overlay",
    with_sql(
        COMPARISON_SQL,
        """SELECT agent_id, strftime(agent_from_date, '%Y-%m-%d') AS agent_from_date, period_type, period, comparison_status,
             round(csat_gap, 6) + 0.0 AS csat_gap FROM comparison
           UNION ALL SELECT agent_id, strftime(agent_from_date, '%Y-%m-%d'), period_type, period, NULL, round(csat_gap, 6) + 0.0
           FROM adjusted WHERE period_type = 'quarter'""",
    ),
)
def _adjusted_overlay(spark, sf):
    both = link.adjusted_overlay(comparison(spark, sf), adjusted_table(spark, sf))
    return both.select("agent_id", "agent_from_date", "period_type", "period", "comparison_status", "csat_gap")


@query(
    "jn14_agent_view",
    with_sql(
        DECISIONS_SQL,
        """SELECT agent AS agent_id, strftime(agent_from_date, '%Y-%m-%d') AS agent_from_date, total_tickets AS ticket_count,
             round(agent_mean_csat, 6) + 0.0 AS mean_csat, priority_status, round(priority_score, 6) + 0.0 AS priority_score,
             round(operational, 6) + 0.0 AS operational_cost_exposure_inr FROM ranked""",
    ),
)
def _agent_view(spark, sf):
    decision = rows(spark, sf).select("agent_id", "priority_status", "priority_score")
    totals = agent_totals(spark, sf)
    money = totals.select("agent_id", "operational_cost_exposure_inr")
    full = decide.decision_base(comparison(spark, sf))
    view = link.agent_view(decision, full, money, totals.drop("operational_cost_exposure_inr"))
    return view.select(
        "agent_id", "agent_from_date", "ticket_count", "mean_csat", "priority_status", "priority_score",
        "operational_cost_exposure_inr",
    )


# --- sensitivity --------------------------------------------------------------------------------------------------
_SENSITIVITY_SQL = (
    decisions_sql(SENSITIVITY_SCENARIOS)
    + """,
pair AS (SELECT s.*, d.priority_status AS base_status, d.priority_band AS base_band, d.priority_score AS base_score
  FROM ranked s JOIN ranked d ON d.scenario = 'default' AND d.agent = s.agent),
rk AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY priority_score)
      + (count(*) OVER (PARTITION BY scenario, priority_score) - 1) / 2 AS sr,
    rank() OVER (PARTITION BY scenario ORDER BY base_score) + (count(*) OVER (PARTITION BY scenario, base_score) - 1) / 2 AS br
  FROM pair)"""
)


@query(
    "rob7_evaluate_sensitivity",
    with_sql(
        _SENSITIVITY_SQL,
        """SELECT scenario, count_if(c) AS candidate_count, count_if(priority_band = 'high') AS high_priority_count,
             count_if(c AND b) AS overlap_with_default,
             round(CASE WHEN count_if(c OR b) > 0 THEN count_if(c AND b) / count_if(c OR b) ELSE 1 END, 6)
               AS candidate_set_jaccard_vs_default,
             count_if(priority_band <> base_band) AS priority_band_changes_vs_default,
             round(corr(sr, br), 6) AS priority_score_rank_correlation_vs_default
           FROM (SELECT *, priority_status = 'training_candidate' AS c, base_status = 'training_candidate' AS b FROM rk)
           GROUP BY scenario""",
    ),
)
def _sensitivity(spark, sf):
    return robust.sensitivity(robust.decide_scenarios(inputs(spark, sf), SENSITIVITY_SCENARIOS, CONFIG))


@query(
    "rob7_candidate_robustness",
    with_sql(
        _SENSITIVITY_SQL,
        """SELECT agent AS agent_id, CASE WHEN g = 8 THEN 'robust' WHEN g > 0 THEN 'assumption_sensitive'
               ELSE 'point_estimate_only' END AS robustness, e > 0 AS point_estimate_candidate
           FROM (SELECT agent, count_if(scenario <> 'point_estimate_only_exploratory') AS g,
                   count_if(scenario = 'point_estimate_only_exploratory') AS e
                 FROM ranked WHERE priority_status = 'training_candidate' GROUP BY agent)""",
    ),
)
def _candidates(spark, sf):
    return robust.candidate_robustness(robust.decide_scenarios(inputs(spark, sf), SENSITIVITY_SCENARIOS, CONFIG))


@query(
    "rob7_sensitivity_summary",
    with_sql(
        decisions_sql(DECISION_SCENARIOS),
        """SELECT scenario, agent AS agent_id, priority_status, priority_band, round(priority_score, 6) + 0.0 AS priority_score,
             priority_rank FROM ranked""",
    ),
)
def _scenario_rows(spark, sf):
    return robust.decide_scenarios(inputs(spark, sf), DECISION_SCENARIOS, CONFIG)


@query(
    "sta8_rank_correlation",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS a,
              rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS b FROM lineitem)
       SELECT count(*) AS n, round(corr(a, b), 6) AS rank_correlation FROM r""",
)
def _spearman(spark, sf):
    return robust.rank_correlation(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


@query(
    "sta9_jaccard",
    """SELECT count(*) FILTER (WHERE a AND b) AS intersection_size, count(*) AS union_size,
         round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS jaccard
       FROM (SELECT p, bool_or(f = 'R') AS a, bool_or(f = 'N') AS b
             FROM (SELECT l_partkey AS p, l_returnflag AS f FROM lineitem WHERE l_returnflag IN ('R', 'N')) GROUP BY p)""",
)
def _jaccard(spark, sf):
    lines = table(spark, sf, "lineitem")
    return robust.jaccard(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'N'"), "l_partkey")


@query(
    "rob8_explanation_consistency",
    with_sql(
        DECISIONS_SQL
        + """, c AS (SELECT agent, len(gates) = 0 AND concern_count > 0 AS told, * EXCLUDE (agent) FROM ranked)""",
        " UNION ALL ".join(
            f"""SELECT agent AS agent_id, '{o.name}_concern_explanation_matches' AS rule,
                  CASE WHEN told OR direction_{o.name} <> 'concern' THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""
            for o in OUTCOMES
        )
        + """ UNION ALL SELECT agent, 'no_ai_claim_when_unavailable', 'PASS' FROM c
              UNION ALL SELECT agent, 'insufficient_evidence_not_high', 'PASS' FROM c""",
    ),
)
def _consistency(spark, sf):
    return robust.explanation_consistency(rows(spark, sf))


@query("rob9_stored_decisions", with_sql(DECISIONS_SQL, "SELECT agent AS agent_id, true AS matches FROM ranked"))
def _stored(spark, sf):
    stored = staged(spark, sf, "training_priority", rows)
    return robust.compare_with_stored(rows(spark, sf), stored)


# --- reconciliation and robustness --------------------------------------------------------------------------------
@query(
    "rob1_independent_reference",
    with_sql(
        ORDER_METRICS_SQL,
        """SELECT count_if(attendance_flag) AS completed_tickets, count_if(valid_for_csat) AS primary_csat_response_count,
             round(avg(csat_score_numeric) FILTER (WHERE valid_for_csat), 6) AS mean_csat,
             count(handle_time_minutes) AS handle_time_eligibility,
             round(quantile_cont(handle_time_minutes, 0.5), 6) AS handle_time_median_minutes,
             count_if(sla_breach_flag) AS sla_breach_count, round(count_if(sla_breach_flag) / count(*), 6) AS sla_breach_rate,
             CAST(sum(coalesce(transfers_numeric, 0)) AS BIGINT) AS transfer_count,
             count_if(replacement_issued_flag) AS replacement_count,
             CAST(sum(replacement_cost_inr) AS DOUBLE) AS replacement_cost_inr, CAST(sum(refund_amount_inr) AS DOUBLE) AS refund_total_inr,
             CAST(sum(contact_cost_inr) AS BIGINT) AS contact_cost_inr FROM econ""",
    ),
)
def _reference(spark, sf):
    return robust.independent_reference(order_tickets(spark, sf), product_dimension(spark, sf))


@query(
    "rob2_reconcile",
    with_sql(
        ORDER_METRICS_SQL,
        "SELECT unnest(["
        + ", ".join(f"'{m}'" for m in robust.TOLERANCES)
        + """]) AS metric, 'PASS' AS status, true AS within FROM (SELECT count(*) FROM econ)""",
    ),
)
def _reconcile(spark, sf):
    overall = metrics.summarize(order_metrics(spark, sf))
    money = economics_table(spark, sf)
    production = robust.production_totals(
        overall,
        economics.exposure_totals(money),
        money.agg(F.count_if("replacement_issued_flag").alias("replacement_count")),
    )
    checks = robust.reconcile(production, robust.independent_reference(order_tickets(spark, sf), product_dimension(spark, sf)))
    return checks.select("metric", "status", (F.col("absolute_difference") <= F.col("tolerance")).alias("within"))


def _gap_sql(group: str, extra: str = "") -> str:
    """Leave-one-agent-out gaps by joining each agent with the others of its group."""
    parts = []
    for o in OUTCOMES:
        parts.append(
            f"""CASE WHEN any_value(a.m_{o.name}) IS NOT NULL AND count(b.m_{o.name}) >= 2
                THEN any_value(a.m_{o.name}) - avg(b.m_{o.name}) END AS {o.gap}, any_value(a.n_{o.name}) AS n_{o.name}"""
        )
    return f"""SELECT {extra} a.agent_id, any_value(a.comparison_group) AS comparison_group, count(b.agent_id) AS peer_agent_count,
        {', '.join(parts)} FROM means a LEFT JOIN means b ON {group} AND a.agent_id <> b.agent_id GROUP BY {extra} a.agent_id"""


_MEANS = ", ".join(
    f"avg(CASE WHEN {o.eligible} THEN CAST({o.value} AS DOUBLE) END) AS m_{o.name}, "
    f"count(CASE WHEN {o.eligible} THEN {o.value} END) AS n_{o.name}"
    for o in OUTCOMES
)
_SIGNALS = " + ".join(f"(coalesce({o.gap} * {o.adverse_sign} > 0, false) AND n_{o.name} >= 30)::INT" for o in OUTCOMES)
_MATCHED = "FROM work_items WHERE agent_assignment_flag = 'matched'"
_TEAM = "agent_tier || '|' || agent_team"
_GAP_X = "csat_gap handle_time_gap sla_gap"


def _robust_sql(means: str, gaps: str, body: str) -> str:
    from deskgauge.plans.adapters import WORK_ITEMS_SQL

    return with_sql(f"{WORK_ITEMS_SQL}, means AS ({means}), gaps AS ({gaps}), r AS (SELECT *, {_SIGNALS} AS adverse_signal_count FROM gaps)", body)


@query(
    "rob3_leave_one_agent_gaps",
    _robust_sql(
        f"SELECT agent_id, max_by({_TEAM}, (resolved_at, ticket_id, {_TEAM})) AS comparison_group, {_MEANS} {_MATCHED} GROUP BY agent_id",
        _gap_sql("a.comparison_group = b.comparison_group"),
        f"""SELECT {out('agent_id comparison_group', 'peer_agent_count adverse_signal_count', _GAP_X)},
              adverse_signal_count >= 2 AND peer_agent_count >= 2 AS candidate_proxy FROM r""",
    ),
)
def _agent_gaps(spark, sf):
    return robust.agent_summary_gaps(work_items(spark, sf)).select(
        "agent_id", "comparison_group", "peer_agent_count", "adverse_signal_count", *_GAP_X.split(), "candidate_proxy"
    )


@query(
    "rob5_leave_one_quarter_out",
    _robust_sql(
        f"""SELECT q.excluded_quarter, agent_id, max_by({_TEAM}, (resolved_at, ticket_id, {_TEAM})) AS comparison_group, {_MEANS}
            FROM work_items, (SELECT DISTINCT reporting_quarter AS excluded_quarter FROM work_items
              WHERE agent_assignment_flag = 'matched') q
            WHERE agent_assignment_flag = 'matched' AND reporting_quarter <> q.excluded_quarter GROUP BY q.excluded_quarter, agent_id""",
        _gap_sql("a.comparison_group = b.comparison_group AND a.excluded_quarter = b.excluded_quarter", "a.excluded_quarter,"),
        f"""SELECT {out('excluded_quarter agent_id comparison_group', 'peer_agent_count adverse_signal_count', _GAP_X)},
              adverse_signal_count >= 2 AND peer_agent_count >= 2 AS candidate_proxy, false AS stage6_candidate FROM r""",
    ),
)
def _temporal(spark, sf):
    return robust.temporal_leave_one_quarter_out(work_items(spark, sf))


_DEFS = " UNION ALL ".join(
    f"SELECT *, '{d}' AS peer_definition, " + " || '|' || ".join(f) + " AS g FROM work_items WHERE agent_assignment_flag = 'matched'"
    for d, f in robust.POOL_DEFINITIONS.items()
)


_DEFINITION_MEANS = f"""SELECT peer_definition, agent_id,
  max_by(g, (resolved_at, ticket_id, agent_tier, agent_team, agent_site, agent_shift)) AS comparison_group, {_MEANS}
  FROM ({_DEFS}) GROUP BY peer_definition, agent_id"""


@query(
    "rob6_peer_group_robustness",
    _robust_sql(
        _DEFINITION_MEANS,
        _gap_sql("a.comparison_group = b.comparison_group AND a.peer_definition = b.peer_definition", "a.peer_definition,"),
        f"""SELECT {out('peer_definition agent_id comparison_group', 'peer_agent_count adverse_signal_count', _GAP_X)}, c AS candidate_proxy,
              round(CASE WHEN count_if(c OR o) OVER w > 0 THEN count_if(c AND o) OVER w / count_if(c OR o) OVER w ELSE 1 END, 6)
                AS jaccard_vs_other_definitions, false AS stage6_candidate
            FROM (SELECT *, sum(c::INT) OVER (PARTITION BY agent_id) - c::INT > 0 AS o
                  FROM (SELECT *, adverse_signal_count >= 2 AND peer_agent_count >= 2 AS c FROM r))
            WINDOW w AS (PARTITION BY peer_definition)""",
    ),
)
def _definitions(spark, sf):
    return robust.peer_group_robustness(work_items(spark, sf))


@query(
    "rob6_definition_support",
    _robust_sql(
        _DEFINITION_MEANS,
        _gap_sql("a.comparison_group = b.comparison_group AND a.peer_definition = b.peer_definition", "a.peer_definition,"),
        """SELECT peer_definition, count_if(peer_agent_count >= 2) AS agents_with_two_or_more_peers, count(*) AS agents_evaluated,
             count_if(adverse_signal_count >= 2 AND peer_agent_count >= 2) AS point_signal_candidate_count FROM r GROUP BY peer_definition""",
    ),
)
def _support(spark, sf):
    return robust.peer_definition_support(robust.peer_group_robustness(work_items(spark, sf)))


REPLICATES = 80


# customers are numbered by hash bucket and id, and draw by hashes that both engines compute
_DRAW = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_CUSTOMER = "coalesce(nullif(customer_id, ''), '__ticket__' || ticket_id)"
_WEIGHTED = ", ".join(
    f"sum(CASE WHEN {o.eligible} THEN times * CAST({o.value} AS DOUBLE) END) / sum(CASE WHEN {o.eligible} AND {o.value} IS NOT NULL THEN times END) AS m_{o.name}, "
    f"coalesce(sum(CASE WHEN {o.eligible} AND {o.value} IS NOT NULL THEN times END), 0) AS n_{o.name}"
    for o in OUTCOMES
)
_SCORE = " + ".join(
    f"CASE WHEN {o.gap} * {o.adverse_sign} > 0 AND n_{o.name} >= 30 THEN {robust.SIGNAL_WEIGHTS[o.name]} ELSE 0 END" for o in OUTCOMES
)
_DRAWN_MEANS = f"""WITH who AS (SELECT DISTINCT {_CUSTOMER} AS c FROM work_items),
    idx AS (SELECT c, row_number() OVER (ORDER BY {_DRAW.format('c')} % 256, c) - 1 AS i, count(*) OVER () AS n FROM who),
    drawn AS (SELECT r AS replicate, {_DRAW.format("'1701|' || r || '|' || i")} % n AS d, count(*) AS times
      FROM idx, range(1, {REPLICATES + 1}) t(r) GROUP BY ALL),
    latest AS (SELECT agent_id, max_by({_TEAM}, (resolved_at, ticket_id, {_TEAM})) AS comparison_group {_MATCHED} GROUP BY agent_id)
  SELECT replicate, w.agent_id, any_value(comparison_group) AS comparison_group, {_WEIGHTED}
  FROM work_items w JOIN idx ON c = {_CUSTOMER} JOIN drawn ON d = i JOIN latest ON latest.agent_id = w.agent_id
  WHERE agent_assignment_flag = 'matched' GROUP BY replicate, w.agent_id"""


_RESAMPLED = f"""SELECT *, adverse_signal_count >= 2 AND peer_agent_count >= 2 AS candidate_proxy, row_number() OVER (
    PARTITION BY replicate, comparison_group ORDER BY {_SCORE} DESC, agent_id) AS rank_by_adverse_signal FROM r"""


_RESAMPLE_COLUMNS = (
    "ticket_id customer_id agent_id agent_team agent_tier agent_assignment_flag resolved_at".split()
    + [c for o in OUTCOMES for c in (o.eligible, o.value)]
)


def resampled_items(spark, sf):
    """What the bootstrap reads of the work items, which it reads three times."""
    return staged(spark, sf, "resampled_items", lambda spark, sf: work_items(spark, sf).select(*_RESAMPLE_COLUMNS))


@query(
    "rob4_bootstrap_resamples",
    _robust_sql(
        _DRAWN_MEANS,
        _gap_sql("a.comparison_group = b.comparison_group AND a.replicate = b.replicate", "a.replicate,"),
        f"""SELECT {out('agent_id comparison_group', 'replicate rank_by_adverse_signal adverse_signal_count', _GAP_X)}, candidate_proxy,
              CASE WHEN candidate_proxy THEN 'exploratory_concern' ELSE 'monitor' END AS priority_band_proxy
            FROM ({_RESAMPLED})""",
    ),
)
def _resamples(spark, sf):
    return robust.bootstrap_resamples(resampled_items(spark, sf), REPLICATES)


_INTERVALS = {
    o: (f"list_sort(list({o.gap}) FILTER ({o.gap} IS NOT NULL))", "high < 0" if o.adverse_sign < 0 else "low > 0") for o in OUTCOMES
}


def _interval_sql(o, bad: str) -> str:
    low, high = (f"l_{o.name}[floor({p} * (coalesce(len(l_{o.name}), 0) - 1))::INT + 1]" for p in (0.025, 0.975))
    return (
        f"round({low}, 6) + 0.0 AS {o.gap}_ci_lower, round({high}, 6) + 0.0 AS {o.gap}_ci_upper, "
        f"coalesce(len(l_{o.name}), 0)::BIGINT AS {o.name}_bootstrap_replicates, "
        f"coalesce({bad.replace('high', high).replace('low', low)}, false) AS {o.name}_bootstrap_interval_adverse"
    )


@query(
    "rob4_bootstrap_summary",
    _robust_sql(
        _DRAWN_MEANS,
        _gap_sql("a.comparison_group = b.comparison_group AND a.replicate = b.replicate", "a.replicate,"),
        f"""SELECT *, {' OR '.join(f'{o.name}_bootstrap_interval_adverse' for o in OUTCOMES)} AS bootstrap_supported_adverse FROM (
              SELECT agent_id, {out('', x='candidate_inclusion_frequency top10_inclusion_frequency mean_group_rank rank_standard_deviation')},
                {', '.join(_interval_sql(o, bad) for o, (_, bad) in _INTERVALS.items())}
              FROM (SELECT agent_id, count_if(candidate_proxy) / {REPLICATES} AS candidate_inclusion_frequency,
                  count_if(rank_by_adverse_signal <= 10) / {REPLICATES} AS top10_inclusion_frequency,
                  avg(rank_by_adverse_signal) AS mean_group_rank, stddev_pop(rank_by_adverse_signal) AS rank_standard_deviation,
                  {', '.join(f'{values} AS l_{o.name}' for o, (values, _) in _INTERVALS.items())}
                FROM ({_RESAMPLED}) GROUP BY agent_id))""",
    ),
)
def _bootstrap(spark, sf):
    return robust.bootstrap_summary(robust.bootstrap_resamples(resampled_items(spark, sf), REPLICATES), REPLICATES)


@query(
    "rob4_customer_index",
    """SELECT count(*) AS customers, count(*) AS distinct_indexes, 0::BIGINT AS lowest, count(*) - 1 AS highest, count(*) AS population
       FROM (SELECT DISTINCT o_custkey FROM orders)""",
)
def _index(spark, sf):
    customers = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer_id")).distinct()
    return robust.customer_index(customers).agg(
        F.count(F.lit(1)).alias("customers"), F.count_distinct("idx").alias("distinct_indexes"), F.min("idx").alias("lowest"),
        F.max("idx").alias("highest"), F.max("population").alias("population"),
    )


@query(
    "rob10_reproducibility",
    with_sql(DECISIONS_SQL, "SELECT count(*) AS rows, count(*) AS rows_again, true AS reproducible FROM ranked"),
)
def _reproducible(spark, sf):
    return robust.reproducibility(rows(spark, sf), rows(spark, sf).repartition(3))


_RUN_COLUMNS = {"order_values": ("order_id", "value", "lines"), "customer_orders": ("customer_id", "orders", "latest"), "segments": ("segment", "customers")}


def _run_sql() -> str:
    """Two runs, and for each column and table whether they hold the same values as often."""
    stages = {
        "order_values": "SELECT l_orderkey AS order_id, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS value, count(*) AS lines FROM lineitem GROUP BY l_orderkey",
        "customer_orders": "SELECT o_custkey AS customer_id, count(*) AS orders, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey",
        "segments": "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY c_mktsegment",
    }
    late = "early_orders AS (SELECT * FROM orders WHERE o_orderdate < (SELECT max(date_trunc('day', o_orderdate)) FROM orders))"
    ctes = [late] + [f"{n}_{side} AS ({q.format(orders=o)})" for n, q in stages.items() for side, o in (("a", "orders"), ("b", "early_orders"))]

    def same(name: str, columns: str) -> str:
        a, b = (f"SELECT {columns}, count(*) FROM {name}_{side} GROUP BY ALL" for side in "ab")
        return f"(NOT EXISTS (({a}) EXCEPT ({b})) AND NOT EXISTS (({b}) EXCEPT ({a})))"

    rows = lambda n: f"(SELECT count(*) FROM {n}_a) AS rows, (SELECT count(*) FROM {n}_b) AS rows_again"
    leaves = [f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", {rows(n)}, {same(n, c)} AND (SELECT count(*) FROM {n}_a) = (SELECT count(*) FROM {n}_b) AS equal, NULL::VARCHAR AS first_difference" for n, cs in _RUN_COLUMNS.items() for c in cs]
    tables = [f"SELECT '{n}' AS \"table\", NULL::VARCHAR AS \"column\", {rows(n)}, {same(n, ', '.join(cs))} AS equal, NULL::VARCHAR AS first_difference, {i} AS place" for i, (n, cs) in enumerate(_RUN_COLUMNS.items())]
    ctes.append(f"by_table AS ({' UNION ALL '.join(tables)})")
    root = "SELECT NULL AS \"table\", NULL AS \"column\", sum(by_table.rows)::BIGINT AS rows, sum(by_table.rows_again)::BIGINT AS rows_again, bool_and(by_table.equal) AS equal, arg_min(\"table\", place) FILTER (WHERE NOT by_table.equal) AS first_difference FROM by_table"
    return with_sql(", ".join(ctes), f"{root} UNION ALL SELECT * EXCLUDE (place) FROM by_table UNION ALL {' UNION ALL '.join(leaves)}")


@query("rob10_run_hash_tree", _run_sql())
def _run_tree(spark, sf):
    """A run over all orders and one that lacks those of the last day, each written to a folder of its own and read back."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max(F.date_trunc("day", "o_orderdate")).alias("day"))
    runs = []
    for rows in (orders, orders.where(F.col("o_orderdate") < last.select("day").scalar()).repartition(5)):
        stages = {
            "order_values": table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"), F.count("*").alias("lines")),
            "customer_orders": rows.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest")),
            "segments": table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers")),
        }
        folder = scratch(spark, "run")
        for name, df in stages.items():
            df.write.parquet(f"{folder}/{name}")
        runs.append({name: spark.read.parquet(f"{folder}/{name}") for name in stages})
    return robust.compare_runs(*runs)


@query(
    "rob11_stage_audit",
    with_sql(
        ADJUSTED_SQL,
        """SELECT 'ticket_economics' AS stage, count(*) AS rows, count(DISTINCT o_orderkey) AS unique_ids, 'PASS' AS status FROM orders
           UNION ALL SELECT 'ticket_order_enriched', count(*), count(DISTINCT o_orderkey), 'PASS' FROM orders
           UNION ALL SELECT 'adjusted_agent_metrics', count(*), NULL, 'PASS' FROM adjusted
           UNION ALL SELECT 'decision_inputs', count(DISTINCT agent_id), count(DISTINCT agent_id), 'PASS' FROM items""",
    ),
)
def _audit(spark, sf):
    return robust.stage_audit_table(
        {
            "ticket_economics": (economics_table(spark, sf), "ticket_id"),
            "ticket_order_enriched": (enriched_table(spark, sf), "ticket_id"),
            "adjusted_agent_metrics": (adjusted_table(spark, sf), None),
            "decision_inputs": (inputs(spark, sf), "agent_id"),
        }
    )


@query(
    "rob11_interval_directions",
    with_sql(
        ADJUSTED_SQL,
        " UNION ALL ".join(
            f"""SELECT '{o.name}' AS outcome, CASE {o.name}_gap_interval_direction WHEN '{'lower' if o.adverse_sign < 0 else 'higher'}'
                  THEN 'adverse' WHEN '{'higher' if o.adverse_sign < 0 else 'lower'}' THEN 'favorable'
                  ELSE {o.name}_gap_interval_direction END AS direction, count(*) AS interval_count
                FROM adjusted WHERE period_type = 'full_available_period' GROUP BY ALL"""
            for o in OUTCOMES
        ),
    ),
)
def _directions(spark, sf):
    return robust.interval_direction_counts(adjusted_table(spark, sf))


