"""Decision rules, review lists, goal, budget, sensitivity and prediction checks on planted rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from deskgauge.operators import decide, robust, textreview
from deskgauge.params import OUTCOMES, DecisionConfig

NEUTRAL = {"csat": (0.0, -0.2, 0.2), "handle_time": (0.0, -5.0, 5.0), "sla": (0.0, -0.02, 0.02)}
ADVERSE = {"csat": (-0.6, -0.9, -0.3), "handle_time": (30.0, 10.0, 50.0), "sla": (0.06, 0.01, 0.11)}
BETTER = {"csat": (0.6, 0.3, 0.9), "handle_time": (-30.0, -50.0, -10.0), "sla": (-0.06, -0.11, -0.01)}


def agent(name, shape=None, quarters=2, group="tier=T1|team=x", n=80, peers=6, **changes):
    shape = {**NEUTRAL, **(shape or {})}
    row = {
        "agent_id": name, "total_tickets": 100, "ticket_count": 100, "agent_team": "x", "agent_tier": "T1", "agent_site": "s",
        "agent_shift": "day", "comparison_group": group, "peer_supported": group is not None, "peer_agent_count": peers,
        "comparison_status": "comparable" if group else "insufficient_peer_support",
        "stability_flag": "no_clear_shift_detected", "peer_handle_time_mean": 100.0, "peer_mean_csat": 4.0,
        "peer_sla_breach_rate": 0.1, "agent_mean_csat": 4.0, "agent_handle_time_mean": 100.0, "agent_sla_breach_rate": 0.1,
    }
    for o in OUTCOMES:
        gap, low, high = shape[o.name]
        bad = (high < 0) if o.adverse_sign < 0 else (low > 0)
        row |= {
            o.gap: gap, f"{o.name}_gap_ci_lower": low, f"{o.name}_gap_ci_upper": high, f"{o.name}_eligible_count": n,
            f"{o.name}_adjustment_coverage_rate": 0.9, f"{o.name}_gap_interval_direction": "overlaps_zero",
            f"{o.name}_adverse_quarters": quarters if bad else 0, f"{o.name}_favorable_quarters": 0,
            f"{o.name}_observed_quarters": 4,
        }
    return row | changes


def inputs(spark, *rows):
    df = spark.createDataFrame([{k: v for k, v in r.items()} for r in rows])
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "diag_topics": none, "diag_ids": none, "has_diagnostics": F.lit(False),
            "exposures": F.struct(F.lit(10.0).alias("total_relevant_exposure")),
        }
    )


def decided(spark, *rows, config=DecisionConfig()):
    return {r["agent_id"]: r for r in decide.priority_rows(inputs(spark, *rows), config).collect()}


@pytest.fixture(scope="module")
def planted(spark):
    return decided(
        spark,
        agent("worst", ADVERSE),
        agent("one", {"csat": ADVERSE["csat"]}, quarters=1),
        agent("fine"),
        agent("good", BETTER),
        agent("clash", {"csat": ADVERSE["csat"], "sla": BETTER["sla"]}),
        agent("thin", ADVERSE, n=10),
        agent("alone", ADVERSE, group=None),
        agent("cross", ADVERSE, group="tier=T2|team=x"),
        agent("moving", ADVERSE, stability_flag="variable_across_quarters"),
        agent("partial", ADVERSE, ticket_count=60),
    )


def test_planted_decisions(planted):
    status = {k: (r["priority_status"], r["priority_band"]) for k, r in planted.items()}
    assert status["worst"] == ("training_candidate", "high")
    assert status["one"][0] in ("monitor", "training_candidate") and planted["one"]["priority_band"] != "high"
    assert status["fine"] == status["good"] == ("monitor", "monitor")
    assert {k for k, s in status.items() if s[0] == "not_rankable"} == {"thin", "alone", "cross", "moving", "partial"}


def test_gates(planted):
    gates = {k: r["eligibility_gates"] for k, r in planted.items()}
    assert gates["thin"] == ["insufficient_evidence"] and gates["alone"] == ["no_comparable_peer"]
    assert gates["cross"] == ["invalid_tier_peer"] and gates["moving"] == ["unstable"] and gates["partial"] == ["data_quality_restricted"]


def test_signals_and_text(planted):
    assert planted["worst"]["primary_signal"] == "csat" and planted["worst"]["secondary_signal"] == "handle_time"
    assert planted["clash"]["diagnostic_state"] == "mixed_performance"
    assert "; for=sla;" in planted["clash"]["priority_reason"]
    assert planted["fine"]["priority_reason"].startswith("against=none; ")
    assert planted["worst"]["priority_rank"] == 1 and planted["fine"]["priority_rank"] is None


def test_score_falls_with_evidence_and_history(spark):
    rows = decided(spark, agent("a", ADVERSE), agent("b", ADVERSE, n=40), agent("c", ADVERSE, quarters=1), agent("d", {"csat": (-0.3, -0.5, -0.1)}))
    assert rows["a"]["priority_score"] > rows["b"]["priority_score"] > 0
    assert rows["a"]["priority_score"] > rows["c"]["priority_score"] > rows["d"]["priority_score"]
    assert rows["a"]["priority_score"] == 100.0


def test_money_and_point_estimates_do_not_decide(spark):
    wide = {"csat": (-0.6, -1.2, 0.1)}
    assert decided(spark, agent("a", wide))["a"]["priority_score"] == 0
    loose = decided(spark, agent("a", wide), config=DecisionConfig(require_interval_excludes_zero=False))
    assert loose["a"]["priority_score"] > 0


def test_review_lists(spark):
    rows = decide.priority_rows(inputs(spark, *[agent(f"a{i:02d}", {"csat": (i / 20 - 0.3, -1.0, 1.0)}) for i in range(12)], agent("none", group=None)), DecisionConfig())
    got = decide.review_lists(rows, bottom=3, top=2).orderBy("list_name", "review_list_rank").collect()
    assert [(r["list_name"], r["agent_id"]) for r in got] == [("bottom_review", "a00"), ("bottom_review", "a01"), ("bottom_review", "a02"), ("top_review", "a11"), ("top_review", "a10")]
    none = rows.filter("agent_id = 'none'").first()
    assert none["review_score"] is None and none["review_score_status"] == "no_supported_peer_comparison"
    assert all(-100 <= r["review_score"] <= 100 for r in got)


@pytest.mark.parametrize(("eligible", "breaches", "target"), [(1000, 90, 0.08), (1000, 5, 0.0), (0, 0, None), (10, 20, None)])
def test_goal(spark, eligible, breaches, target):
    row = decide.sla_business_goal(spark.createDataFrame([(eligible, breaches)], "sla_eligible_count long, sla_breach_count long")).first()
    assert row["target_rate"] == (None if target is None else pytest.approx(target))
    assert row["status"] == ("unavailable" if target is None else "proposed_operational_target")


def test_budget(spark):
    rows = spark.createDataFrame([("training_candidate",), ("monitor",)], "priority_status string")
    held = decide.training_budget_decision(rows, 1000.0).first()
    assert held["reserved_pending_evidence_or_costing"] == 1000 and held["rationale"] == "reserve_costs_unknown"
    free = decide.training_budget_decision(rows, 1000.0, True).first()
    assert free["recommended_agent_specific_allocation"] is None
    assert decide.training_budget_decision(rows.limit(0), 1000.0).first()["rationale"] == "reserve_no_candidate"


def test_scenarios_equal_single_decisions(spark):
    frame = inputs(spark, agent("worst", ADVERSE), agent("one", {"csat": ADVERSE["csat"]}), agent("fine"), agent("thin", ADVERSE, n=25))
    together = robust.decide_scenarios(frame)
    for name, overrides in robust.SENSITIVITY_SCENARIOS.items():
        from dataclasses import replace

        single = decide.priority_rows(frame, replace(DecisionConfig(), **overrides))
        cols = ["agent_id", "priority_status", "priority_band", "priority_score", "priority_rank"]
        got = sorted(map(tuple, together.filter(F.col("scenario") == name).select(*cols).collect()))
        assert got == sorted(map(tuple, single.select(*cols).collect()))
    summary = {r["scenario"]: r for r in robust.sensitivity(together).collect()}
    assert summary["default"]["candidate_set_jaccard_vs_default"] == 1.0
    assert summary["minimum_evidence_20"]["candidate_count"] == summary["default"]["candidate_count"] + 1


def test_explanations_are_consistent(spark):
    rows = decide.priority_rows(inputs(spark, agent("worst", ADVERSE), agent("fine"), agent("good", BETTER)), DecisionConfig())
    assert robust.explanation_consistency(rows).filter("status = 'FAIL'").count() == 0
    broken = rows.withColumn("priority_reason", F.lit("all is well"))
    assert robust.explanation_consistency(broken).filter("status = 'FAIL' and agent_id = 'worst'").count() == 3


def test_draws_are_packed_and_unpacked():
    """Also where a row was never drawn or very often, and out of the middle of a longer array."""
    import numpy as np

    from deskgauge.operators import draws

    counts = np.random.default_rng(1).poisson(1, (300, 80))
    counts[7], counts[8], counts[9, 3] = 0, 1, 70_000
    packed = draws.pack(counts)
    assert (draws.unpack(packed, 80) == counts).all() and (draws.unpack(packed.slice(5, 20), 80) == counts[5:25]).all()
    assert packed.slice(100).nbytes < 24 * 1.3 * 200


def test_weighted_sums_equal_a_plain_loop(spark):
    """Rows travel with all their draws at once: sums by key and replicate, with keys of many rows and of few, over several batches, and
    with null, NaN and infinite values."""
    import collections
    import math

    from deskgauge.operators import draws

    rng = random.Random(5)
    odd = {3: float("nan"), 5: float("inf"), 9: None, 10: None}
    rows = [(i % 40, "hot" if i % 3 else f"K{i % 200}", odd.get(i % 500, float(i % 7)), None if i % 11 else 2.0) for i in range(3000)]
    drawn = [(rng.randrange(40), r) for r in range(1, 7) for _ in range(25)]
    times = collections.Counter(drawn)
    want = {}
    for idx, key, *values in rows:
        for r in range(1, 7):
            if w := times[idx, r]:
                sums = want.setdefault((key, r), [None, 0, None, 0])
                for j, v in enumerate(values):
                    if v is not None:
                        sums[2 * j], sums[2 * j + 1] = (sums[2 * j] or 0.0) + w * v, sums[2 * j + 1] + w
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        times_of = draws.times_drawn(spark.createDataFrame(drawn, "idx long, replicate int"), 6)
        located = spark.createDataFrame(rows, "idx long, agent_id string, v_a double, v_b double").join(times_of, "idx")
        got = draws.weighted_sums(located, "agent_id", ["a", "b"], 6).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(want)
    for r in got:
        for a, b in zip((r.s_a, r.n_a, r.s_b, r.n_b), want[r.agent_id, r.replicate], strict=True):
            assert a == b or (math.isnan(a) and math.isnan(b))


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rows = spark.range(600).select(
        F.concat(F.lit("T"), "id").alias("ticket_id"), F.concat(F.lit("C"), F.col("id") % 50).alias("customer_id"),
        F.concat(F.lit("A"), F.col("id") % 4).alias("agent_id"), F.lit("T1").alias("agent_tier"), F.lit("x").alias("agent_team"),
        F.lit("matched").alias("agent_assignment_flag"), F.timestamp_seconds("id").alias("resolved_at"), F.lit(True).alias("valid_for_csat"),
        (F.col("id") % 5 + 1).alias("csat_score_numeric"), F.lit(True).alias("valid_for_handle_time"),
        (F.col("id") % 90).cast("double").alias("handle_time_minutes"), F.lit(True).alias("valid_for_sla"),
        (F.col("id") % 3 == 0).alias("sla_breach_flag"),
    )
    one = sorted(map(str, robust.bootstrap_summary(robust.bootstrap_resamples(rows, 10), 10).collect()))
    two = sorted(map(str, robust.bootstrap_summary(robust.bootstrap_resamples(rows.repartition(7), 10), 10).collect()))
    assert one == two and len(one) == 4


GOOD = {
    "ticket_id": "T1", "issue_category": "Connectivity", "secondary_category": "other", "customer_intent": "troubleshooting",
    "diagnostic_theme": "troubleshooting", "customer_problem": "p", "resolution_pattern": "r", "communication_issue": "c",
    "policy_process_issue": "unclear", "possible_failure_theme": "f", "evidence": "it stopped", "evidence_strength": "high",
    "confidence": 0.5,
}


@pytest.mark.parametrize(
    ("changes", "rule"),
    [({}, None), ({"confidence": 1}, None), ({"confidence": True}, "invalid_confidence"), ({"confidence": "0.5"}, "invalid_confidence"),
     ({"confidence": -0.1}, "invalid_confidence"), ({"issue_category": "Nope"}, "invalid_issue_category"),
     ({"issue_category": ["Connectivity"]}, "invalid_issue_category"), ({"evidence_strength": "High"}, "invalid_evidence_strength"),
     ({"ticket_id": "T2"}, "ticket_id_mismatch"), ({"ticket_id": 1}, "ticket_id_mismatch"), ({"extra": 1}, "fields_mismatch"),
     ({"evidence": "invented"}, "evidence_not_quoted"), ({"evidence": ""}, None), ({"customer_problem": None}, "customer_problem_not_string"),
     ({"customer_problem": "x" * 501}, "customer_problem_too_long"), ({"customer_problem": "x" * 500}, None),
     ({"issue_category": "insufficient_evidence"}, "evidence_without_issue"),
     ({"resolution_pattern": "caused by AGENT"}, "causal_claim")],
)
def test_prediction_rules(spark, changes, rule):
    row = (("T1", json.dumps(GOOD | changes), ["well, it stopped working"]),)
    df = spark.createDataFrame(row, "ticket_id string, payload string, sources array<string>")
    got = textreview.validate_predictions(df).first()
    assert got["rule"] == rule and got["is_valid"] == (rule is None)
    assert (got["result_issue_category"] is None) == (rule is not None)


@pytest.mark.parametrize("payload", ["{broken", "[1]", "null", None, '"text"'])
def test_payload_must_be_an_object(spark, payload):
    df = spark.createDataFrame([("T1", payload, ["x"])], "ticket_id string, payload string, sources array<string>")
    assert textreview.validate_predictions(df).first()["rule"] == "not_an_object"


def test_missing_price_means_unknown_cost(spark):
    requests = spark.createDataFrame([("1", 100)], "ticket_id string, request_tokens long")
    assert textreview.cost_estimate(requests, {"input_per_million": 1.0}).first()["estimated_cost"] is None
    priced = textreview.cost_estimate(requests, {"input_per_million": 1.0, "output_per_million": 2.0}).first()
    assert priced["estimated_cost"] == pytest.approx((100 + 360) / 1e6)


def test_sampling_is_deterministic(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("ticket_id"), F.lit(1).alias("candidate_score"))
    pick = lambda df, seed: {r[0] for r in textreview.select_candidates(df, "sampled", 50, seed=seed).select("ticket_id").collect()}
    assert pick(rows, 1) == pick(rows.repartition(5), 1) != pick(rows, 2)
    with pytest.raises(ValueError, match="none of"):
        textreview.select_candidates(rows, "other")


def test_hash_tree_finds_the_first_table_that_differs(spark):
    a = spark.createDataFrame([(i, f"v{i % 3}", [i]) for i in range(50)], "k int, v string, list array<int>")
    b = spark.createDataFrame([(i, i * 0.5) for i in range(20)], "k int, x double")
    tree = lambda first, second: {(r["table"], r["column"]): r for r in robust.compare_runs(first, second).collect()}
    same = tree({"a": a, "b": b}, {"a": a.repartition(7), "b": b.orderBy(F.desc("k"))})
    assert all(r["equal"] for r in same.values()) and same[None, None]["first_difference"] is None and len(same) == 8
    changed = b.withColumn("x", F.when(F.col("k") == 7, -1.0).otherwise(F.col("x")))
    one = tree({"a": a, "b": b}, {"a": a, "b": changed})
    assert [k for k, r in one.items() if not r["equal"]] == [(None, None), ("b", None), ("b", "x")] and one[None, None]["first_difference"] == "b"
    swapped = tree({"b": b}, {"b": b.withColumn("x", F.lit(9.5) - F.col("x"))})  # the same values in other rows
    assert swapped["b", "x"]["equal"] and not swapped["b", None]["equal"]
    lacks = tree({"a": a, "b": b}, {"b": b.limit(3), "c": a.limit(0)})
    assert lacks[None, None]["first_difference"] == "a" and not lacks["c", None]["equal"] and lacks["c", None]["rows_again"] == 0
