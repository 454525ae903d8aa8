"""Hand-computed metric cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deskgauge.operators import metrics
from deskgauge.operators.order_stats import average_ranks, exact_percentiles

DAY = dt.datetime(2025, 1, 1, 10, 0)


def ticket(i, **changes):
    row = {
        "ticket_id": f"T{i}", "status": "resolved", "channel": "chat", "csat_score": "5", "transfers": "0", "agent_id": "A",
        "created_at": DAY, "first_response_at": DAY + dt.timedelta(minutes=10), "resolved_at": DAY + dt.timedelta(minutes=40),
    }
    return row | changes


SCHEMA = (
    "ticket_id string, status string, channel string, csat_score string, transfers string, agent_id string, "
    "created_at timestamp, first_response_at timestamp, resolved_at timestamp"
)


def derived(spark, *rows):
    df = metrics.derive_ticket_metrics(spark.createDataFrame(list(rows), SCHEMA))
    return {r["ticket_id"]: r for r in df.collect()}


@pytest.mark.parametrize(
    ("raw", "reason", "score"),
    [("", "no_response", None), (None, "no_response", None), ("3.0", "invalid_score", None), ("six", "invalid_score", None),
     ("0", "score_out_of_range", None), ("6", "score_out_of_range", None), (" 4 ", "", 4)],
)
def test_score_reasons(spark, raw, reason, score):
    row = derived(spark, ticket(1, csat_score=raw))["T1"]
    assert (row["csat_eligibility_reason"], row["csat_score_numeric"]) == (reason, score)


def test_open_ticket_keeps_score_but_is_not_eligible(spark):
    row = derived(spark, ticket(1, status="Open"))["T1"]
    assert row["csat_response_flag"] and row["csat_unexpected_status_flag"] and not row["valid_for_csat"]
    assert row["handle_time_eligibility_reason"] == "not_completed" and row["handle_time_minutes"] is None


def test_durations_and_sla_boundary(spark):
    rows = derived(
        spark,
        ticket(1, first_response_at=DAY + dt.timedelta(minutes=15)),
        ticket(2, first_response_at=DAY + dt.timedelta(minutes=15, seconds=1)),
        ticket(3, channel="fax"),
        ticket(4, resolved_at=DAY),
        ticket(5, first_response_at=None),
        ticket(6, first_response_at=DAY, resolved_at=DAY),
    )
    assert rows["T1"]["sla_status"] == "met" and rows["T2"]["sla_status"] == "breached"
    assert rows["T3"]["sla_eligibility_reason"] == "unknown_channel" and rows["T3"]["first_response_minutes"] == 10
    assert rows["T4"]["handle_time_eligibility_reason"] == "negative_duration"
    assert rows["T5"]["sla_status"] == "not_evaluable" and rows["T5"]["sla_eligibility_reason"] == "missing_timestamp"
    assert rows["T6"]["handle_time_minutes"] == 0 and rows["T6"]["valid_for_handle_time"]


def test_text_timestamps_name_their_defect(spark):
    df = spark.createDataFrame([("2025-01-01T10:00:00Z", "nonsense"), ("2025-01-01 10:00", "2025-01-01T11:30:00+00:00"), ("", "x")],
                               "a string, b string")
    from deskgauge.functions.times import elapsed

    rows = df.select(elapsed(df, "a", "b").alias("e")).select("e.*").collect()
    assert [r["reason"] for r in rows] == ["invalid_timestamp", "", "missing_timestamp"]
    assert rows[1]["minutes"] == 90


@pytest.mark.parametrize(("raw", "reason", "value"), [("2", "", 2), ("-1", "negative", None), ("two", "invalid", None), ("", "missing", None)])
def test_transfers(spark, raw, reason, value):
    row = derived(spark, ticket(1, transfers=raw))["T1"]
    assert (row["transfer_eligibility_reason"], row["transfers_numeric"]) == (reason, value)
    assert row["transfer_flag"] == (None if value is None else value > 0)


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    got = exact_percentiles(df, [], {"v": ("v", {"p50": 0.5, "p75": 0.75})}).first()
    assert (got["p50"], got["p75"]) == (5.0, 7.5)


def test_percentiles_are_exact_whatever_the_buckets(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(900)) / 7).alias("v"),
    )
    want = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    for buckets in (2, 16, 64):
        for r in exact_percentiles(df, ["k"], {"v": ("v", {"a": 0.5, "b": 0.9})}, buckets).collect():
            assert r["a"] == pytest.approx(want[r["k"]]["a"]) and r["b"] == pytest.approx(want[r["k"]]["b"])


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in exact_percentiles(df, ["k"], {"v": ("v", {"m": 0.5})}).collect()}
    assert got == {None: 2.0, "x": 5.0}


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "v double")
    got = {r["v"]: r["r"] for r in average_ranks(df, "v", "r").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_empty_input_has_typed_columns(spark):
    df = metrics.ticket_metrics(spark.createDataFrame([], SCHEMA))
    assert metrics.period_metrics(df).count() == 0 and "mean_csat" in metrics.period_metrics(df).columns
