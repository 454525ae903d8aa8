"""Cleaning, profiling, validation, sources and sinks."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from deskgauge.functions.text import message_quality
from deskgauge.operators import clean, link, profile, validate
from deskgauge.sources import readers, sinks


def test_normalize_and_log(spark):
    df = spark.createDataFrame([("k1", "  a \t b ", "N/A"), ("k2", "c", "None of it")], "id string, x string, y string")
    rows = {r["id"]: r for r in clean.normalize_table(df).collect()}
    assert rows["k1"]["x"] == "a b" and rows["k1"]["y"] is None and rows["k2"]["y"] == "None of it"
    log = {(r["row_key"], r["column"]): (r["before"], r["after"]) for r in clean.normalization_changes(df, "id").collect()}
    assert log == {("k1", "x"): ("  a \t b ", "a b"), ("k1", "y"): ("N/A", "")}


def test_ticket_time_zones(spark):
    rows = [
        ("helpdesk", "2025-01-01 00:00:00"),
        ("legacy_fd", "2025-01-01 00:00:00"),
        ("helpdesk", "2025-01-01T00:00:00Z"),
        ("helpdesk", None),
    ]
    df = spark.createDataFrame([(s, v, v, v) for s, v in rows], "source_system string, created_at string, first_response_at string, resolved_at string")
    got = clean.repair_ticket_times(df).collect()
    assert str(got[0]["resolved_at"]) == "2024-12-31 18:30:00" and got[0]["timestamp_normalization_applied"]
    assert str(got[1]["resolved_at"]) == "2025-01-01 00:00:00" and str(got[1]["created_at"]) == "2024-12-31 18:30:00"
    assert str(got[2]["created_at"]) == "2025-01-01 00:00:00" and not got[2]["timestamp_normalization_applied"]
    assert got[3]["created_at"] is None and not got[3]["timestamp_normalization_applied"]


@pytest.mark.parametrize(
    ("text", "reason"),
    [(None, "empty_message"), ("  ", "empty_message"), ("IVR session failed", "known_ivr_or_transcript_marker"),
     ("[no input]", "known_ivr_or_transcript_marker"), ("ok", "insufficient_text"), ("!!! ???", "insufficient_text"),
     ("aaaa aaaa aaaa", "repetitive_text"), ("abababababab", "repetitive_text"), ("abcabcabcabc", ""), ("My case is broken", "")],
)
def test_message_quality(spark, text, reason):
    row = spark.createDataFrame([(text,)], "m string").select(message_quality(F.col("m")).alias("q")).select("q.*").first()
    assert row["reason"] == reason and row["flag"] == ("usable" if reason == "" else "degraded")


def test_duplicates_need_two_sources(spark):
    rows = [("1", "c", "s", "t", "a"), ("2", "C ", "S", "t", "b"), ("3", "c", "s", "t2", "a"), ("4", "", "s", "t", "b"), ("5", "d", "s", "t", "a"), ("6", "d", "s", "t", "a")]
    df = spark.createDataFrame(rows, "id string, customer_id string, product_sku string, created_at string, source_system string")
    got = {r["id"]: r["reconciliation_flag"] for r in clean.flag_duplicate_candidates(df).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False, "6": False}


def test_profile(spark):
    df = spark.createDataFrame([("1", "2025-01-01", "5", "a"), ("2", "bad", "", "a")], "row_id string, event_date string, score string, note string")
    got = {r["name"]: r for r in profile.inspect_table(df).collect()}
    assert got["row_id"]["dtype"] == "integer" and got["row_id"]["likely_key"]
    assert got["event_date"]["parsing_issue"].startswith("1 filled") and got["event_date"]["dtype"] == "string"
    assert got["score"]["null_count"] == 1 and got["score"]["dtype"] == "integer" and got["note"]["examples"] == ["a"]
    approx = {r["name"]: r for r in profile.inspect_table(df, approximate=True).collect()}
    assert approx["note"]["unique_count"] == 1 and "examples" not in approx["note"].asDict()


def test_validation_counts(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "nan", "y"), (None, "99", "")], "k string, n string, c string")
    got = {(r["name"], r["field"]): r["count"] for r in validate.validate_table("t", df, ["k", "z"], "k", [], {"n": (0, 10)}, {"c": ["x"]}).collect()}
    assert got[("required_columns", "z")] == 1 and got[("critical_identifier_nulls", "k")] == 1 and got[("duplicate_key", "k")] == 1
    assert got[("numeric_range", "n")] == 2 and got[("categorical_values", "c")] == 1 and got[("row_count", None)] == 3
    with pytest.raises(ValueError, match="duplicate_key"):
        validate.assert_checks(validate.validate_key("t", df, "k"))


def test_guarded_join_keeps_grain_and_reports(spark):
    fact = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "zz")], "id string, k string")
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    joined, checks = link.guarded_left_join(fact, dim, "k", "k", "d_")
    assert joined.count() == 3 and "d_v" in joined.columns
    row = checks.first()
    assert (row["duplicate_dimension_keys"], row["orphan_rows"], row["status"]) == (1, 1, "FAIL")


@pytest.mark.parametrize(("header", "message"), [("a,a", "twice"), ("a, ", "no name")])
def test_csv_header_rules(spark, tmp_path, header, message):
    (tmp_path / "x.csv").write_text(header + "\n1,2\n")
    with pytest.raises(readers.SourceError, match=message):
        readers.load_csv(spark, str(tmp_path / "x.csv"))


def test_csv_rows_of_wrong_width_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.load_csv(spark, str(tmp_path / "x.csv")).collect()


def test_csv_bom_and_quoted_newline(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿a,b\n1,"two\nlines, ""quoted"""\n', encoding="utf-8")
    row = readers.load_csv(spark, str(tmp_path / "x.csv"), multiline=True).first()
    assert row["a"] == "1" and row["b"] == 'two\nlines, "quoted"'


def test_required_parquet_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(readers.SourceError, match="ticket_id"):
        readers.scan_parquet(spark, str(tmp_path / "t"), ["ticket_id"])


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "c": "x"}\n{"id": 1, "c": "y"}\n')
    with pytest.raises(readers.SourceError, match="repeated"):
        readers.load_json_lines_strict(spark, str(tmp_path / "l.jsonl"), "id int, c string", "id", ["c"])


def test_load_sources_skips_missing_files(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("a,b\n1,2\n")
    (tmp_path / "note.txt").write_text("hello\nworld")
    (tmp_path / "policy.pdf").write_bytes(b"%PDF")
    got = readers.load_sources(spark, str(tmp_path), {"orders": "orders.csv", "note": "note.txt", "policy": "policy.pdf", "gone": "gone.csv"})
    assert set(got) == {"orders", "note", "policy"} and got["note"].first()[0] == "hello\nworld"
    assert not got["policy"].first()["content_extracted"]


def test_bundle_detects_tampering(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    table = spark.range(5).withColumn("secret", F.lit("raw text"))
    sinks.publish_bundle({"t": (table, ["id"])}, folder)
    assert spark.read.parquet(f"{folder}/t").columns == ["id"]
    assert [r["status"] for r in sinks.validate_bundle(spark, folder).collect()] == ["valid"]
    spark.range(6, 11).write.mode("overwrite").parquet(f"{folder}/t")
    assert [r["status"] for r in sinks.validate_bundle(spark, folder).collect()] == ["content_differs"]
    with pytest.raises(ValueError, match="lacks"):
        sinks.publish_bundle({"t": (table, ["nope"])}, str(tmp_path / "other"))


def test_cache_returns_newest(spark, tmp_path):
    path = str(tmp_path / "cache")
    for value in ("old", "new"):
        sinks.cache_append(spark.createDataFrame([("k", value)], "request_key string, value string"), path)
    requests = spark.createDataFrame([("1", "k"), ("2", "other")], "ticket_id string, request_key string")
    got = {r["ticket_id"]: (r["cached_value"], r["cache_hit"]) for r in sinks.cache_lookup(requests, spark.read.parquet(path)).collect()}
    assert got == {"1": ("new", True), "2": (None, False)}
    assert [r["ticket_id"] for r in sinks.cache_misses(requests, spark.read.parquet(path)).collect()] == ["2"]


def test_relationships_read_the_child_once(spark, tmp_path):
    rng = random.Random(3)
    child = [(rng.choice([None, "", "hot", "hot", str(rng.randint(0, 30))]), rng.choice([None, rng.randint(0, 12)])) for _ in range(500)]
    left = [(rng.choice([None, "", "hot", str(rng.randint(0, 25))]),) for _ in range(40)]
    right = [(rng.randint(0, 9),) for _ in range(30)]
    for name, rows, schema in (("child", child, "a string, b int"), ("left", left, "pk string"), ("right", right, "pk int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    found = validate.relationship_findings({"left": (read("left"), "pk", "a"), "right": (read("right"), "pk", "b"), "none": (read("left").limit(0), "pk", "a")}, "child", read("child"))
    got = [(r["name"], r["dataset"], r["count"]) for r in found.collect()]
    want = []
    for name, parent, at in (("left", left, 0), ("right", right, 1), ("none", [], 0)):
        keys = [k for (k,) in parent if k not in (None, "")]
        orphans = sum(row[at] not in (None, "") and row[at] not in keys for row in child)
        want += [("parent_key_uniqueness", name, len(keys) - len(set(keys))), ("referential_integrity", "child", orphans)]
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("/child]") + plan.count("/child,") == 1 and "Join" not in plan


def test_keyed_cache(spark):
    name = f"cache_{uuid.uuid4().hex}"
    cache = sinks.KeyedCache(spark, name, 16)
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "request_key string, n int")
    assert cache.lookup(requests).filter("cache_hit").count() == 0 and cache.misses(requests).count() == 4
    results = lambda *rows: spark.createDataFrame(rows, "request_key string, value string")
    cache.merge(results(("a", "x"), ("b", "y"), ("b", "z"), (None, "w")))
    first = {r["request_key"]: r["cached_at"] for r in cache.read().collect()}
    cache.merge(results(("a", "x2"), ("d", "v")))
    rows = {r["request_key"]: r for r in cache.read().collect()}
    assert cache.read().count() == 3 and {k: r["value"] for k, r in rows.items()} == {"a": "x2", "b": "z", "d": "v"}
    assert rows["b"]["cached_at"] == first["b"] and rows["a"]["cached_at"] > first["a"]
    assert {r["n"]: r["cached_value"] for r in cache.lookup(requests).collect()} == {1: "x2", 2: "z", 3: None, 4: None}
    assert sorted(r["n"] for r in cache.misses(requests).collect()) == [3, 4]
    # a merge that broke off after the old table went is finished by the next use
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}_next")
    assert sinks.KeyedCache(spark, name, 16).read().count() == 3
    spark.sql(f"DROP TABLE {name}")


def test_keyed_cache_is_not_shuffled(spark):
    name = f"cache_{uuid.uuid4().hex}"
    cache = sinks.KeyedCache(spark, name, 16)
    cache.merge(spark.range(1000).select(F.col("id").cast("string").alias("request_key"), F.lit("v").alias("value")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (cache.lookup, cache.misses):
            plan = found(spark.range(500).select(F.col("id").cast("string").alias("request_key")))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
