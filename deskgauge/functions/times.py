"""Time expressions: tolerant parsing, zone handling, durations and reporting periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgauge.params import LEGACY_SOURCE, REPORTING_ZONE

# --- fixed values: accepted shapes of timestamps ------------------------------------------------------------------
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
OFFSET_SHAPE = r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"
US_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{1,2}:\d{1,2})?$"


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL when the text is not one; naive text is read in the session zone."""
    text = F.trim(c)
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def is_date_text(c: Column) -> Column:
    """Does the text parse under any accepted date or timestamp format?"""
    text = F.trim(c)
    us = F.when(
        text.rlike(US_SHAPE),
        F.coalesce(
            F.try_to_timestamp(text, F.lit("M/d/yyyy")),
            F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")),
        ),
    )
    return F.coalesce(parse_iso(c), us).isNotNull()


def ticket_time_utc(value: Column, source: Column, field: str, zone: str = REPORTING_ZONE) -> Column:
    """``struct(ts, assumed_zone)``: explicit offsets win, naive legacy resolutions are UTC, other naive text is local."""
    parsed = parse_iso(value)
    explicit = F.trim(value).rlike(OFFSET_SHAPE)
    local = F.to_utc_timestamp(parsed, zone)
    naive = F.when(source == LEGACY_SOURCE, parsed).otherwise(local) if field == "resolved_at" else local
    return F.struct(
        F.when(explicit, parsed).otherwise(naive).alias("ts"),
        F.coalesce((F.trim(value) != "") & ~explicit, F.lit(False)).alias("assumed_zone"),
    )


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def elapsed(df: DataFrame, start: str, end: str) -> Column:
    """``struct(minutes, reason)`` between two columns of ``df`` that hold timestamps or ISO text."""
    kinds = dict(df.dtypes)

    def read(name: str) -> tuple[Column, Column]:
        if kinds[name] == "string":
            return F.nullif(F.col(name), F.lit("")).isNull(), parse_iso(F.col(name))
        return F.col(name).isNull(), F.col(name).cast("timestamp")

    (no_start, a), (no_end, b) = read(start), read(end)
    minutes = minutes_between(a, b)
    reason = (
        F.when(no_start | no_end, "missing_timestamp")
        .when(a.isNull() | b.isNull(), "invalid_timestamp")
        .when(minutes < 0, "negative_duration")
        .otherwise("")
    )
    return F.struct(F.when(minutes >= 0, minutes).alias("minutes"), reason.alias("reason"))


def month_label(ts: Column, zone: str = REPORTING_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def quarter_label(ts: Column, zone: str = REPORTING_ZONE) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.concat(F.year(local).cast("string"), F.lit("-Q"), F.quarter(local).cast("string"))


def with_periods(df: DataFrame, created: str = "created_at", zone: str = REPORTING_ZONE) -> DataFrame:
    ts = F.col(created).cast("timestamp")
    return df.withColumns({"reporting_month": month_label(ts, zone), "reporting_quarter": quarter_label(ts, zone)})
