"""Plan helpers for null-safe keys, period slices and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = ("period_type", "period")
FULL_PERIOD = "full_available_period"
_SLICES = {
    "all": lambda: F.struct(F.lit(FULL_PERIOD).alias("period_type"), F.lit("all").alias("period")),
    "month": lambda: F.when(
        F.col("reporting_month").isNotNull(),
        F.struct(F.lit("month").alias("period_type"), F.col("reporting_month").alias("period")),
    ),
    "quarter": lambda: F.when(
        F.col("reporting_quarter").isNotNull(),
        F.struct(F.lit("quarter").alias("period_type"), F.col("reporting_quarter").alias("period")),
    ),
}


def explode_periods(df: DataFrame, slices: Sequence[str]) -> DataFrame:
    """Repeat each row once per period slice it belongs to. Meant for partial aggregates, not for raw facts."""
    options = F.filter(F.array(*[_SLICES[s]() for s in slices]), lambda s: s.isNotNull())
    exploded = df.withColumn("__slice", F.explode(options))
    return exploded.select("*", "__slice.period_type", "__slice.period").drop("__slice")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right copies of the keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def pool_label(tier: Column, team: Column | None = None, site: Column | None = None, shift: Column | None = None):
    """``tier=..|team=..|site=..|shift=..`` with absent parts left out; the tier always appears."""
    parts = [F.concat(F.lit("tier="), F.coalesce(tier, F.lit("None")))]
    for name, part in (("team", team), ("site", site), ("shift", shift)):
        if part is not None:
            parts.append(F.concat(F.lit(f"{name}="), part))
    return F.concat_ws("|", *parts)


def compact(*options: Column) -> Column:
    """Sorted distinct array of the options that are not NULL."""
    # built without lambdas: options may hold scalar subqueries, which lambdas cannot
    return F.sort_array(F.array_except(F.array(*options), F.array(F.lit(None).cast("string"))))


def content_hash(df: DataFrame) -> Column:
    """Order-insensitive aggregate hash of all rows; nested columns go through JSON."""
    columns = [
        F.to_json(F.col(f.name)) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name)
        for f in df.schema.fields
    ]
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def hashed_draw(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by ``|``: a draw that other engines reproduce."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")
