"""Case-mix distributions by assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.functions.keys import FULL_PERIOD, PERIOD, explode_periods
from deskgauge.params import ASSIGNMENT

# --- fixed values: described dimensions ---------------------------------------------------------------------------
DIMENSIONS = (
    "channel",
    "priority",
    "category",
    "product_family",
    "agent_team",
    "agent_tier",
    "agent_site",
    "agent_shift",
    "reporting_month",
    "reporting_quarter",
)
RANGE_DIMENSIONS = ("channel", "priority", "category", "product_family")
MISSING_LEVEL = "(missing)"


def case_mix_metrics(rows: DataFrame) -> DataFrame:
    """Count and share of every level of ten dimensions, per assignment, over the full period and each quarter.

    Tickets collapse to their distinct combination of levels before dimensions and periods multiply them.
    """
    combos = rows.groupBy(*dict.fromkeys([*ASSIGNMENT, *DIMENSIONS])).agg(F.count(F.lit(1)).alias("cnt"))
    levels = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit(MISSING_LEVEL)).alias("level"),
            )
            for d in DIMENSIONS
        ]
    )
    sliced = explode_periods(combos, ["all", "quarter"])
    long = sliced.select(*ASSIGNMENT, *PERIOD, "cnt", F.inline(levels))
    counts = long.groupBy(*ASSIGNMENT, *PERIOD, "dimension", "level").agg(F.sum("cnt").alias("ticket_count"))
    whole = Window.partitionBy(*ASSIGNMENT, *PERIOD, "dimension")
    denominator = F.sum("ticket_count").over(whole)
    return counts.withColumn("dimension_denominator", denominator).withColumns(
        {
            "share": F.col("ticket_count") / F.col("dimension_denominator"),
            "missing_level_flag": F.col("level") == MISSING_LEVEL,
        }
    )


def case_mix_ranges(mix: DataFrame, floor: int = 30) -> DataFrame:
    """Smallest and largest share of each level over assignments with a tier and enough tickets."""
    return (
        mix.filter(
            (F.col("period_type") == FULL_PERIOD)
            & F.col("dimension").isin(*RANGE_DIMENSIONS)
            & F.col("agent_tier").isNotNull()
            & (F.col("dimension_denominator") >= floor)
        )
        .groupBy("dimension", "level")
        .agg(F.min("share").alias("minimum_agent_share"), F.max("share").alias("maximum_agent_share"))
    )


def case_mix_summary(mix: DataFrame) -> DataFrame:
    """JSON map dimension -> level -> share (6 digits) per assignment, keys sorted."""

    def as_map(key: str, value: str):
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))

    full = mix.filter(F.col("period_type") == FULL_PERIOD).withColumn("share", F.round("share", 6))
    per_dimension = full.groupBy(*ASSIGNMENT, "dimension").agg(as_map("level", "share").alias("levels"))
    # maps cannot be sorted, so the outer map is put in order through its JSON text
    packed = per_dimension.withColumn(
        "item", F.concat(F.to_json(F.array("dimension")), F.lit(":"), F.to_json("levels"))
    ).groupBy(*ASSIGNMENT).agg(F.array_sort(F.collect_list(F.struct("dimension", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: F.regexp_replace(x["item"], r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:")), ",")
    return packed.select(*ASSIGNMENT, F.concat(F.lit("{"), body, F.lit("}")).alias("case_mix_summary"))
