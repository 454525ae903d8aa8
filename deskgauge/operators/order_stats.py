"""Exact order statistics that never gather a whole group in one task.

A group's values are first collapsed to (value, count). Approximate splitters cut the distinct values of the group into
buckets; exact bucket counts then tell which bucket holds a wanted rank, and only those buckets are sorted. The
splitters affect balance only: a rank always falls into exactly one bucket, so the result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.functions.keys import join_null_safe

BUCKETS = 64


def long_counts(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """(keys, measure, value, cnt) with NULL values left out; one pass and one map-side combined shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("value")) for m, c in measures.items()]
    )
    long = df.select(*keys, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"))
    return long.groupBy(*keys, F.col("p.measure").alias("measure"), F.col("p.value").alias("value")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def _bucketed(counts: DataFrame, group: list[str], buckets: int) -> DataFrame:
    grid = [i / buckets for i in range(1, buckets)]
    # reading cnt here keeps this branch's shuffle identical to the other readers of ``counts``, so it runs once
    counted = F.when(F.col("cnt") > 0, F.col("value"))
    splits = counts.groupBy(*group).agg(F.percentile_approx(counted, grid, 1000).alias("splits"))
    return join_null_safe(counts, splits, group, "inner").select(
        *group, "value", "cnt", F.size(F.filter("splits", lambda s: s < F.col("value"))).alias("bucket")
    )


def _bucket_prefix(bucketed: DataFrame, group: list[str]) -> DataFrame:
    sizes = bucketed.groupBy(*group, "bucket").agg(F.sum("cnt").alias("bucket_rows"))
    whole = Window.partitionBy(*group)
    return sizes.withColumns(
        {
            "before": F.sum("bucket_rows").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("bucket_rows"),
            "n": F.sum("bucket_rows").over(whole),
        }
    )


def percentiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probabilities: Mapping[str, Mapping[str, float]], buckets: int = BUCKETS
) -> DataFrame:
    """Linear-interpolation percentiles per group from :func:`long_counts` rows.

    ``probabilities`` maps a measure to ``{result column: p}``; the result has one row per key with those columns.
    """
    group = [*keys, "measure"]
    bucketed = _bucketed(counts, group, buckets)
    prefix = _bucket_prefix(bucketed, group)

    wanted = []
    for measure, columns in probabilities.items():
        for name, p in columns.items():
            position = (F.col("n") - 1) * F.lit(p)
            for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
                wanted.append(
                    F.when(
                        F.col("measure") == measure,
                        F.struct(
                            F.lit(name).alias("name"),
                            F.lit(side).alias("side"),
                            (rank - F.col("before")).cast("bigint").alias("rank"),
                            (position - F.floor(position)).alias("weight"),
                        ),
                    )
                )
    targets = prefix.select(
        *group,
        "bucket",
        F.filter(
            F.array(*wanted), lambda t: t.isNotNull() & (t["rank"] >= 0) & (t["rank"] < F.col("bucket_rows"))
        ).alias("targets"),
    ).filter(F.size("targets") > 0)

    in_bucket = Window.partitionBy(*group, "bucket").orderBy("value")
    upto = F.sum("cnt").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    ranked = join_null_safe(bucketed, targets, [*group, "bucket"], "inner").withColumn("upto", upto)
    hits = ranked.select(
        *keys,
        "value",
        F.explode(
            F.filter(
                "targets", lambda t: (t["rank"] < F.col("upto")) & (t["rank"] >= F.col("upto") - F.col("cnt"))
            )
        ).alias("t"),
    )

    def side(name: str, which: str):
        return F.max(F.when((F.col("t.name") == name) & (F.col("t.side") == which), F.col("value")))

    def interpolated(name: str):
        low, high = side(name, "lo"), side(name, "hi")
        return low + (high - low) * F.max(F.when(F.col("t.name") == name, F.col("t.weight")))

    names = [name for columns in probabilities.values() for name in columns]
    return hits.groupBy(*keys).agg(*[interpolated(n).alias(n) for n in names])


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, Mapping[str, float]]], buckets: int = BUCKETS
) -> DataFrame:
    """Percentiles of columns: ``specs`` maps a measure to ``(column, {result column: p})``."""
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(1)), ["__all"]
    counts = long_counts(df, keys, {m: c for m, (c, _) in specs.items()})
    result = percentiles_of_counts(counts, keys, {m: p for m, (_, p) in specs.items()}, buckets)
    return result.drop("__all")


def average_ranks(df: DataFrame, value: str, rank: str, keys: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Distinct values with their average rank (ties share it), computed bucket by bucket."""
    counts = long_counts(df, keys, {"v": value})
    group = [*keys, "measure"]
    bucketed = _bucketed(counts, group, buckets)
    prefix = _bucket_prefix(bucketed, group).select(*group, "bucket", "before")
    in_bucket = Window.partitionBy(*group, "bucket").orderBy("value")
    upto = F.col("before") + F.sum("cnt").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    placed = join_null_safe(bucketed, prefix, [*group, "bucket"], "inner")
    return placed.select(*keys, F.col("value").alias(value), (upto - (F.col("cnt") - 1) / 2).alias(rank))
