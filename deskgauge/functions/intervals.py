"""Normal-approximation intervals from sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def clipped(lower: Column, upper: Column, bounds: tuple[float, float] | None) -> tuple[Column, Column]:
    if bounds is None:
        return lower, upper
    floor, ceiling = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    # greatest/least skip NULLs, so an undefined interval must stay undefined
    return (
        F.when(lower.isNotNull(), F.greatest(floor, lower)),
        F.when(upper.isNotNull(), F.least(ceiling, upper)),
    )


def centre_and_error(centre: Column, error: Column, bounds=None, z: float = Z95) -> tuple[Column, Column]:
    return clipped(centre - F.lit(z) * error, centre + F.lit(z) * error, bounds)


def mean_interval(value: Column, bounds=None, z: float = Z95) -> dict[str, Column]:
    """Aggregates for count, mean, standard error and clipped interval of ``value`` (NULLs ignored)."""
    n, mean = F.count(value), F.avg(value)
    error = F.when(n >= 2, F.stddev_samp(value) / F.sqrt(n))
    lower, upper = centre_and_error(mean, error, bounds, z)
    return {"sample_size": n, "mean": mean, "standard_error": error, "ci_lower": lower, "ci_upper": upper}


def difference_interval(
    mean_a: Column, se_a: Column, mean_b: Column, se_b: Column, bounds=None, z: float = Z95
) -> dict[str, Column]:
    """Interval of the difference of two independent means."""
    error = F.sqrt(se_a * se_a + se_b * se_b)
    lower, upper = centre_and_error(mean_a - mean_b, error, bounds, z)
    return {"gap": mean_a - mean_b, "standard_error": error, "ci_lower": lower, "ci_upper": upper}


def direction(lower: Column, upper: Column) -> Column:
    return (
        F.when(lower.isNull(), "insufficient")
        .when(lower > 0, "higher")
        .when(upper < 0, "lower")
        .otherwise("overlaps_zero")
    )


def evidence_label(n: Column, floor: int = 30) -> Column:
    return F.when(n < floor, f"below {floor} eligible rows").otherwise(
        f"{floor} eligible rows or more, see the interval"
    )
