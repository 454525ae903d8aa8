"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Values such as 1/128 end in a 5 right behind the sixth digit. Both sides add the same tiny amount before rounding, so
# that the last bit of a sum does not decide which way such a value goes.
NUDGE = 1.3e-9


def nudge_rounding(sql: str) -> str:
    """Apply the nudge to every ``round(expr, 6)`` of a SQL text."""
    done, rest = "", sql
    while "round(" in rest:
        start = rest.index("round(") + len("round(")
        depth, end, comma = 1, start, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            comma = end if rest[end] == "," and depth == 1 else comma
            end += 1
        inner, digits = nudge_rounding(rest[start:comma]), rest[comma + 1 : end - 1].strip()
        if comma < 0:
            done, rest = done + rest[:end], rest[end:]
            continue
        shown = f"CAST({inner} AS DOUBLE) + {NUDGE}" if digits == "6" else inner
        done += rest[: start] + f"{shown}, {digits})"
        rest = rest[end:]
    return done + rest


def configure(spark: SparkSession) -> None:
    """Session settings the queries rely on: times are read and shown in UTC; wide projections stay below the 8,000 bytes of
    code a method beyond which HotSpot leaves it interpreted."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def query(name: str, sql: str | None = None):
    """Register a query; results are given comparable types (see :func:`present`)."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return present(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudge_rounding(sql)
        return build

    return register


def present(df: DataFrame) -> DataFrame:
    """Counts as bigint, measures rounded to 6 digits, money as double with 2, times and lists as text."""
    columns = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("byte", "short", "integer", "long"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
        elif kind == "decimal":
            c = c.cast("bigint") if f.dataType.scale == 0 else F.round(c, 2).cast("double")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind in ("struct", "map"):
            c = F.to_json(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def out(keys: str = "", n: str = "", x: str = "", money: str = "", ts: str = "", flags: str = "") -> str:
    """Select list for the SQL side with the same presentation rules; names are given as blank-separated words."""
    parts = [*keys.split(), *flags.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in n.split()]
    parts += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in x.split()]
    parts += [f"CAST(round({c}, 2) AS DOUBLE) AS {c}" for c in money.split()]
    parts += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in ts.split()]
    return ", ".join(parts)


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint directory; only local sessions may do without, in the warehouse's place."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "scratch")
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """Write an intermediate table once per application and input, then read it back.

    Later stages start from the written table, as stages of a batch job do, and lineage stays short.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        path = scratch(spark, name)
        build(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])
