"""Sinks: Parquet, JSON reports, CSV exports, a result cache and a published bundle with manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgauge.functions.keys import content_hash

# --- fixed values: exported columns in order ----------------------------------------------------------------------
EXPORT_COLUMNS = {
    "training_priority": (
        "agent_id team tier peer_group priority_status priority_band priority_rank priority_score evidence_strength "
        "stability uncertainty priority_reason representative_ticket_ids"
    ).split(),
    "agent_performance": (
        "agent_id agent_team agent_tier agent_site agent_shift comparison_group ticket_count completed_ticket_count "
        "csat_completed_response_count csat_response_rate raw_mean_csat peer_mean_csat csat_gap handle_time_median "
        "raw_handle_time_mean peer_handle_time_mean handle_time_gap sla_breach_rate peer_sla_breach_rate sla_gap "
        "evidence_strength stability priority_status"
    ).split(),
    "agent_economics": (
        "agent_id agent_team agent_tier ticket_count completed_ticket_count operational_cost_exposure_inr "
        "internal_transfer_cost_exposure_inr replacement_exposure_inr refund_exposure_inr total_relevant_exposure_inr"
    ).split(),
}


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Zstd Parquet; large facts can be partitioned, for example by reporting month."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def nested_report(**sections: DataFrame) -> DataFrame:
    """One row with a struct per one-row section."""
    spark = next(iter(sections.values())).sparkSession
    columns = [d.select(F.struct(*d.columns)).scalar().alias(name) for name, d in sections.items()]
    return spark.range(1).select(*columns)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row nested report as JSON."""
    report.write.mode(mode).option("ignoreNullFields", False).json(path)


def flat_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in the given order, absent ones as NULL, nested ones as JSON text."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    chosen = []
    for c in columns:
        if c not in kinds:
            chosen.append(F.lit(None).cast("string").alias(c))
        elif kinds[c] in ("array", "struct", "map"):
            chosen.append(F.to_json(F.col(c)).alias(c))
        else:
            chosen.append(F.col(c))
    return df.select(*chosen)


def export_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    flat_columns(df, columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


# --- result cache -------------------------------------------------------------------------------------------------
def cache_append(results: DataFrame, path: str) -> None:
    """Append (request_key, value) of accepted results; request texts are never stored."""
    results.select("request_key", "value", F.current_timestamp().alias("cached_at")).write.mode("append").parquet(path)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached value (the newest of a key) and whether they hit."""
    newest = cache.groupBy("request_key").agg(F.max_by("value", "cached_at").alias("cached_value"))
    return requests.join(newest, "request_key", "left").withColumn("cache_hit", F.col("cached_value").isNotNull())


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "request_key", "left_anti")


class KeyedCache:
    """A result cache as a table bucketed and sorted by ``request_key``, one row a key.

    A lookup shuffles the requests to the buckets of the table and never the table. ``merge`` joins accepted results to the
    buckets and writes the next table, so repeated results of a key don't pile up; the old table is replaced only when the new
    one is complete, and a merge that broke off between the two steps is finished by the next use. Spark shuffles a bucketed side after
    all where it has fewer buckets than ``spark.sql.shuffle.partitions``, so that is the least number.
    """

    columns = "request_key string, value string, cached_at timestamp"

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None) -> None:
        self.spark, self.table, self.next = spark, table, f"{table}_next"
        self.buckets = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(self) -> DataFrame:
        """The cached rows, none before the first merge."""
        if not self.spark.catalog.tableExists(self.table):
            if not self.spark.catalog.tableExists(self.next):
                return self.spark.createDataFrame([], self.columns)
            self.spark.sql(f"ALTER TABLE {self.next} RENAME TO {self.table}")
        return self.spark.table(self.table)

    def merge(self, results: DataFrame) -> None:
        """Add (request_key, value) of accepted results; a key that is already there gets the new value. Of several values for a
        key in ``results`` the greatest is taken; rows without a key are left out."""
        old = self.read()
        fresh = results.where("request_key is not null").groupBy("request_key").agg(F.max("value").alias("new_value"))
        both = old.join(fresh, "request_key", "full_outer")
        renewed = F.col("new_value").isNotNull()
        rows = both.select(
            "request_key", F.coalesce("new_value", "value").alias("value"), F.when(renewed, F.current_timestamp()).otherwise(F.col("cached_at")).alias("cached_at")
        )
        self.spark.sql(f"DROP TABLE IF EXISTS {self.next}")
        rows.repartition(self.buckets, "request_key").write.bucketBy(self.buckets, "request_key").sortBy("request_key").saveAsTable(self.next)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.spark.sql(f"ALTER TABLE {self.next} RENAME TO {self.table}")

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Requests with their cached value and whether they hit."""
        known = self.read().select("request_key", F.col("value").alias("cached_value"))
        return requests.join(known, "request_key", "left").withColumn("cache_hit", F.col("cached_value").isNotNull())

    def misses(self, requests: DataFrame) -> DataFrame:
        return cache_misses(requests, self.read().select("request_key"))


# --- published bundle ---------------------------------------------------------------------------------------------
def manifest_row(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), content_hash(df).cast("string").alias("content_hash")).select(
        F.lit(table).alias("table"), "row_count", F.lit(",".join(df.columns)).alias("columns"), "content_hash"
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def publish_bundle(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], folder: str) -> DataFrame:
    """Write each table reduced to its allowed columns, then the manifest computed from what was written.

    The manifest comes last and existing folders are refused, so a half-written bundle is never valid.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (df, allowed) in tables.items():
        missing = sorted(set(allowed) - set(df.columns))
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        write_table(df.select(*allowed), f"{folder}/{name}", mode="error")
    written = [manifest_row(spark.read.parquet(f"{folder}/{name}"), name) for name in tables]
    manifest = _union(written)
    manifest.coalesce(1).write.mode("error").json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def bundle_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the tables found on disk, from file paths only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    name = F.element_at(F.split("path", "/"), -2)
    return files.load(folder).select(name.alias("table")).distinct()


def validate_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Per table: present in both, same rows, same columns, same content; otherwise what is wrong."""
    schema = "table string, row_count bigint, columns string, content_hash string"
    manifest = spark.read.schema(schema).json(f"{folder}/manifest")
    found = [r["table"] for r in bundle_tables(spark, folder).collect()]
    actual = _union([manifest_row(spark.read.parquet(f"{folder}/{t}"), t) for t in found])
    m, a = manifest.alias("m"), actual.alias("a")
    both = m.join(a, F.col("m.table") == F.col("a.table"), "full_outer")
    status = (
        F.when(F.col("a.table").isNull(), "missing_on_disk")
        .when(F.col("m.table").isNull(), "not_in_manifest")
        .when(F.col("m.columns") != F.col("a.columns"), "columns_differ")
        .when(F.col("m.row_count") != F.col("a.row_count"), "row_count_differs")
        .when(F.col("m.content_hash") != F.col("a.content_hash"), "content_differs")
        .otherwise("valid")
    )
    return both.select(F.coalesce("m.table", "a.table").alias("table"), F.col("a.row_count").alias("row_count"), status.alias("status"))
