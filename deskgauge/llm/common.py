"""Helpers that several operators share: stored tables, text keys, free column names, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a folder of this process (local mode only)."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN_FOLDER.setdefault("path", tempfile.mkdtemp(prefix="deskgauge-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Generations:
    """Tables of which each is made from the one before: when the next is written, the one before it is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.last = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", None
        self.number = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write a table that reads at most the last one stored here."""
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        if self.last:
            delete_folder(self.spark, self.last)
        self.last, self.number = path, self.number + 1
        return self.spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 that stand for a whole text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a long, b long); root is the smallest node reachable.

    Alternating large-star and small-star steps: each node's neighbours are pointed at the smallest one until nothing
    changes. Every step pre-aggregates the minimum per node and joins it back, so a hub is a skewed join that adaptive
    execution splits and never one task's list. Each round is written, so its lineage is short.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        links = stored(_small_star(_large_star(links)), "edges")
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each row has a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = links.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()
