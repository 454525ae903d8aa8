"""Mixing sources to target weights by hierarchical budgets.

The token budget goes down a tree domain -> language -> source by weights. A node never gets more than its texts hold over
the allowed epochs; what it can't take goes to its siblings by their weights, and only a wholly filled family passes a
shortage on to its parent's siblings. Each leaf then takes whole seeded epochs and a prefix of the next one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.llm.common import stored

TREE = ("domain", "lang", "source")
NUMBER = "decimal(38,0)"


@dataclass(frozen=True)
class Mix:
    """``budget``: share of all tokens, in thousandths. ``weights``: for each level names and whole-number weights; others get
    ``other``. ``buckets``: parts of a leaf's epoch whose sums are ordered before any single document is."""

    budget: int = 700
    epochs: int = 2
    seed: int = 17
    buckets: int = 1024
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"d0": 40, "d1": 30}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}})
    other: int = 10


def domain_of(source: Column) -> Column:
    """The tables name no domain: a source belongs to one of four by its checksum."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 4).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words, at least one, so that empty texts use up an epoch too."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(1)).cast("long")


def _draw(mix: Mix, epoch: Column, identity: Column) -> Column:
    """60 bits that order a leaf's documents in an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), identity).cast("binary")), 1, 15), 16, 10).cast("long")


def _share(nodes: DataFrame, mix: Mix, level: str, family: list[str]) -> DataFrame:
    """Adds ``budget`` to nodes with ``capacity`` and their parent's ``given``: water-filling among siblings.

    Siblings are ordered by capacity per weight. One that can't hold its share of what is left after those before it is
    filled; the others share the rest by weight. All numbers are whole; what rounding leaves (less than one token a node)
    stays unspent.
    """
    known = mix.weights.get(level, {})
    weight = F.lit(mix.other)
    for name, value in known.items():
        weight = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(value)).otherwise(weight)
    nodes = nodes.withColumn("weight", weight.cast(NUMBER))
    order = Window.partitionBy(*family).orderBy((F.col("capacity").cast("double") / F.col("weight").cast("double")), F.col(level))
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    below = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(above), F.lit(0))).withColumn("weights", F.sum("weight").over(below))
    fits = F.col("capacity") * F.col("weights") <= F.col("left") * F.col("weight")  # capped
    # the first sibling that isn't filled fixes the level of all after it
    nodes = nodes.withColumn("fits", fits)
    first = Window.partitionBy(*family, "fits").orderBy((F.col("capacity").cast("double") / F.col("weight").cast("double")), F.col(level))
    nodes = nodes.withColumn("rest", F.first("left").over(first)).withColumn("rest_weights", F.first("weights").over(first))
    shared = F.expr("CAST((rest * weight) DIV rest_weights AS DECIMAL(38,0))")
    return nodes.withColumn("budget", F.when(F.col("fits"), F.col("capacity")).otherwise(F.least(F.col("capacity"), shared)).cast(NUMBER)).drop("weight", "left", "weights", "fits", "rest", "rest_weights")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``budget`` to leaves (the columns of ``TREE`` and ``tokens``)."""
    leaves = leaves.withColumn("capacity", (F.col("tokens") * mix.epochs).cast(NUMBER))
    given = None
    for depth, level in enumerate(TREE):
        family = list(TREE[:depth])
        nodes = leaves.groupBy(*TREE[: depth + 1]).agg(F.sum("capacity").cast(NUMBER).alias("capacity"), F.sum("tokens").cast(NUMBER).alias("held"))
        if given is None:
            total = Window.partitionBy()
            nodes = nodes.withColumn("given", F.floor(F.sum("held").over(total) * mix.budget / 1000).cast(NUMBER))
        else:
            renamed = given.select(*[F.col(f).alias(f"p_{f}") for f in family], F.col("budget").alias("given"))
            match = F.lit(True)
            for f in family:
                match = match & F.col(f).eqNullSafe(F.col(f"p_{f}"))
            nodes = nodes.join(renamed, match).drop(*[f"p_{f}" for f in family])
        given = _share(nodes, mix, level, family)
    return given.select(*TREE, F.col("held").alias("tokens"), "budget")


def _identity(doc_id: str, text: str) -> Column:
    """Id and checksum of the text: rows that share both are taken together."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _same_leaf(columns=TREE) -> Column:
    match = F.lit(True)
    for c in columns:
        match = match & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return match


def selected(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, identity, domain, lang, source, rows, tokens, copies): how many epochs take each document, 0 for none.

    A leaf with budget b and t tokens takes every document ``b div t`` times and, of the next epoch in seeded order, those
    that begin before token ``b mod t`` (so at most one document over). The order within a leaf is found in two steps: sums
    of ``buckets`` parts of the hash range, then single documents in the one part where the prefix ends. Null languages and
    sources are groups of their own. Repeated rows (same id, text, language and source) are one row here, with their number
    in ``rows`` and their summed tokens, and are taken together. Empty tables give empty ones.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _identity(doc_id, text).alias("identity"), domain_of(F.col(source)).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), tokens_of(F.col(text)).alias("tokens"))
    rows = stored(rows.groupBy("doc_id", "identity", *TREE).agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "mix-rows")
    plan = budgets(rows.groupBy(*TREE).agg(F.sum("tokens").cast(NUMBER).alias("tokens")), mix)
    leaf, drop = [F.col(c).alias(f"p_{c}") for c in TREE], [f"p_{c}" for c in TREE]
    plan = plan.select(*leaf, F.expr("CAST(budget DIV tokens AS INT)").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest"))
    drawn = rows.join(plan, _same_leaf()).drop(*drop).withColumn("draw", _draw(mix, F.col("full"), F.col("identity")))
    drawn = stored(drawn.withColumn("bucket", F.expr(f"CAST(draw DIV {-(-(1 << 60) // mix.buckets)} AS INT)")), "mix-draws")
    parts = drawn.groupBy(*TREE, "rest", "bucket").agg(F.sum("tokens").alias("sum"))
    order = Window.partitionBy(*TREE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("sum").over(order), F.lit(0))).select(*leaf, F.col("bucket").alias("p_bucket"), "before", (F.col("before") + F.col("sum") > F.col("rest")).alias("ends")), "mix-parts")
    placed = drawn.join(parts, _same_leaf((*TREE, "bucket"))).drop(*drop, "p_bucket")
    # beyond the part where the prefix ends nothing is taken, before it everything is
    edge = placed.where("ends and before < rest")
    begins = Window.partitionBy(*TREE).orderBy("draw", "identity").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("more", (F.col("before") + F.coalesce(F.sum("tokens").over(begins), F.lit(0)) < F.col("rest")).cast("int"))
    other = placed.where("not (ends and before < rest)").withColumn("more", (~F.col("ends")).cast("int"))
    columns = ["doc_id", "identity", *TREE, "rows", "tokens", (F.col("full") + F.col("more")).alias("copies")]
    return edge.select(*columns).union(other.select(*columns))


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mix, all columns, each as often as its leaf takes it."""
    chosen = selected(docs, mix, text, source, lang, doc_id).where("copies > 0")
    chosen = chosen.select(F.col("identity").alias("p_identity"), F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), F.col("copies").alias("p_copies"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _identity(doc_id, text).alias("identity"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    out = keyed.join(chosen, _same_leaf(("identity", "lang", "source")))
    return out.select("row", F.explode(F.sequence(F.lit(1), "p_copies"))).select("row.*")
