"""Centroid clustering in whole numbers with an incremental distance matrix.

Every vector keeps its exact dot product with each centroid. A round changes a product only by the components in which the
centroid moved, and the nearest centroid follows from products and norms. What reaches the driver are the sums of a cluster's
components: clusters times dimensions, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgauge.llm.common import Generations

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
_STATE = "vec_id long, q array<long>, norm long, dots array<long>, cluster int, distance long"


def _complete(vector: Column, dimensions: int) -> Column:
    """Has ``dimensions`` components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & fine, F.lit(False))


def quantized(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that take part: components as floor(scale * x). A component so large that distances would
    not fit into a long stops the job with a message, as no right answer could be given."""
    most = int((2**62 // dimensions) ** 0.5) // 2
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = table.where(_complete(F.col(vector), dimensions)).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))
    far = F.exists("q", lambda x: (x > most) | (x < -most))
    return rows.select("vec_id", F.when(far, F.raise_error(F.lit(f"components over {most // scale} are too large for whole distances"))).otherwise(F.col("q")).alias("q"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _moved(centres: list[list[int]], before: list[list[int]]) -> Callable:
    """Products after the centroids went from ``before`` to ``centres``, nearest centroid (ties: smaller number), distance."""
    norms = np.array([sum(x * x for x in c) for c in centres], np.int64)
    changes = []
    for own, old in zip(centres, before, strict=True):
        steps = np.array(own, np.int64) - np.array(old, np.int64)
        at = np.flatnonzero(steps)
        changes.append((at, steps[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vec_id, q, norm, dots = batch.columns[:4]
            x, products, own = _matrix(q, n), _matrix(dots, n).copy(), norm.to_numpy()
            for k, (at, steps) in enumerate(changes):
                if len(at):
                    products[:, k] += x[:, at] @ steps
            far = own[:, None] - 2 * products + norms
            near = far.argmin(axis=1)
            offsets = pa.array(np.arange(0, n * len(norms) + 1, len(norms), dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(products.ravel()))
            yield pa.RecordBatch.from_arrays([vec_id, q, norm, lists, pa.array(near.astype(np.int32)), pa.array(far[np.arange(n), near])], names=["vec_id", "q", "norm", "dots", "cluster", "distance"])

    return run


def clusters(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance (squared, in whole steps), cluster_inertia, inertia,
    centroid_sha256.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id`` (without an id: last; ties: smaller
    vector); a smaller table has fewer. Each round moves the centroids to the floor of their mean; empty ones stay. Once no
    centroid moves, later rounds could change nothing and are left out. Repeated rows count as often as they occur; vectors that
    are null or of another length, or have null or non-finite components, take no part; an empty table gives an empty one.
    The table of products is written anew in each round, after which the one before it is deleted.
    """
    base = quantized(table, vec_id, vector, dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centres = [list(r.q) for r in base.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()]
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x)
    state = base.select("vec_id", "q", norm.alias("norm"), F.array(*[F.lit(0).cast("long")] * len(centres)).cast("array<long>").alias("dots"))
    kept, before = Generations(table.sparkSession, "products"), [[0] * dimensions for _ in centres]
    for turn in range(rounds + 1 if centres else 0):
        state = kept.store(state.mapInArrow(_moved(centres, before), _STATE))
        if turn == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*"), *[F.sum(F.get("q", F.lit(i))) for i in range(dimensions)]).collect()
        means = {r[0]: [x // r[1] for x in r[2:]] for r in sums}
        before, centres = centres, [means.get(i, c) for i, c in enumerate(centres)]
        if before == centres:
            break
        state = state.select("vec_id", "q", "norm", "dots")
    if not centres:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return table.sparkSession.createDataFrame([], empty)
    found = dict(state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    inertia = [int(found.get(i, 0)) for i in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return state.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
