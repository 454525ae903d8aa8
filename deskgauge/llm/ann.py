"""Approximate nearest neighbours from balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on full lists. Every vector goes to its nearest list and, near a
boundary, to several more; lists of a query are found by walking an in-memory graph of the centroids and pruned by the ratio
of their distances. Only the centroids and their graph are held in memory; their number has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors fit at most ``centroids`` lists of about ``list_size`` vectors. A vector is stored in up to
    ``replicas`` lists within ``closure`` times its nearest distance. A query reads the lists within a ratio of its nearest
    distance that holds ``recall`` of the true neighbours of ``trials`` sampled vectors, and as many as hold ``least`` vectors.
    Neighbouring lists are compared in blocks of about ``chunk`` vectors with ``query_chunk`` queries; longer lists are split."""

    sample: int = 20_000
    centroids: int = 2_500
    list_size: int = 64
    replicas: int = 4
    closure: float = 1.2
    recall: float = 0.96
    trials: int = 100
    least: int = 400
    chunk: int = 8_192
    query_chunk: int = 1_024
    links: int = 16
    beam: int = 32
    seed: int = 11


def _balanced_centres(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means in which a list that holds more than its share looks further away."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].astype(np.float64)
    extra = np.zeros(k)
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        best = np.empty(len(x))
        for at in range(0, len(x), 4096):
            d = ((x[at : at + 4096] ** 2).sum(1)[:, None] - 2 * x[at : at + 4096] @ centres.T) + (centres**2).sum(1)
            near[at : at + 4096] = (d + extra).argmin(1)
            best[at : at + 4096] = d.min(1)
        sizes = np.bincount(near, minlength=k)
        extra += 0.05 * max(best.mean(), 0) * np.clip(sizes / (len(x) / k) - 1, -1, 3)
        extra -= extra.min()
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


class CentroidGraph:
    """Centroids, each linked to its nearest ones and a few others; searched best first for many vectors at once."""

    def __init__(self, centres: np.ndarray, links: int, seed: int) -> None:
        self.centres = centres
        k = len(centres)
        rng = np.random.default_rng(seed)
        d = (centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(links, max(k - 1, 1))]
        self.links = np.concatenate([near, rng.integers(0, k, (k, 4))], axis=1)
        self.entries = np.sort(rng.choice(k, min(k, 32), replace=False))

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to ``beam`` centroids for each row, nearest first; missing ones are -1 and infinite."""
        c, n, rows = self.centres, len(x), np.arange(len(x))[:, None]
        beam = min(beam, len(c))
        seen = np.zeros((n, len(c)), bool)

        def measured(ids: np.ndarray) -> np.ndarray:
            return np.sqrt(((c[ids] - x[:, None, :]) ** 2).sum(2))

        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[:, self.entries] = True
        dist = measured(ids)
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            open_ = np.where(done | (ids < 0), np.inf, dist)
            pick = np.argsort(open_, axis=1, kind="stable")[:, : max(1, beam // 16)]
            going = np.isfinite(open_[rows, pick])
            if not going.any():
                return ids, dist
            done[rows, pick] = True
            new = self.links[np.maximum(ids[rows, pick], 0)]
            fresh = (~seen[rows[:, :, None], new] & going[:, :, None]).reshape(n, -1)
            new = new.reshape(n, -1)
            # of a link listed twice only the first counts
            s = np.sort(np.where(fresh, new, -1), axis=1)
            new = np.where(np.concatenate([np.ones((n, 1), bool), s[:, 1:] != s[:, :-1]], axis=1), s, -1)
            a, b = np.nonzero(new >= 0)
            seen[a, new[a, b]] = True
            more = np.where(new >= 0, measured(np.maximum(new, 0)), np.inf)
            ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, more], axis=1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], axis=1)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def vectors_of(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part. Of several lengths the most frequent one does (ties: the shorter)."""
    rows = table.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (size.n if size else -1))


def _kind(vectors: DataFrame) -> str:
    """Type of the vectors, which keep the precision they came with."""
    return vectors.schema["vector"].dataType.simpleString()


def fit_centroids(vectors: DataFrame, settings: Settings) -> CentroidGraph | None:
    """A graph of centroids from a bounded sample by hash; None for an empty table."""
    count = vectors.count()
    if not count:
        return None
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).select("vector").toArrow().column(0))
    distinct = np.unique(sample, axis=0)
    k = int(max(1, min(settings.centroids, count // settings.list_size, len(distinct) // 4)))
    return CentroidGraph(_balanced_centres(distinct, k, settings.seed), settings.links, settings.seed)


def _homes(graph: CentroidGraph, x: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each vector and which of them count: the nearest, and near a boundary those almost as near."""
    ids, dist = graph.nearest(x, settings.beam)
    ids, dist = ids[:, : settings.replicas], dist[:, : settings.replicas]
    chosen = (ids >= 0) & (dist <= settings.closure * dist[:, :1])
    chosen[:, 0] = True
    return ids, chosen


def _lists(vectors: DataFrame, graph: CentroidGraph, settings: Settings) -> DataFrame:
    """(list, vec_id, vector): every vector in its lists."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, chosen = _homes(graph, _matrix(part.column(1)), settings)
                rows, places = np.nonzero(chosen)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows, places].astype(np.int32)), taken.column(0), taken.column(1)], names=["list", "vec_id", "vector"])

    return vectors.mapInArrow(assign, f"list int, vec_id long, vector {_kind(vectors)}")


def fit_ratio(vectors: DataFrame, graph: CentroidGraph, settings: Settings, top: int) -> tuple[float, int]:
    """The distance ratio that lists must be within to hold ``recall`` of true neighbours, and how many lists that is for most.

    The true neighbours of ``trials`` vectors are found by one pass over all vectors; each task returns ``top`` for each.
    """
    trial = vectors.orderBy(F.xxhash64(F.lit("trial"), "vec_id"), "vec_id").limit(settings.trials).toArrow()
    names, x = trial["vec_id"].to_numpy(), _matrix(trial["vector"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, y = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for t, v in zip(names, x, strict=True):
                d = np.where(own == t, np.inf, ((y - v) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable")[:top]
                best = best[np.isfinite(d[best])]
                kept = batch.take(pa.array(best))
                yield pa.RecordBatch.from_arrays([pa.array([int(t)] * len(best), pa.int64()), pa.array(d[best]), kept.column(1)], names=["trial", "d", "vector"])

    found = vectors.mapInArrow(exact, f"trial long, d double, vector {_kind(vectors)}")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy("d"))).where(F.col("n") <= top).select("trial", "vector").toArrow()
    ids, dist = graph.nearest(x, len(graph.centres))
    if not best.num_rows:
        return 1.0, 1
    homes, chosen = _homes(graph, _matrix(best["vector"]), settings)
    at = {t: i for i, t in enumerate(names)}
    needed = []
    for t, lists, some in zip(best["trial"].to_numpy(), homes, chosen, strict=True):
        row = at[t]
        ratios = dist[row][np.isin(ids[row], lists[some])] / max(dist[row][0], 1e-300)
        needed.append(ratios.min() if len(ratios) else np.inf)
    ratio = float(np.quantile(needed, settings.recall, method="higher"))
    within = int((dist <= ratio * dist[:, :1]).sum(axis=1).max())
    return ratio, min(len(graph.centres), within + within // 4 + 1)


def _blocks(graph: CentroidGraph, sizes: np.ndarray, settings: Settings) -> np.ndarray:
    """A block number for each list: neighbouring lists share one of about ``chunk`` vectors, larger lists have their own."""
    c = graph.centres - graph.centres.mean(axis=0)
    axis = np.linalg.svd(c, full_matrices=False)[2][0] if len(c) > 1 else np.ones(c.shape[1])
    out, block, held = np.zeros(len(c), np.int32), 0, 0
    for i in np.argsort(c @ axis, kind="stable"):
        if held and held + sizes[i] > settings.chunk:
            block, held = block + 1, 0
        out[i] = block
        held += sizes[i]
    return out


def _lists_within(graph: CentroidGraph, x: np.ndarray, sizes: np.ndarray, ratio: float, beam: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of each row, nearest first, and which of them it reads: those within the ratio of its nearest distance, and as many
    as hold ``least`` vectors. A row whose last list found is still wanted is searched again with a wider beam, until one is
    not or the centroids end; so no number of lists is fixed."""

    def measured(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids, dist = graph.nearest(x[rows], width)
        held = np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0)
        before = np.cumsum(held, axis=1) - held
        return ids, (ids >= 0) & ((dist <= ratio * dist[:, :1]) | (before < least))

    ids, wanted = measured(np.arange(len(x)), beam)
    while ids.shape[1] < len(graph.centres) and (again := np.flatnonzero(wanted[:, -1])).size:
        wide, more = measured(again, 2 * ids.shape[1])
        room = ((0, 0), (0, wide.shape[1] - ids.shape[1]))
        ids, wanted = np.pad(ids, room, constant_values=-1), np.pad(wanted, room)
        ids[again], wanted[again] = wide, more
    return ids, wanted


def _probes(queries: DataFrame, graph: CentroidGraph, sizes: np.ndarray, blocks: np.ndarray, ratio: float, most: int, settings: Settings) -> DataFrame:
    """(block, query_id, vector, lists): for each block the lists within the ratio of the nearest, at least as many in all
    as hold ``least`` vectors."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, wanted = _lists_within(graph, _matrix(part.column(1)), sizes, ratio, max(settings.beam, most), settings.least)
                rows, found, lists = [], [], []
                for row in range(len(ids)):
                    own = ids[row][wanted[row]]
                    for block in np.unique(blocks[own]):
                        rows.append(row)
                        found.append(block)
                        lists.append(own[blocks[own] == block].tolist())
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), taken.column(0), taken.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["block", "query_id", "vector", "lists"])

    return queries.mapInArrow(probe, f"block int, query_id long, vector {_kind(queries)}, lists array<int>")


def _nearest_in_block(top: int):
    """For each query the nearest vectors of its lists in one block."""

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not held.num_rows or not asked.num_rows:
            return empty
        own, lists, x = held["vec_id"].to_numpy(), held["list"].to_numpy(), _matrix(held["vector"])
        out = []
        for q, v, some in zip(asked["query_id"].to_numpy(), _matrix(asked["vector"]), asked["lists"].to_pylist(), strict=True):
            at = np.flatnonzero(np.isin(lists, some) & (own != q))
            d = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
            order = np.lexsort((own[at], d))
            _, first = np.unique(own[at][order], return_index=True)  # a repeated id counts once, at its nearest
            order = order[np.sort(first)][:top]
            out.append((np.full(len(order), q), own[at][order], d[order]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return compare


def search(table: DataFrame, wanted: Column, top: int = 10, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for the rows ``wanted`` (a condition on vec_id).

    Every usable row is indexed. A query doesn't find rows with its own id; an id is found once, at its nearest row. Ties go
    to the smaller id; with fewer candidates all are returned. Vectors that are null, zero, of an unusual length, or hold
    null or non-finite components take no part. An empty table gives an empty result.
    """
    vectors = vectors_of(table, vec_id, vector)
    graph = fit_centroids(vectors, settings)
    if graph is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = stored(_lists(vectors, graph, settings), "posting-lists")
    sizes = np.zeros(len(graph.centres), np.int64)
    for row in lists.groupBy("list").count().collect():  # one row per centroid, a fixed bound
        sizes[row.list] = row["count"]
    ratio, most = fit_ratio(vectors, graph, settings, top)
    blocks = _blocks(graph, sizes, settings)
    held = np.bincount(blocks, weights=sizes).astype(np.int64)
    probes = stored(_probes(vectors.where(wanted), graph, sizes, blocks, ratio, most, settings), "probes")
    asked = np.zeros(len(held), np.int64)
    for row in probes.groupBy("block").count().collect():
        asked[row.block] = row["count"]
    parts = np.maximum(-(-held // settings.chunk), 1).tolist()
    rounds = np.maximum(-(-asked // settings.query_chunk), 1).tolist()
    part_of, round_of = F.get(F.lit(parts), F.col("block")), F.get(F.lit(rounds), F.col("block"))
    some = F.get(F.lit((asked > 0).tolist()), F.col("block"))  # blocks that no query reads stay where they are
    left = lists.withColumn("block", F.get(F.lit(blocks.tolist()), F.col("list"))).where(some)
    left = left.select("block", F.pmod(F.xxhash64("vec_id"), part_of).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), (round_of - 1).cast("int"))).alias("round"), "list", "vec_id", "vector")
    right = probes.select("block", F.explode(F.sequence(F.lit(0), (part_of - 1).cast("int"))).alias("part"), F.pmod(F.xxhash64("query_id"), round_of).cast("int").alias("round"), "query_id", "vector", "lists")
    keys = ["block", "part", "round"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest_in_block(top), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
