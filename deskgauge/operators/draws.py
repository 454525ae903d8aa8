"""Draws of a bootstrap as one list per drawn row, and sums weighted by them.

How often a row was drawn in each replicate is one binary value: each count as so many one bits and a zero bit, about two
bits a count where one draw is made per row. Sums of a key under all replicates are one small table, so neither draws nor
replicates are ever rows beside the values they weigh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: Rows of a key in one batch from which on its sums are sent instead of the rows.
SUMMED_FROM = 32


def pack(counts: np.ndarray) -> pa.Array:
    """One binary value per row of ``counts`` (rows x replicates)."""
    ends = np.cumsum(counts + 1, axis=1)
    bits_of = ends[:, -1]
    offsets = np.concatenate(([0], np.cumsum((bits_of + 7) // 8)))
    starts = offsets[:-1] * 8
    edge = np.zeros(offsets[-1] * 8 + 1, np.int8)
    edge[starts] += 1
    edge[starts + bits_of] -= 1  # a row's padding may be empty, then the next row starts here
    bits = np.cumsum(edge[:-1], dtype=np.int8)
    bits[(starts[:, None] + ends - 1).ravel()] = 0
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.packbits(bits.view(np.uint8)))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), buffers).cast(pa.binary())


def unpack(packed: pa.Array, replicates: int) -> np.ndarray:
    """The counts of :func:`pack`; no value may be null."""
    packed = packed.cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    zeros = np.flatnonzero(np.unpackbits(data) == 0)
    starts = (offsets[:-1] - offsets[0]) * 8
    ends = zeros[np.searchsorted(zeros, starts)[:, None] + np.arange(replicates)]
    return np.diff(ends, axis=1, prepend=starts[:, None] - 1) - 1


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _counted(replicates: int) -> Callable[[Batches], Batches]:
    """(idx, replicate) sorted by idx to one packed row per idx."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pack(counts)], names=["idx", "times"])

    def run(batches: Batches) -> Batches:
        key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, replicate = (c.to_numpy() for c in batch.columns)
            starts = _starts(idx)
            at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(idx))))
            counts = np.bincount(at * replicates + replicate - 1, minlength=len(starts) * replicates).reshape(-1, replicates)
            keys = idx[starts]
            if held is not None:
                if keys[0] == key:
                    counts[0] += held
                else:
                    keys, counts = np.append(key, keys), np.vstack((held, counts))
            key, held = keys[-1], counts[-1]
            if len(keys) > 1:
                yield rows(keys[:-1], counts[:-1])
        if held is not None:
            yield rows(np.array([key]), held[None])

    return run


def times_drawn(draws: DataFrame, replicates: int) -> DataFrame:
    """(idx, times) of (idx, replicate) rows, replicates from 1 on; an index that no replicate drew has no row."""
    spread = draws.select(F.col("idx").cast("bigint"), F.col("replicate").cast("int")).repartition("idx").sortWithinPartitions("idx")
    return spread.mapInArrow(_counted(replicates), "idx bigint, times binary")


def _weigh(values: list[pa.Array], times: np.ndarray) -> Callable[[int, int], np.ndarray]:
    """Of a run of rows: per value its weighted sum and count, and last the draws themselves, by replicate."""
    known = np.stack([v.is_valid().to_numpy(zero_copy_only=False) for v in values]).astype(float)
    plain = np.stack([v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values])
    finite = np.isfinite(plain)
    stacked = np.concatenate((np.where(finite, plain, 0.0), known, np.ones((1, times.shape[0]))))
    odd = np.flatnonzero(~finite.all(axis=0))
    weights = times.astype(float)

    def total(a: int, b: int) -> np.ndarray:
        sums = stacked[:, a:b] @ weights[a:b]
        for row in odd[(odd >= a) & (odd < b)]:  # infinite and NaN values count only where they were drawn
            drawn = weights[row] > 0
            for v in np.flatnonzero(~finite[:, row]):
                sums[v, drawn] += plain[v, row]
        return sums

    return total


def _combined(width: int, replicates: int) -> Callable[[Batches], Batches]:
    """Rows of keys with many rows in a batch become one row with their sums; the others pass."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            key, times = batch.column(0), batch.column(1 + width)
            codes = key.dictionary_encode().indices.to_numpy()
            often = np.bincount(codes)[codes] >= SUMMED_FROM if len(codes) else np.zeros(0, bool)
            rest = batch.filter(pa.array(~often))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.nulls(rest.num_rows, pa.binary())], names=[*batch.schema.names, "sums"])
            if often.any():
                at = np.flatnonzero(often)
                at = at[np.argsort(codes[at], kind="stable")]
                starts = _starts(codes[at])
                some = batch.take(pa.array(at))
                total = _weigh(some.columns[1 : 1 + width], unpack(some.column(1 + width), replicates))
                sums = [total(a, b).tobytes() for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True)]
                empty = [pa.nulls(len(sums), pa.float64())] * width
                yield pa.RecordBatch.from_arrays([key.take(pa.array(at[starts])), *empty, pa.nulls(len(sums), pa.binary()), pa.array(sums, pa.binary())], names=[*batch.schema.names, "sums"])

    return run


def _added(names: Sequence[str], replicates: int) -> Callable[[Batches], Batches]:
    """Rows and sums sorted by key to one row per key and replicate that drew any of its rows."""
    width = len(names)
    shape = (2 * width + 1, replicates)

    def rows(kind: pa.DataType, done: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
        hit = [np.flatnonzero(sums[-1] > 0) for _, sums in done]
        keys = pa.array([k for (k, _), h in zip(done, hit, strict=True) for _ in range(len(h))], kind)
        wide = np.concatenate([sums[:, h] for (_, sums), h in zip(done, hit, strict=True)], axis=1)
        columns = [keys, pa.array(np.concatenate(hit).astype(np.int32) + 1)]
        for v in range(width):
            n = wide[width + v].astype(np.int64)
            columns += [pa.array(wide[v], mask=n == 0), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "replicate", *[f"{p}_{x}" for x in names for p in ("s", "n")]])

    def run(batches: Batches) -> Batches:
        key, held, kind = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, summed = batch.column(0), batch.column(2 + width).is_valid().to_numpy(zero_copy_only=False)
            kind = keys.type
            starts = _starts(keys.dictionary_encode().indices.to_numpy())
            plain = batch.filter(pa.array(~summed))
            before = np.concatenate(([0], np.cumsum(~summed)))  # plain rows before a row
            total = _weigh(plain.columns[1 : 1 + width], unpack(plain.column(1 + width), replicates)) if plain.num_rows else None
            done = []
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                own = keys[int(a)].as_py()
                if held is not None and own != key:
                    done.append((key, held))
                    held = None
                key, held = own, np.zeros(shape) if held is None else held
                if before[b] > before[a]:
                    held = held + total(before[a], before[b])
                for at in np.flatnonzero(summed[a:b]) + a:
                    held = held + np.frombuffer(batch.column(2 + width)[int(at)].as_py()).reshape(shape)
            if done:
                yield rows(kind, done)
        if held is not None:
            yield rows(kind, [(key, held)])

    return run


def weighted_sums(located: DataFrame, key: str, values: Sequence[str], replicates: int) -> DataFrame:
    """Per key and replicate the sum (``s_``) and count (``n_``) of each value column ``v_``, each row as often as it was drawn.

    ``located``: key, ``v_`` columns (double), ``times``. A row travels once, with all its draws; a key with many rows in a batch is
    added up before. A key's rows come together in one task and are added batch by batch.
    """
    columns = [f"v_{v}" for v in values]
    rows = located.select(key, *columns, "times")
    kind = rows.schema[key].dataType.simpleString()
    wide = f"`{key}` {kind}, {', '.join(f'{c} double' for c in columns)}, times binary, sums binary"
    combined = rows.mapInArrow(_combined(len(columns), replicates), wide)
    spread = combined.repartition(key).sortWithinPartitions(key)
    shown = f"`key` {kind}, replicate int, " + ", ".join(f"s_{v} double, n_{v} bigint" for v in values)
    return spread.mapInArrow(_added(list(values), replicates), shown).withColumnRenamed("key", key)
