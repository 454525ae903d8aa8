"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Strings that are equal have the same
smallest gram hash, so every window of ``length`` bytes belongs to the shard group of its smallest hash; a text is cut into
runs of windows with one smallest hash. Groups met once are dropped, and each shard sorts the suffixes of its groups' pieces by
induced sorting and reads repeats off the permuted common prefixes. No two shards have to be merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgauge.llm.common import stored, text_key, text_or_empty
from deskgauge.llm.suffixes import permuted_prefixes, suffix_array

LENGTH, GRAM = 200, 64
#: Bytes of texts that are cut at a time, of pieces that make one suffix array, and of one group that are still sorted in
#: one array; the windows of a larger group are compared by 128-bit hashes across tasks instead.
CUT_BYTES, ARRAY_BYTES, GROUP_BYTES = 1 << 20, 2 << 20, 16 << 20
#: Distinct pieces that a task holds to combine equal ones before the shuffle.
HELD = 20_000

_MIX = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each place on; those past the end are cut off."""
    h, base, size = _MIX[data], _BASE, 1
    while size < gram:
        h = h[:-size] * base + h[size:]
        base, size = base * base, size * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def _runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest hash, of texts laid end to end: hash, text number, start in data, windows, again.

    ``again`` tells that the smallest hash may occur more than once in the run, so that it can hold a repeat by itself.
    """
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool))
    if len(data) < length:
        return empty
    with np.errstate(over="ignore"):
        h = _gram_hashes(data, gram)
    width = length - gram + 1
    least = _sliding_least(h, width)
    number = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    number = number[: len(least)]
    whole = np.arange(len(least)) + length <= ends[number]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (number[1:] != number[:-1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(least)))
    starts, sizes = starts[whole[starts]], sizes[whole[starts]]
    if not len(starts):
        return empty
    values = least[starts]
    # a run in which its own value stands twice may repeat itself: of the places with that value, in order, only the first two
    # from its start on are looked at, so many runs of one value cost no more than their number
    places = np.flatnonzero(np.isin(h, values, kind="sort")) if len(values) < 64 else np.flatnonzero(_is_some(h, values))
    known = np.unique(values)
    span = len(data) + 1
    order = np.sort(np.searchsorted(known, h[places]) * span + places)
    own = np.searchsorted(known, values)
    second = np.searchsorted(order, own * span + starts) + 1
    again = sizes > width
    inside = np.flatnonzero(second < len(order))
    value, place = np.divmod(order[second[inside]], span)
    again[inside] |= (value == own[inside]) & (place < starts[inside] + sizes[inside] + width - 1)
    return values, number[starts], starts, sizes, again


def _is_some(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each hash may be among the values: a table of 16 bits first, then the exact test of those that pass."""
    table = np.zeros(1 << 20, bool)
    table[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(table[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    out = np.zeros(len(h), bool)
    out[some] = np.isin(h[some], values)
    return out


def _cut(length: int, gram: int):
    """(key, hash, start, windows, again) of a stream of (key, text)."""

    def rows(keys: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        v, number, start, windows, again = _runs(np.frombuffer(b"".join(texts), np.uint8), ends, length, gram)
        begins = np.concatenate(([0], ends[:-1]))
        columns = [pa.array(keys, pa.binary()).take(pa.array(number)), pa.array(v.view(np.int64)), pa.array((start - begins[number]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(again)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "hash", "start", "windows", "again"])

    def blocks(key: bytes, data: bytes) -> Iterator[pa.RecordBatch]:
        """A very long text by blocks of windows; a run that goes on in the next block becomes two with one hash."""
        for at in range(0, len(data) - length + 1, CUT_BYTES):
            part = rows([key], [data[at : at + CUT_BYTES + length - 1]])
            yield part.set_column(2, "start", pa.array(part.column(2).to_numpy() + np.int32(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                data = t.as_py().encode()
                if len(data) > 2 * CUT_BYTES:
                    yield from blocks(k.as_py(), data)
                    continue
                keys.append(k.as_py())
                texts.append(data)
                size += len(data)
                if size >= CUT_BYTES:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows(keys, texts)

    return run


def _slices(length: int):
    """(hash, piece_id, key, start, windows, again, occurrence, piece) of texts with their pieces; a task gives the bytes of
    equal pieces once, as far as it holds them."""
    names = ["hash", "piece_id", "key", "start", "windows", "again", "occurrence", "piece"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for k, t, ps in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                key, data = k.as_py(), t.as_py().encode()
                for p in ps.as_py():
                    piece = data[p["start"] : p["start"] + p["windows"] + length - 1]
                    name = hashlib.blake2b(piece, digest_size=16).digest()
                    occurrence = xxhash.xxh64_intdigest(key + p["start"].to_bytes(8, "little")) - (1 << 63)
                    new = name not in seen
                    if new:
                        if len(seen) >= HELD:
                            seen.clear()
                        seen.add(name)
                    rows.append((p["hash"], name, key, p["start"], p["windows"], p["again"], occurrence, piece if new else None))
                    size += 100 + len(piece) * new
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _repeats_of(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows among distinct pieces: piece number, first and last window."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    text = np.ones(ends[-1] + 1, np.uint16)  # 1 stands after each piece, the only 0 at the end
    text[-1] = 0
    room = np.zeros(len(text), np.int64)
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    body[-1] = False
    text[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 2
    number = np.repeat(np.arange(len(pieces)), sizes + 1)
    room[:-1] = ends[number] - 1 - np.arange(len(number))
    before, prefix = permuted_prefixes(text, suffix_array(text), room)
    long = prefix >= length
    marked = np.zeros(len(text), bool)
    marked[long] = True
    marked[before[long]] = True
    at = np.flatnonzero(marked)
    if not len(at):
        return at, at, at
    firsts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
    lasts = np.append(firsts[1:], len(at)) - 1
    piece = number[at[firsts]]
    begin = ends[piece] - 1 - sizes[piece]
    return piece, at[firsts] - begin, at[lasts] - begin


_RUNS = pa.schema([("hash", pa.int64()), ("piece_id", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])


def _sort_shards(length: int, array_bytes: int):
    """(hash, piece_id, first, last) of a stream of (hash, piece_id, again, piece) sorted by hash and piece_id.

    Whole groups are gathered until an array's worth is there.
    """

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        number, first, last = _repeats_of([r[3] for r in rows], length)
        if len(number):
            columns = [pa.array([rows[i][0] for i in number], pa.int64()), pa.array([rows[i][1] for i in number], pa.binary()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        size, value, name = 0, None, None

        def close() -> int:
            if len(group) > 1 or group and group[0][2]:  # one piece that can't repeat itself needs no array
                ready.extend(group)
                return sum(len(r[3]) for r in group)
            return 0

        for batch in batches:
            for h, i, again, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if h != value:
                    size += close()
                    if size >= array_bytes:
                        yield from sort(ready)
                        ready, size = [], 0
                    group, value, name = [], h, None
                if i != name:  # else another task's copy of the piece
                    name = i
                    group.append((h, i, again, piece.as_py()))
        close()
        yield from sort(ready)

    return run


def _window_hashes(length: int):
    """(hash, piece_id, at, w1, w2): 128 bits of each window of a stream of (hash, piece_id, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, i, piece in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = piece.as_py()
                n = len(data) - length + 1
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)), np.int64).reshape(n, 2)
                columns = [pa.array([h.as_py()] * n, pa.int64()), pa.array([i.as_py()] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "piece_id", "at", "w1", "w2"])

    return run


def _cover(length: int):
    """(key, starts, ends, kept) of texts with their runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for k, t, rs in zip(part.column(0), part.column(1), part.column(2), strict=True):
                    data = t.as_py().encode()
                    starts, ends = [], []
                    for r in sorted((r["first"], r["last"] + length) for r in rs.as_py()):
                        if starts and r[0] <= ends[-1]:
                            ends[-1] = max(ends[-1], r[1])
                        else:
                            starts.append(r[0])
                            ends.append(r[1])
                    kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
                    out.append((k.as_py(), starts, ends, kept))
                columns = zip(*out, strict=True)
                types = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "starts", "ends", "kept"])

    return run


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, array_bytes: int = ARRAY_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, starts, ends, kept) for each distinct text that loses bytes: maximal runs of removed bytes, and the rest.

    ``key`` is the text's ``text_key``. A text that several rows share, of ``length`` bytes or more, goes whole. Copies are
    combined before any text moves, equal pieces of texts before they are sorted; a piece met in several places is repeated
    whole. Shorter texts, nulls and empty texts lose nothing.
    """
    own = docs.select(text_key(text_or_empty(text)).alias("key"), text_or_empty(text).alias("text")).where(F.octet_length("text") >= length)
    pieces = stored(own.mapInArrow(_cut(length, gram), "key binary, hash long, start int, windows int, again boolean"), "pieces")
    place = F.xxhash64("key", "start")
    shared = pieces.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("again").alias("again")).where("a <> b or again")
    shared = stored(shared.select("hash"), "shared-hashes")
    wanted = pieces.join(shared, "hash", "left_semi").groupBy("key").agg(F.collect_set(F.struct("hash", "start", "windows", "again")).alias("pieces"))
    texts = own.dropDuplicates(["key"])
    found = texts.join(wanted, "key").select("key", "text", "pieces")
    found = stored(found.mapInArrow(_slices(length), "hash long, piece_id binary, key binary, start int, windows int, again boolean, occurrence long, piece binary"), "places")
    shards = found.where("piece is not null").select("hash", "piece_id", "again", "piece")
    large = stored(shards.groupBy("hash").agg(F.sum(F.octet_length("piece")).alias("size")).where(F.col("size") > group_bytes).select("hash"), "large-groups")
    bounded = shards.join(large, "hash", "left_anti").repartition("hash").sortWithinPartitions("hash", "piece_id")
    runs = stored(bounded.mapInArrow(_sort_shards(length, array_bytes), "hash long, piece_id binary, first int, last int"), "runs")
    # a group that is large is spread over tasks by its pieces and meets again by window hashes
    spread = shards.join(large, "hash", "left_semi").dropDuplicates(["hash", "piece_id"]).select("hash", "piece_id", "piece")
    windows = stored(spread.mapInArrow(_window_hashes(length), "hash long, piece_id binary, at int, w1 long, w2 long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("w1").alias("x1"), F.col("w2").alias("x2"))
    matched = windows.join(twice, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))).select("hash", "piece_id", F.col("at").alias("first"), F.col("at").alias("last"))
    several = found.groupBy("hash", "piece_id").agg(F.min("occurrence").alias("a"), F.max("occurrence").alias("b"), F.min("windows").alias("n")).where("a <> b")
    whole = several.select("hash", "piece_id", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    repeated = runs.union(matched).union(whole)
    repeated = repeated.select(F.col("hash").alias("r_hash"), F.col("piece_id").alias("r_id"), "first", "last")
    placed = found.select("hash", "piece_id", "key", "start").join(repeated, (F.col("hash") == F.col("r_hash")) & (F.col("piece_id") == F.col("r_id")))
    parts = placed.select("key", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("run"))
    copied = own.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1").select("key", F.struct(F.lit(0).alias("first"), (F.col("size") - length).alias("last")).alias("run"))
    by_text = parts.union(copied).groupBy("key").agg(F.collect_set("run").alias("runs"))
    return texts.join(by_text, "key").select("key", "text", "runs").mapInArrow(_cover(length), "key binary, starts array<int>, ends array<int>, kept binary")


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; repeated rows lose all their bytes if they have ``length`` or more; other columns are not read.
    """
    cut = repeated_spans(docs, text, length, **options)
    total = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    cut = cut.select(F.col("key").alias("cut_key"), total.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    body = text_or_empty(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(body).alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("all_sha256"))
    out = rows.join(cut, F.col("key") == F.col("cut_key"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))
