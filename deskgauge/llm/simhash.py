"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two fingerprints link when at most ``radius`` bits differ. ``2 ** (radius + 1) - 1`` masks are
made so that any ``radius`` bit positions are left out together by at least one of them: position ``i`` carries a non-zero
vector of ``radius + 1`` bits, mask ``v`` keeps the positions whose vector has an odd product with ``v``, and some ``v`` is
orthogonal to any ``radius`` vectors. Fingerprints that link therefore agree under some mask; no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgauge.llm.common import connected_components, free_name, stored, text_key, text_or_empty

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints of one bucket that are compared with each other; larger buckets are divided by further bits first.
MAX_BUCKET = 20_000
#: Times that large buckets are divided.
LEVELS = 3


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """64-bit hash of each run of ``shingle`` words, in order; fewer words are one shingle, none give an empty array."""
    words = data.lower().split()  # on bytes: A-Z only, and white space is 20 and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)


def _fingerprint(data: bytes, shingle: int) -> int:
    hashes = shingle_hashes(data, shingle)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """64-bit SimHash of a string column, as a signed long; null counts as empty, a text without words gives zero."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        values = (_fingerprint((x.as_py() or "").encode(), shingle) for x in texts)
        return pa.array(np.fromiter(values, np.uint64, len(texts)).view(np.int64))

    return of(text)


def covering_masks(radius: int) -> list[int]:
    """Unsigned masks, one per table; any ``radius`` positions are outside of at least one."""
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def divided_masks(masks: list[int], radius: int) -> list[int]:
    """For each mask, ``radius + 1`` masks that add one share of the other positions: one share is free of differences."""
    out = []
    for mask in masks:
        rest = [i for i in range(BITS) if not mask >> i & 1]
        out += [mask | sum(1 << i for i in rest[k :: radius + 1]) for k in range(radius + 1)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of a stream sorted by its first two, (tab, key), cut so that no bucket goes on in the next part."""
    held: list[tuple[np.ndarray, ...]] = []  # the last bucket may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held and new[0][-1] == held[0][0][0] and new[1][-1] == held[0][1][0] and new[0][0] == new[0][-1] and new[1][0] == new[1][-1]:
            held.append(new)
            continue
        both = tuple(np.concatenate(x) for x in zip(*held, new, strict=True))
        cut = np.flatnonzero((both[0] != both[0][-1]) | (both[1] != both[1][-1]))
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield tuple(x[:cut] for x in both)
        held = [tuple(x[cut:] for x in both)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _bucket_links(radius: int, limit: int | None):
    """Links of a stream of (tab, key, fp) sorted by (tab, key): in each bucket a spanning forest of its links.

    A bucket of over ``limit`` fingerprints is passed on whole (``hot``), to be divided.
    """
    names = ["tab", "a", "b", "hot"]

    def bucket(tab: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = fps
        while len(left) > 1:  # breadth first: each fingerprint is compared with those not yet reached
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    found = left[near]
                    yield np.full(len(found), x, np.uint64), found
                    front.extend(found)
                    left = left[~near]

    def rows(tabs: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], (tabs[1:] != tabs[:-1]) | (keys[1:] != keys[:-1]))))
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        parts = [(tabs[two], fps[two], fps[two + 1], np.zeros(len(two), bool))]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own = fps[s : s + n]
            if limit and n > limit:
                parts.append((tabs[s : s + n], own, own, np.ones(n, bool)))
            else:
                parts += [(np.full(len(a), tabs[s]), a, b, np.zeros(len(a), bool)) for a, b in bucket(tabs[s], own)]
        t, a, b, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(t):
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(hot)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tabs, keys, fps in whole_buckets(batches):
            yield from rows(tabs, keys, fps.view(np.uint64))

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all links within ``radius``.

    ``nodes``: distinct, non-null ``fingerprint`` longs. In a bucket only a spanning forest is returned, never all pairs.
    """
    masks = covering_masks(radius)
    rows = nodes.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)])).alias("t")).select(
        F.col("t.tab").alias("tab"), F.col("fingerprint").bitwiseAND(F.col("t.mask")).alias("key"), F.col("fingerprint").alias("fp")
    )
    found = None
    for level in range(LEVELS + 1):
        spread = rows.repartition("tab", "key").sortWithinPartitions("tab", "key")
        out = stored(spread.mapInArrow(_bucket_links(radius, max_bucket if level < LEVELS else None), "tab int, a long, b long, hot boolean"), "links")
        links = out.where("not hot").select("a", "b")
        found = links if found is None else found.union(links)
        hot = out.where("hot")
        if hot.isEmpty():
            break
        masks = divided_masks(masks, radius)
        shares = F.array(*[F.lit(_signed(m)) for m in masks])
        rows = hot.select(F.col("a").alias("fp"), F.explode(F.sequence(F.col("tab") * (radius + 1), F.col("tab") * (radius + 1) + radius)).alias("tab")).select(
            "tab", F.col("fp").bitwiseAND(F.element_at(shares, F.col("tab") + 1)).alias("key"), "fp"
        )
    return found.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, text_key, fingerprint (long), component_id, root (a fingerprint of its component).

    Equal fingerprints are one node, whatever the number of copies. Null and empty texts have fingerprint zero and link like
    any other. component_id is the smallest id reachable; null ids count only where a component has no other. Repeated rows
    stay; an empty table gives an empty one; other columns are not read.
    """
    hashed = stored(docs.select(F.col(doc_id).alias("doc_id"), text_key(text_or_empty(text)).alias("text_key"), fingerprint_column(F.col(text), shingle).alias("fingerprint")), "fingerprints")
    nodes = hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(nodes, radius, max_bucket))
    placed = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(least, "root").select(F.col("fingerprint").alias("fp"), "component_id", "root")
    return hashed.join(classes, F.col("fingerprint") == F.col("fp")).drop("fp")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Documents without near copies, all columns: of each component the row with the smallest id stays.

    Of equal ids the smallest text key stays, of rows with the same id and text one. Null ids come after all others.
    """
    return keep_first(docs, near_duplicates(docs, text, doc_id, radius, shingle, max_bucket), text, doc_id)


def keep_first(docs: DataFrame, classes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each ``root`` of ``classes`` (doc_id, text_key, root) the first document, all columns; see ``drop_near_duplicates``."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = stored(classes.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("kept_id"), F.col("best.text_key").alias("kept_key")), "kept")
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, text_key(text_or_empty(text)))
    return keyed.join(kept, keyed[doc_id].eqNullSafe(kept.kept_id) & (keyed[key] == kept.kept_key), "left_semi").dropDuplicates([doc_id, key]).drop(key)
