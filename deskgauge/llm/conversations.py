"""Prefix tree of conversations, built with z-fast tries.

A conversation is a string of turns. Each turn is one digest, and a chained hash stands for each prefix. Every task builds a
z-fast trie of its conversations: a compacted trie whose nodes are found in a table by their handle, the prefix whose length
is the two-fattest number of the node's edge, so a binary search over prefix lengths finds where a conversation leaves the
trie. The edges are then expanded to one row per prefix, and Spark adds the rows of all tasks up by prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.llm.common import stored

WORD = r"[\x20\x09-\x0D]+"
#: Turns that a task's trie holds before its rows are handed over and a new trie begins.
TRIE_TURNS = 500_000
#: Conversations that are looked up together before any of them is inserted.
BATCH = 1_000
#: Identifiers that one piece of a list of ends holds.
PIECE = 50_000
ROOT = b""
_ROWS = "prefix binary, parent binary, ups array<binary>, depth long, words long, n long, conv_id long, ends boolean"
_ROW_SCHEMA = pa.schema(
    [("prefix", pa.binary()), ("parent", pa.binary()), ("ups", pa.list_(pa.binary())), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.bool_())]
)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & -1 << (low ^ high).bit_length() - 1


class Node:
    """``first`` < depths of its edge <= ``last``; ``keys`` and ``words`` hold one entry for each depth of the edge."""

    __slots__ = ("first", "keys", "kids", "last", "least", "n", "up", "words")

    def __init__(self, first: int, keys: list[bytes], words: list[int], up: Node | None):
        self.first, self.keys, self.words, self.up = first, keys, words, up
        self.last, self.kids, self.n, self.least = first + len(keys), {}, 0, None

    def handle(self) -> bytes:
        return self.keys[two_fattest(self.first, self.last) - self.first - 1]


class ZFastTrie:
    """A compacted trie over chained prefix hashes, with a table from handles to nodes."""

    def __init__(self):
        self.root = Node(0, [], [], None)
        self.table: dict[bytes, Node] = {}
        self.turns = 0

    def locate(self, keys: list[bytes]) -> Node:
        """The deepest node whose whole string is a prefix of ``keys``, by fat binary search over the handles."""
        node, low, high = self.root, 0, len(keys)
        while low < high:
            fat = two_fattest(low, high)
            found = self.table.get(keys[fat - 1])
            if found is None:
                high = fat - 1
            elif found.last <= len(keys) and keys[found.last - 1] == found.keys[-1]:
                node, low = found, found.last
            else:  # the string leaves within this edge, above which is the node looked for
                return found.up
        return node

    def _leaf(self, node: Node, keys: list[bytes], words: list[int]) -> Node:
        leaf = Node(node.last, keys[node.last :], words[node.last :], node)
        node.kids[leaf.keys[0]] = leaf
        self.table[leaf.handle()] = leaf
        self.turns += len(leaf.keys)
        return leaf

    def _split(self, kid: Node, size: int) -> Node:
        """Cut the edge of ``kid`` after ``size`` turns; both parts get the handles of their new edges."""
        self.table.pop(kid.handle())
        top = Node(kid.first, kid.keys[:size], kid.words[:size], kid.up)
        kid.up.kids[top.keys[0]] = top
        kid.first, kid.keys, kid.words, kid.up = top.last, kid.keys[size:], kid.words[size:], top
        top.kids[kid.keys[0]] = kid
        self.table[top.handle()] = top
        self.table[kid.handle()] = kid
        return top

    def insert(self, start: Node, keys: list[bytes], words: list[int], conv_id: int) -> None:
        """Add a conversation below ``start``, a node on its path (its exit node, unless the same batch has grown the trie)."""
        node = start
        while node.last < len(keys):
            kid = node.kids.get(keys[node.last])
            if kid is None:
                node = self._leaf(node, keys, words)
                break
            low, high = 1, min(len(kid.keys), len(keys) - node.last)
            while low < high:  # chained hashes: equal at some depth means equal up to it
                middle = (low + high + 1) // 2
                low, high = (middle, high) if kid.keys[middle - 1] == keys[node.last + middle - 1] else (low, middle - 1)
            node = kid if low == len(kid.keys) else self._split(kid, low)
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)

    def add_batch(self, batch: list[tuple[int, list[bytes], list[int]]]) -> None:
        found = [self.locate(keys) for _, keys, _ in batch]
        for node, (conv_id, keys, words) in sorted(zip(found, batch, strict=True), key=lambda x: (id(x[0]), x[1][1][x[0].last :][:1])):
            self.insert(node, keys, words, conv_id)

    def expanded(self) -> Iterator[tuple]:
        """A row of ``_ROWS`` for each prefix, with the number and smallest id of its conversations."""
        order = [self.root]
        for node in order:
            order += node.kids.values()
        for node in reversed(order):
            for kid in node.kids.values():
                node.n += kid.n
                node.least = kid.least if node.least is None else min(node.least, kid.least)
        path: list[bytes] = []
        yield ROOT, None, [], 0, 0, self.root.n, self.root.least, False
        stack = list(self.root.kids.values())
        while stack:
            node = stack.pop()
            del path[node.first :]
            for key, words in zip(node.keys, node.words, strict=True):
                depth = len(path) + 1
                ups = [path[depth - step - 1] if depth > step else ROOT for step in (1 << i for i in range(depth.bit_length())) if step <= depth]
                path.append(key)
                yield key, ups[0], ups, depth, words, node.n, node.least, False
            stack += node.kids.values()


def _expand(limit: int):
    """Rows of the prefixes of each task's conversations, and a row (prefix, conv_id) for where each of them ends.

    The stream has (conv_id, depth, digest, words), sorted by conv_id and depth; depth 0 stands for the conversation itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, waiting, out = ZFastTrie(), [], []
        conv_id, keys, words = None, [], []

        def record() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ROW_SCHEMA, strict=True)], schema=_ROW_SCHEMA)
            out.clear()
            return made

        def handed_over() -> Iterator[pa.RecordBatch]:
            trie.add_batch(waiting)
            waiting.clear()
            for row in trie.expanded() if trie.root.n or trie.root.kids else ():
                out.append(row)
                if len(out) >= 20_000:
                    yield record()

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal trie
            waiting.append((conv_id, keys, words))
            out.append((keys[-1] if keys else ROOT, None, [], None, None, None, conv_id, True))
            if len(out) >= 20_000:
                yield record()
            if len(waiting) >= BATCH:
                trie.add_batch(waiting)
                waiting.clear()
            if trie.turns + sum(len(x[1]) for x in waiting[-1:]) > limit:
                yield from handed_over()
                trie = ZFastTrie()

        for batch in batches:
            for own, depth, digest, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != conv_id:
                    if conv_id is not None:
                        yield from ended()
                    conv_id, keys, words = own, [], []
                if depth:
                    keys.append(hashlib.blake2b((keys[-1] if keys else ROOT) + digest, digest_size=16).digest())
                    words.append(count)
        if conv_id is not None:
            yield from ended()
        yield from handed_over()
        if out:
            yield record()

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream of (prefix, conv_id) in order: (prefix, first conv_id, ids joined by commas) for runs of up to ``PIECE`` ids."""
    held: list[int] = []
    last = None

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"prefix": pa.array([last], pa.binary()), "first": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held))]})

    for batch in batches:
        for prefix, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (prefix != last or len(held) >= PIECE):
                yield piece()
                held = []
            last = prefix
            held.append(conv_id)
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream of (prefix, ids) in order: (prefix, SHA-256 of all its ids joined by commas), one piece at a time."""
    last, state = None, None
    for batch in batches:
        prefixes, digests = [], []
        for prefix, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is not None and prefix == last:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                prefixes.append(last)
                digests.append(state.hexdigest())
            last, state = prefix, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"at": pa.array(prefixes, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"at": pa.array([last], pa.binary()), "ends_sha256": [state.hexdigest()]})


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """128 bits of a turn's role and text; null is empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    return F.unhex(F.md5(F.concat(F.length(parts[0]).cast("string"), F.lit(":"), *parts)))


def digested(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, digest, words) of each turn; ``depth`` counts the turns of a conversation from 1 in order of ``turn``.

    A null turn comes first; equal turns are ordered by their digest. Rows without a conv_id belong to no conversation and are
    left out. Texts don't leave their row, only 16 bytes of each do.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD), lambda w: w != "")).cast("long")
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_digest(role, text).alias("digest"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), "digest", "words")


def with_lent_beginnings(own: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Conversations of ``digested`` rebuilt: the first h turns of conversation c - c % family, then the own turns after the first h,
    where h is CRC-32 of c in decimal modulo ``most`` + 1. A conversation left without turns keeps its row of depth 0."""
    lent = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    ids = own.where("depth = 1").select("conv_id", lent.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    starts = own.where(F.col("depth") <= most).select(F.col("conv_id").alias("of"), "depth", "digest", "words")
    begun = ids.join(starts, (F.col("base") == F.col("of")) & (F.col("depth") <= F.col("h"))).select("conv_id", F.lit(0).alias("part"), "depth", "digest", "words")
    rest = own.where(F.col("depth") > lent).select("conv_id", F.lit(1).alias("part"), "depth", "digest", "words")
    marks = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return marks.union(begun).union(rest).repartition("conv_id").sortWithinPartitions("conv_id", "part", "depth").select("conv_id", (F.col("part") + F.col("depth")).alias("depth"), "digest", "words")


def prefix_tree(turns: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """One row per distinct beginning of the conversations, the empty one included: conv_id (smallest of its members), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv_id, depth, digest, words), each conversation's rows together and in order; rows of depth 0 only name it.
    An empty table gives no rows. The digests of one conversation are held by one task, those of a task up to ``trie_turns``.
    Rows of prefixes are added up before the shuffle, so a beginning that most conversations share is one row per task. Sums over
    subtrees take as many rounds as the depth has bits: each adds what stands 1, 2, 4, ... levels below.
    """
    rows = stored(turns.mapInArrow(_expand(trie_turns), _ROWS), "trie-rows")
    merged = rows.where("not ends").groupBy("prefix").agg(F.min("parent").alias("parent"), F.max("ups").alias("ups"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stored(merged, "trie-nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    state = nodes.join(kids, F.col("prefix") == F.col("of"), "left").select(
        "prefix", "parent", "ups", "depth", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for step in range(deepest.bit_length()):
        below = state.where(F.size("ups") > step).groupBy(F.get("ups", F.lit(step)).alias("of")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
        state = stored(
            state.join(below, F.col("prefix") == F.col("of"), "left").select(
                "prefix", "parent", "ups", "depth", "n_convs", "conv_id", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens")
            ),
            "trie-sums",
        )
    listed = rows.where("ends").select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    pieces = listed.mapInArrow(_pieces, "prefix binary, first long, ids string")
    ends = pieces.repartition("prefix").sortWithinPartitions("prefix", "first").select("prefix", "ids").mapInArrow(_digests, "at binary, ends_sha256 string")
    parents = state.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = state.join(ends, F.col("prefix") == F.col("at"), "left").join(parents, F.col("parent") == F.col("above"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
