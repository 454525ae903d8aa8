"""Exact duplicates by radix tries: equal texts are found by their full bytes, never by a hash alone.

Each task first puts its own texts into a compressed radix (Patricia) trie, so that a text goes into the shuffle once per task
with the number of its copies and its best identifier. These go to partitions by length and content hash, where a second trie
joins the parts of each text. A trie that outgrows its memory hands over its heaviest subtree: before the shuffle as finished
parts, after it as texts that a further round takes up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgauge.llm.common import free_name, stored, text_or_empty

#: Bytes of a trie before the shuffle and after it.
LOCAL_BYTES, OWNER_BYTES = 32 << 20, 128 << 20
#: Bytes that a node takes beside its label.
NODE_BYTES = 300
BATCH_BYTES = 4 << 20
_PARTS = "row long, tid long, doc_id long, size long, length long, hash long, text binary"
_OWNERS = "tid long, keep_id long, keep_row long, size long, length long, hash long, sha string, text binary"


class Node:
    """An edge label and what ends behind it: ``held`` is None where no text ends, ``closed`` marks a subtree handed over."""

    __slots__ = ("closed", "held", "kids", "label")

    def __init__(self, label: bytes):
        self.label, self.kids, self.held, self.closed = label, {}, None, False

    def open_kids(self) -> int:
        return sum(not k.closed for k in self.kids.values())


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, which differ within the label."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Texts with what is held for each; ``bytes`` estimates its memory."""

    def __init__(self):
        self.root, self.bytes = Node(b""), NODE_BYTES

    def place(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made where it is new; or the closed node that ``text`` runs into."""
        node, at = self.root, 0
        while at < len(text) and not node.closed:
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.bytes += len(kid.label) + NODE_BYTES
                return kid
            if not text.startswith(kid.label, at):
                size = _common(kid.label, text, at)
                middle = node.kids[text[at]] = Node(kid.label[:size])
                kid.label = kid.label[size:]
                middle.kids[kid.label[0]] = kid
                self.bytes += NODE_BYTES
                kid = middle
            node, at = kid, at + len(kid.label)
        return node

    def texts(self, top: Node, before: bytes) -> Iterator[tuple[bytes, Node]]:
        """All texts below and at ``top``, whose label follows ``before``."""
        stack = [(top, before + top.label)]
        while stack:
            node, text = stack.pop()
            if node.held is not None:
                yield text, node
            stack += [(kid, text + kid.label) for kid in node.kids.values()]

    def heaviest(self) -> tuple[Node, Node, bytes]:
        """A parent, its heaviest child, and the text up to the parent: not over half of the trie, unless it is one label."""
        weight, order = {}, [self.root]
        for node in order:
            order += node.kids.values()
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE_BYTES + sum(weight[id(k)] for k in node.kids.values())
        node, before = self.root, b""
        while True:
            several = node.held is not None or node.open_kids() > 1
            kid = max((k for k in node.kids.values() if not k.closed), key=lambda k: weight[id(k)])
            if not kid.open_kids() or (several and 2 * weight[id(kid)] <= self.bytes):
                self.bytes -= weight[id(kid)]
                return node, kid, before
            node, before = kid, before + kid.label

    def branched(self) -> bool:
        """Whether more than one open text or branch is left, so that a subtree can go and something stays."""
        node = self.root
        while node.open_kids() == 1 and node.held is None:
            node = next(k for k in node.kids.values() if not k.closed)
        return node.open_kids() > 0

    def take(self) -> list[tuple[bytes, Node]]:
        """Remove the heaviest subtree; texts that it held may come again."""
        parent, kid, before = self.heaviest()
        del parent.kids[kid.label[0]]
        return list(self.texts(kid, before))

    def close(self) -> list[tuple[bytes, list]]:
        """Take the heaviest subtree and leave a closed node for all texts that go its way."""
        _, kid, before = self.heaviest()
        gone = [(text, node.held) for text, node in self.texts(kid, before)]
        kid.label, kid.kids, kid.held, kid.closed = kid.label[:1], {}, None, True
        self.bytes += NODE_BYTES
        return gone


class _Rows:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, *row, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes > BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _better(largest: bool):
    """Whether (id, row) a goes before b: by id, null last, then by the smaller row."""
    sign = -1 if largest else 1

    def order(doc_id: int | None, row: int) -> tuple:
        return (doc_id is None, sign * (doc_id or 0), row)

    return order


def _local(largest: bool, limit: int):
    """Of a stream of (doc_id, text): a row with row and tid for each document, and for each text of the task's trie one row that
    also has its best doc_id and row, its number of copies, length, hash and bytes. tid is the row of its first document."""
    order = _better(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = RadixTrie(), _Rows(_schema(_PARTS))
        row = TaskContext.get().partitionId() << 36

        def parts(found) -> Iterator[pa.RecordBatch]:
            for text, node in found:
                tid, size, best = node.held
                digest = xxhash.xxh64_intdigest(text)
                yield from out.add(best[1], tid, best[0], size, len(text), digest - (digest >> 63 << 64), text, size=len(text) + 64)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                node = trie.place(text.as_py())
                if node.held is None:
                    node.held = [row, 0, (doc_id, row)]
                held = node.held
                held[1] += 1
                if order(doc_id, row) < order(*held[2]):
                    held[2] = (doc_id, row)
                yield from out.add(row, held[0], doc_id, None, None, None, None)
                row += 1
                while trie.bytes > limit and trie.root.kids:
                    yield from parts(trie.take())
        yield from parts(trie.texts(trie.root, b""))
        yield from out.rest()

    return run


def _owned(largest: bool, limit: int):
    """Of a stream of parts: for each tid the best id and row of its text, the number of copies and the digest. Parts of texts in
    subtrees that were handed over come out as they came in, with their bytes."""
    order = _better(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = RadixTrie(), _Rows(_schema(_OWNERS))

        def later(text: bytes, part: tuple) -> Iterator[pa.RecordBatch]:
            tid, best, size, length, digest = part
            yield from out.add(tid, *best, size, length, digest, None, text, size=len(text) + 64)

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for row, tid, doc_id, size, length, digest, text in zip(*(c.to_pylist() for c in columns[:-1]), columns[-1], strict=True):
                text, part = text.as_py(), (tid, (doc_id, row), size, length, digest)
                node = trie.place(text)
                if node.closed:
                    yield from later(text, part)
                    continue
                node.held = node.held or []
                node.held.append(part)
                while trie.bytes > limit and trie.branched():  # something stays, so each round finishes texts in every task
                    for gone, held in trie.close():
                        for x in held:
                            yield from later(gone, x)
        for text, node in trie.texts(trie.root, b""):
            best = min((x[1] for x in node.held), key=lambda b: order(*b))
            copies, digest = sum(x[2] for x in node.held), hashlib.sha256(text).hexdigest()
            for x in node.held:
                yield from out.add(x[0], *best, copies, None, None, digest, None, size=150)
        yield from out.rest()

    return run


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", local_bytes: int = LOCAL_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id (of the row of its text that stays), group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest`` doc_id; null ids come after all others, and exactly one of the rows that share id
    and text is kept. A null text is an empty one. An empty table gives an empty one; other columns are not read. A text that
    most documents share is one part per task, so its partition stays small.
    """
    largest = keep == "largest"
    parts = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_local(largest, local_bytes), _PARTS), "trie-parts")
    todo, owners, turn = parts.where("text is not null"), None, 0
    while todo is not None:
        dealt = todo.repartition("length", "hash", *[F.lit(turn)] * (turn > 0)).select("row", "tid", "doc_id", "size", "length", "hash", "text")
        out = stored(dealt.mapInArrow(_owned(largest, owner_bytes), _OWNERS), "trie-owners")
        done = out.where("text is null").select(F.col("tid").alias("of"), "keep_id", "keep_row", F.col("size").alias("group_size"), F.col("sha").alias("text_sha256"))
        owners = done if owners is None else owners.union(done)
        left = out.where("text is not null")
        todo = None if left.isEmpty() else left.withColumnsRenamed({"keep_row": "row", "keep_id": "doc_id"})
        turn += 1
    members = parts.where("text is null").select("row", "tid", "doc_id")
    return members.join(owners, F.col("tid") == F.col("of")).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", **limits) -> DataFrame:
    """The documents that ``copies`` keeps, all columns. Of rows with the same id and text one stays."""
    kept = copies(docs, text, doc_id, keep, **limits).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    own = free_name(docs, "own_sha256")
    keyed = docs.withColumn(own, F.sha2(text_or_empty(text), 256))
    return keyed.join(kept, keyed[own].eqNullSafe(kept.text_sha256) & keyed[doc_id].eqNullSafe(kept.kept_id), "left_semi").dropDuplicates([own, doc_id]).drop(own)
