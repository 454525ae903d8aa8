"""Secret scans with multipart credential linking.

Strong findings stand alone. Weak candidates (user names, long keys, endpoints) are reported only where a complementary part
lies within ``scope`` code points of them. Only Spark's own functions run here; positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.llm.common import free_name, stored, text_key, text_or_empty

SCOPE = 300


@dataclass(frozen=True)
class Part:
    """One kind of finding. ``pattern`` is searched leftmost and non-overlapping; a match whose ``group`` is shorter than
    ``least``, or lacks one of ``needs``, is dropped. ``hint`` is a cheaper pattern that every text with a match
    fits, ``holds`` a string in it."""

    kind: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    hint: str | None = None
    holds: str | None = None
    weak: bool = False


# A maximal run of 32 or more is what the plain run pattern finds and a length test keeps, without a match per letter.
PARTS = (
    Part("assign", "secret", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Part("access", "identifier", r"AKIA[A-Z0-9]{12,}", holds="AKIA"),
    Part("hex", "secret", r"[0-9a-f]{32,}", hint=r"[0-9a-f]{32}"),
    Part("user", "identifier", r"""(?i:\b(user(?:_?name)?|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, weak=True),
    Part("key", "secret", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40, ("[0-9]", "[a-z]", "[A-Z]"), hint=r"[A-Za-z0-9+/]{40}", weak=True),
    Part("endpoint", "endpoint", r"(?i:(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://)[A-Za-z0-9._~:@/-]+", holds="://", weak=True),
)
BASE = [p.kind for p in PARTS if not p.weak]
#: For a weak part of each role, the roles one of which must be near.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of each of about sqrt(n) slices of a non-empty array, as an array."""
    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / size).cast("int")), lambda i: _let(F.slice(values, i * size + 1, size), body))


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each place of a non-empty int array what comes before it, combined. Done by blocks of about sqrt(n) places, as an
    array that grows is copied with each step; so a text may have any number of matches."""
    state = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("seen"))

    def scan(part: Column) -> Column:
        return F.aggregate(part, state, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")))

    def joined(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: b["at"]))["seen"]
        return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(b["seen"], lambda x: combine(o, x))))

    return _let(_blocks(values, scan), joined)


def _spans(text: Column, part: Part, number: int) -> Column:
    """array<struct<start, number, end>> of a part: the gaps between matches and the matches alternate, so lengths add up."""

    def good(value: Column) -> Column:
        fits = F.coalesce(F.length(value) >= part.least, F.lit(False))
        for need in part.needs:
            fits = fits & value.rlike(need)
        return fits

    lengths = F.zip_with(
        F.split(text, part.pattern),
        F.arrays_zip(F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(part.pattern), F.lit(part.group)).alias("value")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m["whole"]), F.lit(0)).alias("size"), good(m["value"]).alias("good")),
    )

    def placed(ls: Column) -> Column:
        before = _running(F.transform(ls, lambda x: x["gap"] + x["size"]), lambda a, x: a + x, 0)
        spans = F.zip_with(ls, before, lambda x, at: F.when(x["good"], F.struct((at + x["gap"]).alias("start"), F.lit(number).alias("number"), (at + x["gap"] + x["size"]).alias("end"))))
        return F.array_compact(spans)

    hint = text.contains(part.holds) if part.holds else text.rlike(part.hint or part.pattern)
    return F.when(hint, _let(lengths, placed)).otherwise(F.array().cast("array<struct<start:int,number:int,end:int>>"))


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed, then by end."""
    return F.sort_array(spans)


def candidates(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` and text_key, base and weak: arrays of struct<start, number, end>; number is the place in ``PARTS``."""
    names = [f"k{i}" for i in range(len(keep))]
    step = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], text_or_empty(text).alias("t"))
    found = [[_spans(F.col("t"), p, i) for i, p in enumerate(PARTS) if p.weak == weak] for weak in (False, True)]
    return step.select(*names, text_key(F.col("t")).alias("text_key"), _ordered(F.concat(*found[0])).alias("base"), _ordered(F.concat(*found[1])).alias("weak"))


def linked(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(text_key, more): the weak candidates that have a complementary part within ``scope``.

    ``texts``: text_key, base, weak, one row per text. This is an interval join of each weak part, widened by the scope, with
    the parts of the other roles. It runs as one sweep in order of starts: the furthest end before and the nearest start
    after tell whether any partner overlaps, so no pairs are made. A sweep holds the parts of one text.
    """
    roles = F.array(*[F.lit(p.role) for p in PARTS])
    weak = F.array(*[F.lit(p.weak) for p in PARTS])
    parts = texts.where(F.size("weak") > 0).select("text_key", F.explode(F.concat("base", "weak")).alias("p")).select("text_key", "p", F.get(roles, F.col("p.number")).alias("role"), F.get(weak, F.col("p.number")).alias("is_weak"))
    # what comes after is what came before in the opposite order: a frame up to the end would be summed up anew for each row
    before, after = (Window.partitionBy("text_key").orderBy(p).rowsBetween(Window.unboundedPreceding, -1) for p in (F.asc("p"), F.desc("p")))
    near = F.lit(False)
    for role, others in COMPLEMENTS.items():
        partner = F.col("role").isin(*others)
        last_end, next_start = F.max(F.when(partner, F.col("p.end"))).over(before), F.min(F.when(partner, F.col("p.start"))).over(after)
        close = F.coalesce(F.col("p.start") - last_end <= scope, F.lit(False)) | F.coalesce(next_start - F.col("p.end") <= scope, F.lit(False))
        near = near | ((F.col("role") == role) & close)
    return parts.withColumn("near", near).where("is_weak and near").groupBy("text_key").agg(F.collect_set("p").alias("more"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, text_key, base, spans (ordered arrays of struct<start, number, end>).

    ``spans`` holds the base spans and the linked weak ones. Null and empty texts have none; repeated rows get equal rows;
    equal texts are linked once, and only texts with a weak candidate go through the join. Other columns are not read.
    """
    found = stored(candidates(docs, text, [F.col(doc_id)]).withColumnRenamed("k0", "doc_id"), "secret-parts")
    some = found.where(F.size("weak") > 0)
    more = linked(some.groupBy("text_key").agg(F.first("base").alias("base"), F.first("weak").alias("weak")), scope).withColumnRenamed("text_key", "other")
    joined = some.join(more, F.col("text_key") == F.col("other"), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", "more")))
    return joined.select("doc_id", "text_key", "base", spans.alias("spans")).union(found.where(F.size("weak") == 0).select("doc_id", "text_key", "base", F.col("base").alias("spans")))


def span_list(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(p.kind) for p in PARTS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["number"] == number)).cast("long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE, length: str | None = "n_chars") -> DataFrame:
    """All documents and columns, each maximal run of found spans replaced by ``mark``; ``length`` follows the text."""
    found = scan(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), scope=scope).where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("spans"))
    key, own, spans = free_name(docs, "key"), free_name(docs, "own_key"), free_name(docs, "spans")
    found = found.select(F.col("text_key").alias(own), F.col("spans").alias(spans))
    out = docs.withColumn(key, text_key(text_or_empty(text))).join(found, F.col(key) == F.col(own), "left")

    def cleaned(found: Column, before: Column) -> Column:
        """The text between the runs, cut by blocks of runs: a place far into a text is found by counting from its start."""
        gaps = F.array_compact(F.zip_with(found, before, lambda s, at: F.when(s["start"] > at, F.struct(F.greatest(at, F.lit(0)).alias("from"), s["start"].alias("to")))))
        end = F.array_max(F.transform(found, lambda s: s["end"]))

        def cut(part: Column) -> Column:
            first = F.get(part, F.lit(0))["from"]
            some = F.substr(F.col(text), first + 1, F.get(part, F.size(part) - 1)["to"] - first)
            return _let(some, lambda x: F.array_join(F.transform(part, lambda g: F.substr(x, g["from"] - first + 1, g["to"] - g["from"])), mark))

        return F.concat(_let(gaps, lambda g: F.array_join(_blocks(g, cut), mark)), F.lit(mark), F.substr(F.col(text), end + 1))

    ends = F.transform(F.col(spans), lambda s: s["end"])
    clean = _let(F.struct(F.col(spans).alias("found"), _running(ends, F.greatest, -1).alias("before")), lambda x: cleaned(x["found"], x["before"]))
    none = F.col(spans).isNull()
    out = out.withColumn(text, F.when(none, F.col(text)).otherwise(clean))
    if length in docs.columns:
        out = out.withColumn(length, F.when(none, F.col(length)).otherwise(F.length(text).cast(docs.schema[length].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
