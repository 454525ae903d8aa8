"""Quality rules: counts of each text, and boilerplate lines found by their frequency within a host.

Normalised lines are hashed together with their host inside their row, documents are counted per line, lines above the limit
are removed, and documents of which too little is left are rejected. Texts are split once. Only Spark's own functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgauge.llm.common import free_name, stored

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in more documents of its host than this number and this share of the host's documents.
MIN_DOCS, MIN_SHARE = 20, 0.02
#: Share of the words that must be left.
MIN_LEFT = 0.3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _line_hash(host: Column, words: Column) -> Column:
    """64 bits of a line within its host, without regard to case and white space. Two lines that share them only add up their
    counts, which matters for none that is rare."""
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull(), F.lower(F.array_join(words, " ")))


def _line_list(host: Column, lines: Column) -> Column:
    """array<struct<line, words>>: hash and number of words of each line."""
    return F.transform(F.transform(lines, _words), lambda w: F.struct(_line_hash(host, w).alias("line"), F.size(w).cast("long").alias("words")))


def text_counts(docs: DataFrame, text: Column, keep: list[Column], host: Column) -> DataFrame:
    """``keep``, lines (see ``_line_list``), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. A null text has
    no words.

    Repeated three-word windows are found inside the row: window hashes are sorted with their positions, equal neighbours are
    marked, and the marked positions cover up to three words each. No window leaves its row, so nothing is shuffled.
    """
    names = [f"k{i}" for i in range(len(keep))]
    kept = [c.alias(n) for c, n in zip(keep, names, strict=True)]
    step = docs.select(*kept, host.alias("host"), F.coalesce(text, F.lit("")).alias("t"))
    without = F.translate("t", WHITE, "")
    step = step.select(
        *names,
        _words(F.col("t")).alias("w"),
        F.length(without).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _lines(F.col("t")).alias("l"),
        "host",
    )
    names += ["word_chars", "n_symbols"]
    step = step.select(
        *names,
        _line_list(F.col("host"), F.col("l")).alias("lines"),
        F.size("w").cast("long").alias("n_words"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
    )
    names += ["lines", "n_words", "n_dup_lines"]
    step = step.select(*names, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, i: x.h.eqNullSafe(F.get("s", i)["h"])
    marked = F.filter("s", lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))
    step = step.select(*names, F.sort_array(F.transform(marked, lambda x: x.i)).alias("p"))
    step = step.select(
        *names,
        F.coalesce(F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # one struct per row, unpacked again: filters on the counts stay above it instead of repeating all steps inside themselves
    return step.select(F.inline(F.array(F.struct(*names, "n_repeat_words", failed.alias("base_failed")))))


def frequent_lines(counted: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(line): hashes of the lines that stand in more than ``min_docs`` documents of their host and in more than ``min_share`` of them.

    ``counted``: host and lines, one row per document; a document counts once for each of its lines, and copies of a text are
    documents of their own. Rows without a host are one host. Counts are pre-aggregated, so a line of most documents is no hot group.
    """
    limits = counted.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(min_share)).alias("most"))
    lines = counted.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    above = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    matched = above.withColumnRenamed("host", "own").join(limits, F.col("own").eqNullSafe(F.col("host")))
    return matched.where("docs > most").select(F.col("line").alias("bad"))


def _counted(docs: DataFrame, text: str, host: str, keep: list[Column]) -> DataFrame:
    """``text_counts`` written once, with the host and a number for each document: all later steps read it instead of the texts."""
    found = text_counts(docs, F.col(text), [F.col(host).cast("string"), *keep], F.col(host).cast("string")).withColumnRenamed("k0", "host")
    return stored(found.withColumn("number", F.monotonically_increasing_id()), "line-counts")


def _text_key(host: str, text: str) -> list[Column]:
    """128 bits of a host and a text; a null text is an empty one."""
    own, body = F.col(host).cast("string"), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.coalesce(own, F.lit("")), own.isNull(), body), F.xxhash64(F.lit(1), body, own.isNull(), F.coalesce(own, F.lit("")))]


def _removed(counted: DataFrame, **limits) -> DataFrame:
    """(of, cut, gone): for each document with lines above the limit the number of their words and their hashes."""
    lines = counted.select("number", F.inline("lines")).join(frequent_lines(counted, **limits), F.col("line") == F.col("bad"))
    return lines.groupBy(F.col("number").alias("of")).agg(F.sum("words").alias("cut"), F.collect_set("line").alias("gone"))


def _judgement(min_left: float) -> Column:
    return ~F.col("base_failed") & (F.col("n_words") - F.coalesce("cut", F.lit(0)) >= min_left * F.col("n_words"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """One row per document: doc_id, n_words, the counts of ``text_counts``, n_removed_words and kept.

    A document is kept if the base rules pass and ``min_left`` of its words stand in lines that stay. Null texts and texts
    without words fail; repeated rows are documents of their own; other columns are not read.
    """
    counted = _counted(docs, text, host, [F.col(doc_id)])
    out = counted.join(_removed(counted, **limits), F.col("number") == F.col("of"), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("k1").alias("doc_id"), *counts, F.coalesce("cut", F.lit(0)).alias("n_removed_words"), _judgement(min_left).alias("kept"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", min_left: float = MIN_LEFT, length: str | None = "n_chars", **limits) -> DataFrame:
    """The documents that ``judged`` keeps, all columns, without their lines above the limit; ``length`` follows the text."""
    # only counts and hashes are stored; texts are read again and meet their verdict by 128 bits of host and text
    counted = _counted(docs, text, host, _text_key(host, text))
    verdicts = counted.where("not base_failed").join(_removed(counted, **limits), F.col("number") == F.col("of"), "left").where(_judgement(min_left))
    names = [free_name(docs, n) for n in ("own_1", "own_2", "kept_1", "kept_2", "gone")]
    one, two, gone = F.col(names[0]), F.col(names[1]), F.col(names[4])
    verdicts = verdicts.dropDuplicates(["k1", "k2"]).select(F.col("k1").alias(names[2]), F.col("k2").alias(names[3]), F.col("gone").alias(names[4]))
    out = docs.withColumns(dict(zip(names[:2], _text_key(host, text), strict=True))).join(verdicts, (one == F.col(names[2])) & (two == F.col(names[3])))
    stay = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains(gone, _line_hash(F.col(host).cast("string"), _words(x)))), "\n")
    changed = gone.isNotNull()
    new = {text: F.when(changed, stay).otherwise(F.col(text))}
    if length in docs.columns:
        new[length] = F.when(changed, F.length(stay).cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
