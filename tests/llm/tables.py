"""Small tables with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, text_key int, fingerprint string, k0 int, words double, `a.b` string, identity int, root long, spans string"
EXTRA = ("x", 1, "y", 2, 0.5, "dotted", 3, 4, "z")
CLEAN = "Over the hills a quiet river winds past orchards, mills and meadows where larks rise at dawn. "


def prose(seed: int, words: int, letters: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(words))


def awkward() -> list[tuple]:
    base = prose(1, 120)
    texts = [
        (1, None, "en", "s0"),
        (2, "", "en", "s0"),
        (3, " \t\n\x0b", None, "s0"),
        (4, base, "en", None),
        (5, base, "en", "s0"),
        (5, base, "en", "s0"),
        (None, base.upper(), "de", "s1"),
        (None, None, None, None),
        (6, base + " tail", "en", "s1"),
        (7, "word " * 400, "en", "s1"),
        (8, prose(2, 20_000), "en", "s0"),
        (9, "one two", "en", "s0"),
        (10, "ä ö 한국어 \U0001f600 ![] #*$%&|<> <|endoftext|>ΑΣ it's 1234", "fr", "s1"),
        (11, "\n".join(["shared line of text here"] * 3 + [prose(3, 60)]), "en", "s0"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in texts]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def key(row):
    """Sorts rows with nulls."""
    return tuple((x is not None, x) for x in row)
