"""Exact duplicates against a dictionary, for tries of any size."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from tables import EXTRA, awkward, documents

from deskgauge.llm import tries


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if largest else min(known)) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: i != best)):
            out[i, best, len(ids), n == 0, sha] += 1
    return out


def some_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    base += ["shared head " * 20 + x for x in base[:50]] + ["x" * 100_000, "x" * 100_001]
    return [(rng.choice([None, n, n, n, n // 3]), rng.choice(base)) for n in range(1200)] + [(5000 + n, "hot copy") for n in range(600)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("size", [1 << 25, 30_000])
def test_copies_equal_brute_force(spark, keep, size):
    rows = some_texts(3) + [(r[0], r[1]) for r in awkward()]
    docs = documents(spark, [(i, t, "en", "s", 1, *EXTRA) for i, t in rows])
    got = Counter(map(tuple, tries.copies(docs, keep=keep, local_bytes=size, owner_bytes=2 * size).collect()))
    assert got == brute(rows, keep == "largest")


def test_one_branch_from_the_root_is_divided_too(spark):
    rows = [(n, "same start " + t) for n, (_, t) in enumerate(some_texts(5)[:600])]
    got = Counter(map(tuple, tries.copies(documents(spark, [(i, t, "en", "s", 1, *EXTRA) for i, t in rows]), local_bytes=20_000, owner_bytes=20_000).collect()))
    assert got == brute(rows, False)


def test_one_of_each_stays_with_all_columns(spark):
    docs = documents(spark)
    kept = tries.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t[1] or "" for t in awkward()})
    assert tries.drop_copies(docs, keep="largest").where("doc_id = 5").count() == 1
    assert tries.copies(documents(spark, [])).count() == 0


def test_trie_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        trie, want = tries.RadixTrie(), Counter()
        for _ in range(60):
            text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
            node = trie.place(text)
            node.held = (node.held or 0) + 1
            want[text] += 1
            if rng.random() < 0.1 and trie.root.kids:
                for gone, at in trie.take():
                    assert want.pop(gone) == at.held
        assert Counter({t: n.held for t, n in trie.texts(trie.root, b"")}) == want
