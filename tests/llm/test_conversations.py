"""The prefix tree of conversations against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from deskgauge.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, depth int, prefix string, `a.b` string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {k: [t[3:] for t in sorted(v)] for k, v in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - (abs(conv) % 20) * (1 if conv >= 0 else -1), [])[:h] + turns[h:]
    return out


def plain_tree(conversations):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in conversations.items():
        ends[tuple(turns)].append(conv)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def same(spark, rows, **options):
    turns = spark.createDataFrame([(*r, 7, "p", "x") for r in rows], SCHEMA).repartition(5)
    got = c.prefix_tree(c.with_lent_beginnings(c.digested(turns)), **options).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_tree(rebuilt(rows)), key=key)


def some_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(-30, n):
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((conv, turn if rng.random() < 0.97 else None, rng.choice(["user", None]), rng.choice(["", None, "a b", "a  b", "c"])))
    return rows


@pytest.mark.parametrize("trie_turns", [c.TRIE_TURNS, 40])
def test_tree_equals_plain_one(spark, trie_turns):
    same(spark, some_rows(1, 300) + [(None, 1, "user", "no conversation")] + [(5, 2, "user", "tie")] * 3, trie_turns=trie_turns)


def test_one_conversation_that_most_repeat_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(c, "PIECE", 7)
    rows = [(conv, t, "user", f"word {t}") for conv in range(400) for t in range(4)]
    rows += [(1000, t, "user", str(t % 5)) for t in range(700)] + [(1001, t, "user", str(t % 5)) for t in range(650)]
    same(spark, rows)


def test_empty_table(spark):
    assert c.prefix_tree(c.with_lent_beginnings(c.digested(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_two_fattest():
    for high in range(1, 70):
        for low in range(high):
            want = max(range(low + 1, high + 1), key=lambda x: (x & -x).bit_length())
            assert c.two_fattest(low, high) == want


def test_trie_of_random_strings_finds_every_exit_node():
    rng = random.Random(2)
    for _ in range(150):
        trie, seen = c.ZFastTrie(), defaultdict(list)
        for conv in range(40):
            letters = [rng.choice("ab") for _ in range(rng.randint(0, 9))]
            keys = ["".join(letters[: i + 1]).encode() for i in range(len(letters))]
            seen[tuple(letters)].append(conv)
            node = trie.locate(keys)
            assert node.last <= len(keys) and (node.last == 0 or node.keys[-1] == keys[node.last - 1])
            kid = node.kids.get(keys[node.last]) if node.last < len(keys) else None
            assert kid is None or kid.last > len(keys) or kid.keys[-1] != keys[kid.last - 1]
            trie.add_batch([(conv, keys, [1] * len(keys))])
        for key, node in trie.table.items():
            assert node.handle() == key
        rows = {r[0]: (r[3], r[5], r[6]) for r in trie.expanded()}
        prefixes = {k[:d] for k in seen for d in range(len(k) + 1)}
        assert rows == {"".join(p).encode(): (len(p), sum(len(v) for k, v in seen.items() if k[: len(p)] == p), min(min(v) for k, v in seen.items() if k[: len(p)] == p)) for p in prefixes}
