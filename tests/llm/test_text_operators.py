"""BPE, repeated strings, SimHash and quality scores against plain programs."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tables import CLEAN, EXTRA, awkward, documents, prose
from tokenizers import Tokenizer

from deskgauge.llm import bpe, common, minhash, quality, repeats, simhash, suffixes

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    own = bpe.load(PATH)
    rng = random.Random(4)
    texts = [t[1] or "" for t in awkward()] + ["a" * 3000, "aaa aaaa ababab mississippi", "ΑΣΣ ΣΑΣ İ ǅ x\x1cy\x85z", "<|startoftext|></w>a</w>b <|endoftext", "'s't're!!! ½ Ⅷ", "é ﬁ"]
    texts += ["".join(rng.choice("abcdeéthin 'sß中!?-1") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids, text
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_round_trip_and_columns(spark, library):
    rows = bpe.round_trip(documents(spark), PATH).collect()
    assert len(rows) == len(awkward())
    want = Counter()
    for i, text, *_ in awkward():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, rows)) == want
    columns = documents(spark).select("text", bpe.encode_column(F.col("text"), PATH).alias("ids")).select("*", bpe.decode_column(F.col("ids"), PATH).alias("back"))
    for row in columns.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.back == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(documents(spark, []), PATH).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(150):
        text = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 90)))
        text = np.append(np.tile(text[:9], 6) if trial % 3 == 0 else text, 0).astype(np.uint16)
        symbols = text.tolist()
        array = suffixes.suffix_array(text)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])
        room = np.arange(len(text))[::-1]
        before, prefix = suffixes.permuted_prefixes(text, array, room)
        for i, j in enumerate(before):
            n = 0
            while j >= 0 and n < min(room[i], room[j]) and symbols[i + n] == symbols[j + n]:
                n += 1
            assert prefix[i] == n


def without_repeats(texts: list[str | None], length: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out


def check_repeats(spark, rows, length, **options):
    got = Counter(map(tuple, repeats.removed(documents(spark, rows), length=length, **options).collect()))
    want = Counter((r[0], *w) for r, w in zip(rows, without_repeats([r[1] for r in rows], length), strict=True))
    assert got == want


def test_repeated_strings(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abc dé\n") for _ in range(2500))
    texts = [base, base[500:1200] + "x" + base[100:400], "ab" * 400, "ab" * 100, "z" * 199, "z" * 250, base[:260], base[:260], "x" + base[1000:1199], "y" + base[1000:1200], base[2000:2150] * 4]
    texts += [prose(i, 10) + base[700:1000] + prose(90 + i, 14) for i in range(30)]
    rows = [r for r in awkward() if r[0] != 8] + [(100 + i, t, "en", "s0", len(t), *awkward()[0][5:]) for i, t in enumerate(texts)]
    check_repeats(spark, rows, 200)
    check_repeats(spark, rows, 200, group_bytes=2000)  # large groups go by window hashes


def test_repeated_strings_of_one_text_and_none(spark):
    check_repeats(spark, [(1, "a" * 700, "en", "s", 700, *awkward()[0][5:])], 200)
    assert repeats.removed(documents(spark, [])).count() == 0


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: dict[int, int]) -> dict[int, int]:
    """Smallest id reachable of each fingerprint over links of at most four bits."""
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(values)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for f, i in values.items():
        r = find(f)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return {f: least[find(f)] for f in values}


@pytest.mark.parametrize("max_bucket", [20_000, 3])
def test_simhash_components(spark, max_bucket):
    rng = random.Random(8)
    rows = [r for r in awkward() if r[0] != 8]
    base = prose(5, 300).split()
    for i in range(60):
        words = base.copy()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), "en", "s0", 1, *rows[0][5:]))
    got = simhash.near_duplicates(documents(spark, rows), max_bucket=max_bucket).collect()
    values: dict[int, int | None] = {}
    for i, text, *_ in rows:
        f = fingerprint(text)
        values[f] = i if values.get(f) is None else values[f] if i is None else min(values[f], i)
    least = components(values)
    want = Counter((i, fingerprint(t), least[fingerprint(t)]) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == want


def test_masks_cover_every_pair():
    rng = random.Random(1)
    masks = simhash.covering_masks(4)
    finer = simhash.divided_masks(masks, 4)
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        free = [i for i, m in enumerate(masks) if not m & bits]
        assert free
        assert all(any(not finer[5 * i + k] & bits for k in range(5)) for i in free)


def test_one_document_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and {1, 4, 8, 9} <= set(ids) and not {2, 3, 5, 6, None} & set(ids)
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def shingles(text: str | None) -> frozenset[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_groups(rows) -> list[int]:
    """For each row the first row of its component over brute-force similarities of at least 0.8."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near_copies() -> list[tuple]:
    """Copies on both sides of 0.8, most of them further apart than 4 bits; a family of one text and a chain."""
    rng, rows = random.Random(12), awkward()
    rest = rows[0][5:]
    for group in range(40):
        base = prose(100 + group, rng.randint(50, 90)).split()
        for _ in range(2 if group else 40):
            words = base.copy()
            for _ in range(rng.randint(0, 2) if group else rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
            rows.append((1000 + len(rows), " ".join(words), "en", "s0", 1, *rest))
    chain = prose(99, 400).split()
    return rows + [(2000 + i, " ".join(chain[10 * i : 10 * i + 200]), "en", "s0", 1, *rest) for i in range(15)]


@pytest.mark.parametrize("small", [8, 2])
def test_near_copies_by_shingles(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "CENTERS", 1)
    rows = near_copies()
    groups = similar_groups(rows)
    got = minhash.similar_documents(documents(spark, rows)).collect()
    texts = {hashlib.sha256((t or "").encode()).digest()[:16]: g for (_, t, *_), g in zip(rows, groups, strict=True)}
    pairs = {(r.root, texts[bytes(r.text_key)]) for r in got}
    assert len(got) == len(rows) and len(pairs) == len({a for a, _ in pairs}) == len(set(groups))


def test_no_pair_at_the_wanted_similarity_is_ruled_out(spark):
    """Sets with 1 to 3,000 shingles and 0.8 of their union in common, beside sets with less; with parities of equal and different lengths."""
    rng = np.random.default_rng(3)
    rows, similar = [], []
    for common in [1, 2, 4, 9, 50, 400, 420, 500, 511, 512, 513, 850, 1000, 1024, 3000] * 3:
        fresh = rng.integers(0, 1 << 63, 2 * common, np.uint64)
        apart = common // 4 + (0 if len(rows) < 30 else 1 + common // 8)
        cut = common + rng.integers(0, apart + 1)
        one, two = fresh[:cut], np.append(fresh[:common], fresh[cut : common + apart])
        similar.append(5 * common >= 4 * (common + apart))
        rows.append([(len(x), [int(w) for w in minhash.parities(x)]) for x in (one, two)])
    assert sum(similar) == 30 and any(len(a[1]) != len(b[1]) for a, b in rows[:30])
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(rows)], "i int, n int, bits array<bigint>, other_n int, other_bits array<bigint>")
    fits = {r.i for r in df.where(minhash._may_be_similar(80)).collect()}
    assert {i for i, s in enumerate(similar) if s} <= fits

    def pairs(some: list) -> int:
        columns = [[0] * 2, [7] * 2, [1, 2], [n for n, _ in some], [b for _, b in some], [[7] + [i] * 63 for i in (1, 2)], [1, 2]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tab", "key", "node", "n", "bits", "keys", "root"])
        return sum(b.num_rows for b in minhash._bucket_pairs(80, None)(iter([batch])))

    assert fits == {i for i, some in enumerate(rows) if pairs(some)}
    loose = rng.integers(0, 1 << 63, 900, np.uint64)
    apart = [(600, [int(w) for w in minhash.parities(loose[a : a + 600])]) for a in (0, 300)]
    assert not pairs(apart)


def test_loosely_similar_texts_make_few_candidates(spark, monkeypatch):
    """2,000 texts that share about 0.5 to 0.7 of their shingles with each other, and none 0.8."""
    rng = random.Random(5)
    base = prose(1, 300).split()
    rows = []
    for i in range(2000):
        words = base.copy()
        for at in rng.sample(range(300), rng.randint(7, 10)):
            words[at] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s0", 1, *EXTRA))
    made = Counter()

    def counted(df, name):
        out = common.stored(df, name)
        if name == "candidates":
            made[name] += out.count()
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    found = minhash.similar_documents(documents(spark, rows))
    assert made["candidates"] < 20 * 2000, made
    sets = [shingles(r[1]) for r in rows[:60]]
    similar = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.4 < min(similar) and sum(0.5 < x < 0.7 for x in similar) > 0.9 * len(similar)
    assert found.select("root").distinct().count() > 1900


def test_pipeline_drops_near_copies(spark):
    rows = near_copies()
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert kept.columns == documents(spark).columns
    least: dict[int, tuple] = {}
    for (i, *_), g in zip(rows, similar_groups(rows), strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in least.values())
    assert corpus_pipeline.near_duplicates(spark, documents(spark, []), "").count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (-5, 7)]
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == -5 for i in range(41)) and all(found[i] == 100 for i in range(100, 160))


def quality_tables(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        text = prose(i, rng.randint(30, 90), "aeiounrst") if good else "BUY!! NOW!! " * rng.randint(10, 40)
        rows.append((i, text, "en", "s", len(text), *awkward()[0][5:]))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_scores_on_held_out_labels(spark):
    rows, labels = quality_tables(spark)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in quality.classified(documents(spark, rows), known).collect()}
    assert len(scored) == len(rows)
    for i in scored:
        assert scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= scored[i].score <= 1
        assert scored[i].predicted == (scored[i].score >= 0.5)
    held = [(scored[i].predicted, q) for i, q, _ in labels if scored[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    # labels of held-out rows have no influence
    other = spark.createDataFrame([(i, 1 - q if scored[i].held_out else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in quality.classified(documents(spark, rows), other).collect()} == {i: r.score for i, r in scored.items()}


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 1, 0), (None, 0, None), (7, 0, 0), (8, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classified(documents(spark), labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    nobody = quality.classified(documents(spark), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in nobody} == {(0.5, 1)}
    assert quality.classified(documents(spark, []), labels).count() == 0
    assert CLEAN.strip()


def test_runs_of_one_long_text_take_linear_memory():
    """A line that stands 90,000 times between random letters: each run looks at two places, not at all of its twins."""
    rng = np.random.default_rng(3)
    line = prose(7, 40)[:134].encode()
    parts = rng.integers(97, 123, (90_000, 90), np.uint8)
    data = b"".join(p.tobytes() + line for p in parts)
    assert len(data) > 20_000_000
    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats._cut(200, 64)(iter([pa.RecordBatch.from_pydict({"key": [b"k"], "text": [data.decode()]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 90_000 and peak < 1 << 30


def test_runs_are_those_of_a_plain_scan():
    rng = random.Random(9)
    for trial in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))).encode() * rng.choice([1, 3]) for _ in range(4)]
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        v, number, start, windows, again = repeats._runs(data, ends, 20, 8)
        covered = Counter()
        for i, (value, n, at, w) in enumerate(zip(v, number, start, windows, strict=True)):
            base = at - (ends[n - 1] if n else 0)
            covered.update((n, base + k) for k in range(w))
            with np.errstate(over="ignore"):
                grams = repeats._gram_hashes(data[at : at + w + 19], 8)
            assert again[i] == (w > 13 or (grams == value).sum() > 1)
            assert all(grams[k : k + 13].min() == value for k in range(w))
        assert covered == Counter((n, k) for n, t in enumerate(texts) for k in range(len(t) - 19))


def test_repeated_strings_of_a_text_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CUT_BYTES", 700)
    base = prose(4, 500)
    rows = [(1, base, "en", "s", 1, *EXTRA), (2, prose(5, 50) + base[300:2200] + prose(6, 50), "en", "s", 1, *EXTRA), (3, base[:1500] * 2, "en", "s", 1, *EXTRA)]
    check_repeats(spark, rows, 200)
