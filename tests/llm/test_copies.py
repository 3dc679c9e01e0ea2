"""Near copies, long repeated strings and shards against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockflow.llm import minhash, sharding, suffix_dedup


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, shingles(t), (t or "").lower().split()) for i, t in rows if i is not None]
    for n, (i, a, x) in enumerate(known):
        for j, b, y in known[:n]:
            if a and b and (x == y or sum((a & b).values()) >= 0.8 * sum((a | b).values())):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def test_registers_agree_like_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, size=300, dtype=np.uint64)
    a = rng.integers(1, 9, 300)
    b = np.where(rng.random(300) < 0.4, rng.integers(0, 9, 300), a)
    there = b > 0
    row = np.concatenate([np.zeros(300, int), np.ones(there.sum(), int)])
    signature = minhash.signatures(row, np.concatenate([h, h[there]]), np.concatenate([a, b[there]]), 2, 8000)
    assert abs((signature[0] == signature[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_classes(docs, corpus):
    expected = brute_classes(corpus)
    found = minhash.classes(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in corpus)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == expected
    assert all(r.class_id is None for r in found if r.doc_id is None)
    assert max(Counter(expected.values()).values()) > 5


def test_links_between_copies_that_no_leader_has(spark):
    """A family around a text: copies of copies, compared in several tiles."""
    rng = np.random.default_rng(2)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(120):
        words = (rows[rng.integers(len(rows))][1].split() if rows and rng.random() < 0.7 else base)[:]
        for _ in range(rng.integers(1, 4)):
            words[rng.integers(len(words))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    small, minhash.TILE = minhash.TILE, 32
    try:
        found = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        minhash.TILE = small
    assert found == brute_classes(rows)


def test_classes_of_an_empty_table(none):
    assert minhash.classes(none).count() == 0


def removed(rows):
    """(id, text) in order -> bytes that go, by place in the list."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        out.append((raw, gone))
    return out


@pytest.mark.parametrize("size", [3000, 1 << 20])
def test_long_strings(docs, corpus, size):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    expected = Counter()
    for (i, _), (raw, gone) in zip(rows, removed(rows)):
        turns = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        expected[i, len(raw), sum(gone), turns, hashlib.sha256(left).hexdigest()] += 1
    usual, suffix_dedup.BATCH_BYTES = suffix_dedup.BATCH_BYTES, size
    try:
        assert Counter(tuple(r) for r in suffix_dedup.deduplicate(docs, digest=True).collect()) == expected
        spans = suffix_dedup.deduplicate(docs).collect()
    finally:
        suffix_dedup.BATCH_BYTES = usual
    assert Counter((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in spans) == expected


def test_long_strings_of_an_empty_table(none):
    assert suffix_dedup.deduplicate(none).count() == 0


def test_levels_shrink_geometrically():
    rng, family, seen = np.random.default_rng(1), suffix_dedup.Family(), set()
    for _ in range(60):
        run = np.unique(rng.integers(0, 3000, rng.integers(0, 90)).astype(np.uint64))
        assert family.add(run).tolist() == [x in seen for x in run.tolist()]
        seen |= set(run.tolist())
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(map(len, family.levels)) == len(seen)


def test_shards(docs, corpus, monkeypatch):
    for top in (sharding.TOP, 16):  # at once, and by bundles
        monkeypatch.setattr(sharding, "TOP", top)
        monkeypatch.setattr(sharding, "BUCKET_GROUPS", 40)
        monkeypatch.setattr(sharding, "BUNDLES", 2)
        rows = sharding.shard(docs).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in corpus)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
        by_text = defaultdict(set)
        for r in rows:
            by_text[r.size, r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in by_text.values())
        if top > 100:  # with two bundles to a bucket nothing can be near equal
            total = Counter()
            for r in rows:
                total[r.shard] += r.size
            assert max(total.values()) - min(total.values()) <= 40


def test_differencing_is_tighter_than_the_largest_item():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 10_000, 2000).tolist()
    total = Counter()
    for size, part in zip(sizes, sharding.difference(sizes, 8)):
        total[part] += size
    assert max(total.values()) - min(total.values()) < 10
    assert sharding.difference([5], 3) in ([0], [1], [2]) and sharding.difference([], 3) == []


def test_shards_of_an_empty_table(none):
    assert sharding.shard(none).count() == 0


def test_a_huge_group_gets_a_shard_of_its_own(spark):
    rows = [(i, "same text, many times") for i in range(3000)] + [(3000 + i, "x" * (i % 50 + 1) + str(i)) for i in range(3000)]
    total = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        total[r.shard] += r.size
    others = sorted(total.values())[:-1]
    assert max(total.values()) == 3000 * 22 or others[-1] - others[0] < 100
