"""Exact dedup, prefix trie and Merkle manifest against brute force."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stockflow.llm import exact_dedup, merkle, prefix_trie, warc


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact dedup

def expected_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    result = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            result[i, ids[0], len(ids), n == 0, sha(text)] += 1
    return result


COPIES = [(i, t) for i, t in enumerate(["a b", "a  b", "a\tb\x0b", "ab", " a b", "a b ", None, "", "  ", "x" * 200_000, "É b", "É b"] * 2)]
COPIES += [(3, "ab"), (3, "ab"), (None, "a b"), (None, "alone"), (None, "alone"), (-5, "É b")]


@pytest.mark.parametrize("most", [16384, 1])
def test_exact_copies(spark, docs, corpus, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", most)
    many = [(i, f"text {i % 40 if i % 3 else 'hot'} {i if i % 7 == 0 else ''}") for i in range(2000)]
    for rows in (corpus, COPIES, many):
        frame = spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "doc_id long, text string, keep_id int, _digest array<int>").repartition(5)
        marked = exact_dedup.mark(frame)
        assert marked.columns == ["doc_id", "text", "_digest", "keep_id", "group_size", "kept", "text_sha256"]
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in marked.collect())
        assert got == expected_groups(rows)
        left = exact_dedup.deduplicate(frame)
        assert left.columns == frame.columns and left.count() == len({k[4] for k in got})


def test_unique_texts_are_not_shuffled(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 18_000, F.col("id")).otherwise(F.col("id") % 10).cast("string").alias("text"))
    rows = frame.select(F.unhex(F.sha2("text", 256)).alias("_digest"), "doc_id")
    tested = exact_dedup.possibly_repeated(rows, 10).cache()
    assert tested.filter("doc_id >= 18000 or doc_id < 10").filter("not _again").count() == 0
    assert tested.filter("doc_id >= 10 and doc_id < 18000").filter("_again").count() < 18_000 * 0.03
    plan = tested._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("InMemoryTableScan")[0] and "Python" not in plan


def test_exact_copies_of_an_empty_table(none):
    assert exact_dedup.mark(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


# --- prefix trie

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    result = Counter()
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        totals[path] = (sum(totals[p][0] for p in below) or 1, saved + sum(totals[p][1] for p in below))
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        result[min(convs), len(path), parent, len(convs), len(children[path]), *totals[path], sha(ends)] += 1
    return result


def some_conversations(seed, convs, most, odd=True):
    rng = random.Random(seed)
    turns = ["yes", "no", "É漢😀", "", None, "long " * 30]
    rows = []
    for c in convs:
        path = [rng.choice(turns[: rng.randint(1, 6)]) for _ in range(rng.randint(1, most))]
        rows += [(c, i, rng.choice(["user", "user", "user", "assistant", None]) if odd else "user", t) for i, t in enumerate(path)]
    rng.shuffle(rows)
    return rows


def trie_of(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string").repartition(parts)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    built = prefix_trie.build(frame)
    assert built.columns == list(columns)
    return Counter(tuple(r) for r in built.collect())


def test_trie_of_odd_turns(spark):
    rows = some_conversations(1, [*range(0, 150), 205, 207, 299, 312, 1007, -5, -101, -100, -250], 7)
    rows += [(None, 1, "user", "nobody"), (7, None, "user", "first"), (7, None, "user", "first"), (7, 2, "user", "b"), (7, 2, "user", "a"), (7, 2, None, None)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_long_conversations_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "WIDTH", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = some_conversations(2, range(0, 130), 14, odd=False)
    long = [(n, "user", f"t{n % 5}") for n in range(100)]
    rows += [(200 + c, i, role, t if i < 60 + c else f"{t}{c % 3}") for c in range(9) for i, role, t in long[: 70 + 3 * c]]
    # one conversation under a third of the ids
    rows += [(1000 + c, i, "user", "same") for c in range(80) for i in range(6)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert not trie_of(spark, [])
    assert trie_of(spark, [(6, 0, "user", "a")]) == brute_trie([(6, 0, "user", "a")])


# --- Merkle manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    """Counter of (id, leaf, subroot, root, proof, folded from the tampered leaf)."""
    def grow(values):
        """Root, and per value its siblings: (left, right) per level."""
        proofs, places = [[] for _ in values], list(range(len(values)))
        while len(values) > 1:
            for i, p in enumerate(places):
                run = values[p // 16 * 16: p // 16 * 16 + 16]
                proofs[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1:])))
            values = [sha("".join(values[i:i + 16])) for i in range(0, len(values), 16)]
            places = [p // 16 for p in places]
        return values[0], proofs

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = defaultdict(list)
    for r in rows:
        seen = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            seen[4] = r[4].translate(low)
        trees[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), sha("".join(map(field, seen)))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for name in names:
        trees[name].sort()
        grown[name] = grow([t[2] for t in trees[name]])
    root, upper = grow([grown[n][0] for n in names])
    result = Counter()
    for name, up in zip(names, upper):
        for (some, i, own, seen), proof in zip(trees[name], grown[name][1]):
            value = seen
            for left, right in proof + up:
                value = sha(left + value + right)
            result[i if some else None, own, grown[name][0], root, sha("".join(a + b for a, b in proof + up)), value] += 1
    return result


def manifest_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    low = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in FIELDS]
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*low)).otherwise(merkle.leaf(*map(F.col, FIELDS)))
    proved = merkle.prove(frame.withColumns({"leaf": F.lit(1), "_tree": F.lit("x"), "root": F.lit(2)}), FIELDS, seen)
    return Counter((r._row.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in proved.collect())


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(4)
    sizes = {None: 3, "": 1, "one": 1, "Hot": 700, "sixteen": 16, "seventeen": 17, "É": 33, "full": 256, "over": 257, **{f"s{i}": 2 for i in range(14)}}
    ids = iter(rng.sample(range(-500, 5000), sum(sizes.values())))
    rows = [(next(ids), s, rng.choice(["en", None]), rng.choice([7, None]), rng.choice(["Ab É", "ab", None, ""])) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "one", None, None, None), rows[0], rows[50], rows[50], (rows[60][0], rows[60][1], "de", 1, "other")]
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_a_changed_leaf_is_found(spark):
    rows = [(i, "a", "en", 1, f"Text {i}") for i in range(40)]
    found = {r[0]: r[5] == r[3] for r in manifest_of(spark, rows)}
    assert found == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40)}


def test_manifest_of_an_empty_or_single_row(spark):
    assert not manifest_of(spark, [])
    one = [(1, None, "en", 1, "x" * 100_000)]
    assert manifest_of(spark, one) == brute_manifest(one)


def test_later_siblings_extend_open_witnesses():
    appender = merkle.Appender(fan=3)
    first, second = appender.append(b"a"), appender.append(b"b")
    assert (first.left, first.right, second.left) == (b"", b"b", b"a")
    appender.append(b"c")
    assert first.witness() == [(b"", b"bc")] or first.above is not None
    appender.append(b"d")
    root, level = appender.finish()
    value = merkle.digest(b"", b"a", b"bc")
    assert level == 2 and root == merkle.digest(value, merkle.digest(b"d"))
    assert first.witness() == [(b"", b"bc"), (b"", merkle.digest(b"d"))]


def test_edges_where_many_ranges_are_divided_again(spark):
    rng = random.Random(3)
    sizes = {i: rng.randint(1, 9) for i in range(20_000)} | {10**12 + i: 50 for i in range(300)} | {-(10**15): 5000}
    rows = spark.createDataFrame(list(sizes.items()), "id long, size long")
    low = warc.edges(rows, "id", "size", 2000)
    held = Counter()
    for key, size in sizes.items():
        held[bisect.bisect_right(low, key)] += size
    assert low == sorted(set(low)) and low[0] == min(sizes) and 0 not in held
    assert all(size <= 2000 or size == 5000 for size in held.values())
    assert len(held) < 2.5 * sum(sizes.values()) / 2000
    even = spark.range(5000).selectExpr("id", "100L size")
    assert len(warc.edges(even, "id", "size", 150)) == 5000 and len(warc.edges(even, "id", "size", 1000)) <= 1024
