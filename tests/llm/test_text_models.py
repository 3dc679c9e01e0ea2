"""Tokens, toxicity, archives and the pipeline."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
import shutil
import sys
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from stockflow.llm import bpe, toxicity, warc
from stockflow.llm.queries import TOKENIZERS
from stockflow.session import shared_folder

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_tokens_as_the_library(spark, docs, corpus, library):
    rng = random.Random(2)
    letters = "abcdeioustnrl  '\n\t.,!0123éß漢😀​\xa0\x1c<|endoftext|>"
    hard = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    hard += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "a" * 70, " ", "a ", " a", "  a", "don't we'll I'M he'S", "\x00\x01", "x" * 5000]
    texts = [t or "" for _, t in corpus] + hard
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    for r in bpe.encode(rows, VOCABULARY).collect():
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.encode(rows, VOCABULARY, digests=True).collect():
        assert r.ids_sha256 == sha(",".join(map(str, want[r.doc_id]))) and r.decoded_sha256 == sha(texts[r.doc_id])
    assert bpe.encode(docs, VOCABULARY).count() == len(corpus)


def test_pair_checks_agree_with_merging(library):
    with open(VOCABULARY, encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 4000), rng.integers(0, 50256, 4000)
    words = [codec.bytes_of[x] + codec.bytes_of[y] for x, y in zip(a.tolist(), b.tolist())]
    exact = [m == [x, y] for m, x, y in zip(codec.merge(words), a.tolist(), b.tolist())]
    assert codec.compatible(a, b).tolist() == exact and 0 < sum(exact) < 4000
    assert codec.decode([0, 50256, 255]) == library.decode([0, 50256, 255], skip_special_tokens=False)


def test_new_words_cost_no_call_of_their_own():
    with open(VOCABULARY, encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    rng, calls = random.Random(3), [0]
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(4, 12)))
    texts = [" ".join(word() for _ in range(2000)) for _ in range(10)]

    def count(frame, event, arg):
        calls[0] += 1

    sys.setprofile(count)
    try:
        done = list(codec.encode(texts))
    finally:
        sys.setprofile(None)
    assert len(done) == 10 and calls[0] < 10_000  # 20,000 words, nearly all different


def test_words_are_cut_as_the_pattern_says():
    with open(VOCABULARY, encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    rng, pattern = random.Random(4), regex.compile(bpe.WORDS)
    letters = [*"'''   \n\t\xa0stmdrevlLS17.,!é漢😀", "'s", "'ve", "'ll", "\u3000", "\x85", "\x1c", "\u2014"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(5000)]
    want = [len(w.encode()) for t in texts for w in pattern.findall(t)]
    assert np.diff(codec.split(pa.array([t.encode() for t in texts], pa.large_binary()))).tolist() == want
    starts, bounds = codec.cut(pa.array(texts, pa.large_string()))
    stretches = np.split(np.frombuffer("".join(texts).encode(), np.uint8), starts[1:-1])
    assert [len(w.encode()) for s in stretches for w in pattern.findall(s.tobytes().decode())] == want and bounds[-1] == len(starts) - 1


def test_letters_that_the_library_does_not_know_yet(spark, library):
    texts = [f"a{c}1{c} {c}.{c}{c}b漢{c}漢 {c}a" for c in ("\u088f", "\U00011db6", "\U00016eb6", "\U00018db6", "\U000323b0", "\U0001df36")]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_tokens_of_an_empty_table(none):
    assert bpe.encode(none, VOCABULARY).count() == 0


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["zwoggle", "fnarkish", "quibblex"]
    rows, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        text = [rng.choice(bad) if toxic and rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(text), "src", 0))
        labels.append((i, toxic))
    rows += [(9001, None, "src", 0), (9002, "", "src", 0), (None, "no id", "src", 0), (3, "again three", "src", 0)]
    labels += [(5, None), (None, 1), (7, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, value string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_score_higher(told):
    docs, labels = told
    got = toxicity.score(docs, labels)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    held = got.filter("held_out").join(labels.filter("toxic in (0, 1)"), "doc_id").toPandas()
    assert len(held) > 100 and (held.predicted == held.toxic).mean() > 0.9


def test_held_out_labels_teach_nothing(told):
    docs, labels = told
    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: Counter((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(toxicity.score(docs, labels)) == key(toxicity.score(docs, flipped))


def test_scores_without_labels_or_rows(told, none):
    docs, labels = told
    assert toxicity.score(docs, labels.filter("toxic > 5")).filter("score is null").count() == 0
    assert toxicity.score(docs, labels.filter("toxic = 0")).filter("score is null").count() == 0
    assert toxicity.score(none, labels).count() == 0


def test_windows_are_the_highest_means():
    rng = np.random.default_rng(4)
    counts = [0, 1, 3, 4, 5, 0, 16, 17, 90]
    row, each = np.repeat(np.arange(len(counts)), counts), rng.normal(size=sum(counts))
    got = toxicity.highest(row, each, len(counts), (4, 16))
    for i in range(len(counts)):
        own = each[row == i]
        best = [max(own[j : j + w].mean() for j in range(max(len(own) - w, 0) + 1)) if len(own) else 0.0 for w in (4, 16)]
        assert abs(np.mean(best) - got[i]) < 1e-9


def spelled(word: bytes, order: int = 4) -> list[tuple]:
    """The letter n-grams of a word and its end, led in by zeros."""
    symbols = [0] * (order - 1) + toxicity.symbol_table()[np.frombuffer(word, np.uint8)].tolist() + [0]
    return [tuple(symbols[i : i + order]) for i in range(len(symbols) - order + 1)]


def test_values_as_by_hand(spark, told):
    """Scores before the curve against the formula written out over dicts, with every word joined and with none."""
    docs, labels = told
    docs = docs.filter("doc_id < 250 or doc_id > 9000 or doc_id is null")
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and r.doc_id is not None}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    split = lambda t: [w.encode() for w in re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower())]
    told_words = [Counter(w for i, t in rows if i is not None and label.get(i) == y and fold(i) > 1 for w in split(t)) for y in (1, 0)]
    every, d = set(told_words[0]) | set(told_words[1]), toxicity.DISCOUNT
    letters = [Counter(g for w in own for g in spelled(w)) for own in told_words]
    types = {4: set(letters[0]) | set(letters[1])}
    for n in (3, 2, 1):
        types[n] = {g[1:] for g in types[n + 1]}
    before = {n: Counter(g[1:] for g in types[n + 1]) for n in (1, 2, 3)}
    following = {n: Counter(g[:-1] for g in types[n]) for n in (1, 2, 3)}
    weight = {n: Counter() for n in (1, 2, 3)}
    for n in (1, 2, 3):
        for g, k in before[n].items():
            weight[n][g[:-1]] += k

    def shared(g):
        if not g:
            return 1 / toxicity.SYMBOLS
        n, h = len(g), g[:-1]
        return max(before[n][g] - d, 0) / weight[n][h] + d * following[n][h] / weight[n][h] * shared(g[1:])

    total = [Counter() for _ in letters]
    kinds = [Counter() for _ in letters]
    for y in (0, 1):
        for g, k in letters[y].items():
            total[y][g[:-1]] += k
            kinds[y][g[:-1]] += 1

    def spelling(w, y, ratio):
        value = 0.0
        for g in spelled(w):
            aside = d * kinds[y][g[:-1]] / total[y][g[:-1]] if total[y][g[:-1]] else 1.0
            seen = g in types[4]
            value += math.log(max(letters[y][g] - d, 0) / max(total[y][g[:-1]], 1) + aside * shared(g[1:]) if seen else aside)
        return value

    occurring = len(told_words[0]) + len(told_words[1])

    def value(w):
        logs = []
        for y, own in enumerate(told_words):
            aside = d * len(own) / own.total()
            if w in every:
                k = sum(w in o for o in told_words)
                backoff = max(k - d, 0) / occurring + d * len(every) / occurring * math.exp(spelling(w, y, False))
                logs.append(math.log(max(own[w] - d, 0) / own.total() + aside * backoff))
            else:
                logs.append(math.log(aside) + spelling(w, y, True))
        return (logs[0] - logs[1]) * min(1, toxicity.WORD_SYMBOLS / (len(w) + 1))

    want = {}
    for i, t in rows:
        own = [value(w) for w in split(t)]
        best = [max(np.mean(own[j : j + n]) for j in range(max(len(own) - n, 0) + 1)) if own else 0.0 for n in toxicity.WINDOWS]
        want[i, t] = np.mean(best)
    for frequent in (0, 40, toxicity.FREQUENT):
        got = sorted(r.value for r in toxicity.values(docs, labels, frequent=frequent).collect())
        assert np.allclose(got, sorted(want.values()), atol=1 / toxicity.UNIT)


def test_few_toxic_words_in_a_long_text_count(spark, told):
    docs, labels = told
    rng = random.Random(11)
    plain = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").limit(60).collect() if r.text]
    bad = [r.text for r in docs.join(labels.filter("toxic = 1"), "doc_id").limit(60).collect() if r.text]
    words = lambda pool: [w for t in pool for w in t.split()]
    long = [" ".join(rng.choice(words(plain)) for _ in range(3000)) for _ in range(8)]
    only_bad = [w for w in words(bad) if w not in set(words(plain))]
    mixed = [t[:9000] + " " + " ".join(rng.choice(only_bad) for _ in range(12)) + " " + t[9000:] for t in long]
    rows = [(20_000 + i, t) for i, t in enumerate(long + mixed)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in toxicity.score(more, labels).filter("doc_id >= 20000").collect()}
    assert all(got[20_008 + i] > got[20_000 + i] for i in range(8)) and min(got[20_008 + i] for i in range(8)) > 0.5


def test_backoff_is_a_distribution():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 32**3, 3000))
    assert toxicity.continuation(codes, 3).min() > 0
    model = toxicity.fit(codes, rng.integers(1, 9, len(codes)), rng.integers(1, 9, len(codes)), 3)
    assert np.isfinite(model.toxic).all() and np.isfinite(model.ordinary).all()


def test_words_and_their_hashes():
    texts = ["Ab ab\nAB", None, "", "  ", "é1 x", "ab", "y" * 70_000 + ".", "x"]
    found = toxicity.words(toxicity.pa.array(texts).slice(0), 4)
    text = [found.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    assert text == ["ab", "ab", "ab", "é1", "x", "ab", "y" * 70_000, "x"] and found.row.tolist() == [0, 0, 0, 4, 4, 5, 6, 7]
    assert len(set(found.key.tolist())) == len(set(text)) and found.size.tolist() == [len(t.encode()) + 1 for t in text]
    again = toxicity.words(toxicity.pa.array(texts).slice(4), 4)
    assert again.key.tolist() == found.key.tolist()[3:] and len(toxicity.words(toxicity.pa.array([], "string"), 4).key) == 0


def test_words_grow_with_the_corpus(told):
    docs, labels = told
    taught = docs.join(labels.filter("toxic in (0, 1)"), "doc_id").select("text", "toxic")
    counted = {r.word: (r.toxic, r.ordinary) for r in toxicity.count(taught).collect()}
    want = Counter((w.encode(), r.toxic) for r in taught.collect() if r.text for w in r.text.split())
    assert counted == {w: (want[w, 1], want[w, 0]) for w, _ in want}


PAGES = [
    (5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, "http://a/9\nx", "same"), (1, "http://a/1", "own é"), (3, None, None),
    (4, "http://a/4", ""), (7, "u", "x" * 300_000), (8, "u", "y" * 10), (8, "u", "y" * 10), (None, "u", "lost"), (1 << 40, "u", "far"),
]


def written(spark, **more):
    folder = shared_folder(spark, "archives")
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("_digest", F.lit(1)).repartition(3)
    manifest = warc.write(rows, folder, file_bytes=200, shard_bytes=2000, **more)
    return folder, manifest


def test_archives_round_trip(spark):
    folder, manifest = written(spark)
    got = warc.read(spark, folder).collect()
    first = {}
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(html or "", i)
    expected = Counter()
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        raw, origin = (html or "").encode(), first[html or ""]
        again = expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response", None] if i == origin else 1
        kind = ("revisit", origin) if again and origin is not None else ("response", None)
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == +expected
    assert {r.payload for r in got if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES) and manifest.count() > 3


def test_archives_are_the_same_bytes_in_every_run(spark):
    (a, first), (b, second) = written(spark), written(spark)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    path = lambda folder: urlparse(folder).path
    names = [json.loads(line)["file"] for line in open(f"{path(a)}/MANIFEST.json")]
    for name in names:
        one, two = (open(f"{path(f)}/{name}", "rb").read() for f in (a, b))
        assert one == two and gzip.decompress(one).startswith(b"WARC/1.1\r\n")


def test_every_file_of_the_manifest_is_read_and_counted(spark):
    folder, _ = written(spark)
    assert "GlobalLimit" not in (plan := warc.read(spark, folder)._jdf.queryExecution().toString()) and "hint" not in plan.lower()
    path = urlparse(folder).path
    files = [json.loads(line) for line in open(f"{path}/MANIFEST.json")]
    for wrong in ({**files[0], "records": files[0]["records"] + 1}, {**files[0], "file": "none.warc.gz"}):
        other = shared_folder(spark, "archives")
        shutil.copytree(path, urlparse(other).path)
        with open(f"{urlparse(other).path}/MANIFEST.json", "w") as out:
            out.writelines(json.dumps(f) + "\n" for f in [wrong, *files[1:]])
        with pytest.raises(Exception, match="an archive (of the manifest is missing|holds more or fewer)"):
            warc.read(spark, other).count()


def test_archives_of_an_empty_table(spark):
    folder = shared_folder(spark, "archives")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_only_long_payloads_are_revisited(spark):
    folder, _ = written(spark, least=5)
    assert warc.read(spark, folder).filter("record_type = 'revisit' and payload_bytes < 5").count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        where = shared_folder(spark, "stage")
        out.write.parquet(where)
        docs = spark.read.parquet(where)
        assert 0 < docs.count() <= known and docs.select("doc_id").distinct().count() == docs.count(), name
        known = docs.count()
    assert corpus_pipeline.run(spark, folder).count() == known


def test_queries_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
