import random

import pytest


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, repeats inside a text, odd characters, empty and null ones."""
    rng, words = random.Random(5), vocabulary(400)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(make(rng.randint(1, 40)) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passage = "\n".join(make(25) for _ in range(4))
    texts += [f"{make(12)}\n{passage}\n{make(9)}" for _ in range(8)] + [f"{make(5)} {passage}" for _ in range(3)]
    long = make(300)
    texts += [long, long, long.upper()]
    for _ in range(6):
        cut = long.split()
        cut[rng.randrange(300)] = "changed"
        texts.append(" ".join(cut))
    texts += [make(20) * 3, "a" * 400, "ab" * 300, " \t\n\x0b\x0c\r ", "", None, "Éé ß 漢字 😀 Wörter zwei\r\ndrei", "x", "one two three four"]
    texts += ["Title\n\n\nTitle\n", "# * $ % & | < >", "hey!! you!! there!!", "<|endoftext|>a  b \n <|endoftext|>"]
    return list(enumerate(texts)) + [(3, texts[3]), (4, "another text with the id of four"), (None, "no id " + passage), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "k", 1, [1]) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, hits array<int>").repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
