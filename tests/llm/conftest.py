import random

import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


WORDS = "alpha beta Gamma delta, eps'ilon zeta-eta don't we'll 42 3.14 über naïve 東京 x² \x1c tab\there".split(" ")


def texts(seed=0, n=40, words=60):
    """Random texts with exact copies, near copies, nulls, blanks, special strings and one long text."""
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) + r.choice(["", "", str(r.randint(0, 99))]) for _ in range(r.randint(1, words))) for _ in range(n)]
    near = out[3].split(" ")
    near[len(near) // 2 :][:1] = ["changed"]
    out += [out[3], out[3], " ".join(near), None, "", " \n\t ", "one", "a <|endoftext|> b<|endoftext|>", "line one\nline one\n\nline two  \n", " ".join(r.choice(WORDS) for _ in range(4000)), "é" * 300]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id with a null and a repeated identifier, and columns whose names clash with the operators' own."""
    rows = [(i * 3, t, "x", i, 0) for i, t in enumerate(texts())] + [(None, "lost document " * 20, "x", 1, 0), (0, texts()[0], "y", 2, 0), (6, "other text of a used identifier", "z", 3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rid string, block int, _line int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
