import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHING = ("d", "t", "h", "c", "p", "n", "key", "size", "words", "label", "id", "ids", "hashes", "bucket", "shard", "slot", "host", "token", "d_id", "d_key", "i_id", "s", "k1", "_key", "_d", "_terms")


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, blanks, ties, copies, near copies and one long text."""
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "one", "one two three", "x" * 3000]
    base = [words_of(rng, rng.randint(20, 160)) for _ in range(30)]
    texts += base + base[:4] + base[:1] * 3
    for b in base[:10]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    shared = words_of(rng, 120)
    texts += [words_of(rng, 30) + " " + shared + " " + words_of(rng, 30) for _ in range(5)]
    texts.append("\n".join(words_of(rng, 12) for _ in range(400)))
    return list(enumerate(texts))


@pytest.fixture
def docs(spark, corpus):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def odd(docs):
    """The documents with extra columns of clashing names, and rows without an id."""
    from pyspark.sql import functions as F

    df = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
