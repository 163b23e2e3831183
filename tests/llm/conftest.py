from __future__ import annotations

import random

import pytest

#: Columns an input may have besides its own; the names are those operators use inside.
CLASHING = "spans long, fp long, key string, component string, size double, of string"


@pytest.fixture(scope="session")
def corpus():
    """doc_id and text: prose, copies, near copies, empty and null texts, one long text."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abdeilnorstu", k=draw.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 120))) for _ in range(60)]
    texts += texts[:5] + [texts[6] + " end", texts[7].replace(" ", "\n", 1)]
    texts += ["", None, " \t\n", "one", "One two", "é à ü", "  two  spaces ", "x" * 3000]
    texts.append(" ".join(draw.choices(words, k=20_000)))
    return list(enumerate(texts))


@pytest.fixture
def documents(spark, corpus):
    return make(spark, corpus)


def make(spark, rows):
    """Documents with columns whose names clash with those used inside."""
    filled = [(*r, 1, 2, "k", "c", 3.0, "o") for r in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, {CLASHING}")


@pytest.fixture
def no_documents(spark):
    return make(spark, [])
