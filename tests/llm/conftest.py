from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 1, n: int = 120):
    """Invented documents with copies, near copies, shared passages, nulls and odd texts."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        kind = draw.random()
        text = " ".join(draw.choice(words) + draw.choice(["", "", ".", ",\n"]) for _ in range(draw.randint(5, 200)))
        if out and kind < 0.15:
            text = draw.choice(out)[1] or ""
        elif out and kind < 0.35:
            near = (draw.choice(out)[1] or "").split(" ")
            for _ in range(draw.randint(1, 4)):
                near[draw.randrange(len(near))] = draw.choice(words)
            text = " ".join(near)
        elif kind < 0.5:
            text = text + "\n" + passage + "\n" + text[::-1]
        elif kind < 0.55:
            text = "é€ñ \x00 " + "ab " * 300
        out.append((i, text, draw.choice(["xx", "yy", None]), draw.choice(["a", "b", "c", None]), len(text)))
    out += [(1000, None, None, None, None), (1001, "", "xx", "a", 0), (1002, " \n\t ", "xx", "b", 4)]
    out += [(None, "without an id but with some words to it", "yy", "a", 39), (1003, "x" * 30_000, "yy", "c", 30_000)]
    out += [out[0], (1004, "one two three", "xx", "a", 13), (1005, "one two three", "xx", "a", 13)]
    return out


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw):
    return spark.createDataFrame(raw, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that operators use inside or return."""
    from pyspark.sql import functions as F

    extra = "node ord tag data size slot shard block score places bands copies links root kept _id _words".split()
    return docs.select("*", *[F.lit("x").alias(c) for c in extra])
