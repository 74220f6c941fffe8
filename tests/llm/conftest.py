import re
import random

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, bucket string"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, start=0, size=400):
    return " ".join(f"w{start + rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, shared passages, nulls, empty texts and clashing columns."""
    rng = random.Random(7)
    rows, base = [], [sentence(rng, 90) for _ in range(12)]
    passage = sentence(rng, 70, 1000)
    for i in range(60):
        kind = i % 6
        if kind == 0:
            text = base[i % 12]
        elif kind == 1:  # a near copy: one word in ninety differs
            ws = base[(i - 1) % 12].split()
            ws[rng.randrange(len(ws))] = f"new{i}"
            text = " ".join(ws)
        elif kind == 2:
            text = f"{sentence(rng, 20)}\n{passage}\t{sentence(rng, 20)}"
        elif kind == 3:
            text = sentence(rng, rng.randrange(1, 12))
        elif kind == 4:
            text = ["", " \n\t", "Über ÜBER éa", None, "ONE one  One"][i // 6 % 5]
        else:
            text = sentence(rng, 130)
        rows.append((i, text, ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 5}", None if text is None else len(text), 0.5, 1, "b"))
    rows.append(rows[0])  # a repeated row
    rows.append((200, " ".join(sentence(rng, 5) for _ in range(3000)), "en", None, 1, None, None, None))  # a long text
    rows.append((None, base[3], "en", "hot", 1, None, None, None))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
