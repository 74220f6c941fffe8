"""Spelling variants against brute force: distances, counts with typing errors, roots."""

import random
import re
import zlib
from collections import Counter

from emendata.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x.encode()), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [n, len(around), forms[w], counts[forms[w]] if forms[w] is not None else None]
    for w, row in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    counts = {}
    for _ in range(400):  # few letters, so that runs of one letter, shifts and double matches are frequent
        counts["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7)))] = rng.choice([1, 2, 3, 10, 30, 31, 300, 3000, 40000])
    counts |= {"": 7, "😀a": 1, "😀b": 10, "ÿ": 5}
    got = rows(spelling.group_variants(spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long").repartition(5)))
    assert got == brute(counts)
    assert max(r[3] or 0 for r in got.values()) > 0 and any(r[4] != r[2] and r[2] is not None for r in got.values())


def test_a_chain_of_forms_ends_at_its_root(spark):
    counts = {"a" * k: 10 ** (k - 1) for k in range(1, 13)}
    got = rows(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[4] for r in got.values()} == {"a" * 12}
    assert not rows(spelling.group_variants(spark.createDataFrame([], "word string, n long")))
    lone = rows(spelling.group_variants(spark.createDataFrame([("x", None), ("xyz", 4)], "word string, n long")))
    assert lone == {"x": (0, 0, None, None, "x"), "xyz": (4, 0, None, None, "xyz")}


def test_very_long_words_have_rows_of_a_fixed_size(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab") for _ in range(60_000))
    other = long[:30_000] + long[30_001:]
    got = rows(spelling.group_variants(spark.createDataFrame([(long, 20), (other, 2), (long + "xx", 9)], "word string, n long")))
    assert got[other] == (2, 1, long, 20, long) and got[long][1] == 1 and got[long + "xx"][1] == 0


def test_words_are_counted_over_whole_texts(spark, documents, corpus, nothing):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Straßenbahn", "ÉCOLEéco", "wonderful×day", "tiny", "sevenly", "eightful"]) + rng.choice(["", ".", "9"]) for _ in range(300)) for _ in range(20)]
    made = [(k if k != 4 else None, t) for k, t in enumerate(texts)] + [(7, None), (8, ""), (3, texts[3])]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in made], "doc_id long, text string, word string, run string")
    want = Counter()
    for d, t in made:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.word_counts(df, spoiled=31).collect()} == want
    assert spelling.word_counts(nothing, spoiled=31).count() == 0


def test_pairs_grow_with_the_words_and_not_with_their_square(spark):
    """All single deletions of one word share it as a key, but only neighbours are proposed."""
    rng = random.Random(1)
    word = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)) * 4
    made = {word} | {word[:k] + word[k + 1 :] for k in range(len(word))}
    vocabulary = spark.createDataFrame([(k, w, 1) for k, w in enumerate(sorted(made))], "id long, word string, n long")
    pairs = spelling.near_pairs(vocabulary).count()
    assert pairs == sum(near(a, b) for a in made for b in made if a < b) < 3 * len(made)
