"""Near duplicates, repeated passages and leaks against brute force."""

import hashlib
import itertools
import random
import time
from collections import Counter

from emendata.llm import decontaminate, minhash, substring
from emendata.llm.components import connected_components
from pyspark.sql import functions as F

from .conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    ws = words((text or "").translate(LOWER))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def expected_components(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_match_brute_force(documents, corpus):
    for size in (4, 5):
        want = expected_components([(r[0], r[1]) for r in corpus if r[0] is not None], size, 80)
        got = minhash.near_duplicates(documents, size=size).collect()
        assert len(got) == len(corpus)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_many_near_copies_stay_one_component(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(300) for k in [i % 200]]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.component_id for r in got} == {0}


def test_pairs_within_a_group_of_unlike_texts(spark):
    """Members of the group are 0.78 alike, so none is a link between others; pairs in it are 0.81 alike."""
    start = [f"w{k}" for k in range(203)]
    rows = []
    for i in range(100):
        rows.append((i, " ".join(start + [f"pair{i // 2}-{k}" for k in range(4)] + [f"own{i}-{k}" for k in range(24)])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    want = {i: c for i, (_, c) in expected_components(rows, 4, 80).items()}
    assert set(want.values()) == set(range(0, 100, 2))
    assert got == want


def test_empty_tables(nothing, spark):
    assert minhash.near_duplicates(nothing).count() == 0
    assert substring.remove_repeats(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(nothing, items).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 300)], "u long, v long")
    got = {r.u: r.v for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 300}


def brute_repeats(rows, window):
    first = {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1]):
        ws = words(t)
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in ((r[0], r[1]) for r in rows):
        ws = words(t)
        gone = [False] * len(ws)
        if i is not None:
            for k in range(len(ws) - window + 1):
                if first[tuple(ws[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out[i] = (len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_repeats_match_brute_force(documents, corpus):
    for window in (50, 7, 1, 64):
        want = brute_repeats(corpus, window)
        got = substring.remove_repeats(documents, window=window).withColumn("sha", F.sha2("kept_text", 256)).collect()
        assert len(got) == len(corpus)
        for r in got:
            assert (r.n_words, r.n_removed, r.sha) == want[r.doc_id], (window, r.doc_id)
            assert sum(s["after"] - s["first"] for s in r.removed) == r.n_removed


def test_rows_of_one_id_lose_only_what_their_own_text_repeats(spark):
    """Every row against brute force over rows: a window goes if a row of smaller doc_id has it too."""
    rng = random.Random(6)
    passages = [" ".join(f"p{k}-{i}" for i in range(80)) for k in range(6)]
    a, b, c = passages[:3]
    tables = [[(1, a), (2, a), (2, b)], [(1, a), (2, f"{c} {a}"), (2, b)], [(1, a), (2, f"{c} {a}"), (2, "one two three")], [(2, a), (2, a.replace(" ", "\n")), (2, f"{b} {a}"), (1, b), (3, a), (3, None)]]
    for _ in range(4):
        tables.append([(rng.randrange(4), " ".join(rng.choice(passages) for _ in range(rng.randrange(1, 4)))) for _ in range(9)])
    for rows in tables:
        firsts = {}
        for d, t in rows:
            ws = words(t)
            for k in range(len(ws) - 49):
                key = tuple(ws[k : k + 50])
                firsts[key] = min(firsts.get(key, d), d)
        want = []
        for d, t in rows:
            ws = words(t)
            gone = {k + i for k in range(len(ws) - 49) if firsts[tuple(ws[k : k + 50])] < d for i in range(50)}
            want.append((d, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)


def leak_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def best_similarity(ws, item):
    """The highest weighted similarity of an item's shingles to those of a window of as many words."""
    size = min(5, len(item))
    wanted = Counter(tuple(item[j : j + size]) for j in range(len(item) - size + 1))
    best = 0
    for s in range(max(len(ws) - len(item), 0) + 1):
        part = ws[s : s + len(item)]
        have = Counter(tuple(part[j : j + size]) for j in range(len(part) - size + 1))
        if have:
            best = max(best, sum((have & wanted).values()) / sum((have | wanted).values()))
    return best


def test_leaks_match_brute_force(spark):
    import random

    rng = random.Random(3)
    item_words = [[f"t{rng.randrange(900)}" for _ in range(n)] for n in (15, 22, 30, 58, 58, 3)]
    items = [(k, " ".join(w)) for k, w in enumerate(item_words)] + [(90, ""), (91, None), (None, "a b c")]
    rows = []
    for i in range(80):
        filler = [f"f{rng.randrange(3000)}" for _ in range(rng.randrange(0, 60))]
        item = list(item_words[i % 6])
        kind = i % 5
        if kind == 1 and len(item) > 20:
            item[rng.randrange(len(item))] = "changed"
        elif kind == 2:
            item = item[: len(item) // 2]
        elif kind == 3:
            item = [w.upper() + "," for w in item]
        elif kind == 4:
            item = []
        cut = rng.randrange(len(filler) + 1)
        rows.append((i, " ".join(filler[:cut] + item + filler[cut:]), i))
    rows += [(500, None, 1), (501, "", 1), (None, " ".join(item_words[0]), 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(documents, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, text, _ in rows:
        for k, item in enumerate(item_words):
            best = best_similarity(leak_words(text), item)
            if i is not None and best >= 0.8:
                want[i, k] = round(best, 9)
    assert len(want) > 20
    assert got == want


def test_leaks_with_cut_or_replaced_ends(spark):
    """A number of last words are replaced or cut off, so that the shingles are just 0.8 alike or a little more."""
    items, rows, want = [], [], set()
    for n, ends in ((13, 1), (22, 2), (40, 4), (49, 5), (94, 10)):
        for turn in range(12):
            item = [f"t{n}-{turn}-{k}".replace("-", "x") for k in range(n)]
            doc = len(rows)
            items.append((doc, " ".join(item)))
            end = [f"e{doc}x{k}" for k in range(ends)] if turn % 2 else []
            rows.append((doc, " ".join([f"f{doc}x{k}" for k in range(30)] + item[: n - ends] + end)))
            kept = n - ends - 4
            # a document that ends within the item is compared at its last n words
            assert kept / (2 * (n - 4) - kept) >= 0.8
            want.add((doc, doc))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_clean_documents_stay(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "Alpha, beta gamma delta epsilon zeta eta theta!", "x"), (2, "alpha beta gamma", "y"), (3, None, "z"), (None, "q", "w")], "doc_id long, text string, similarity string")
    kept = decontaminate.drop_leaks(rows, items)
    assert kept.columns == rows.columns
    assert sorted(r.similarity for r in kept.collect()) == ["w", "y", "z"]


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    """Of rows with one id only those go that hold an item themselves; each text of an item counts."""
    one, two = ([f"{c}{k}" for k in range(12)] for c in "ab")
    items = spark.createDataFrame([(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(one))], "item_id long, text string")
    texts = ["x y " + " ".join(one), "q " + " ".join(two) + " z", "clean words alone", None]
    rows = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate([(7, texts[0]), (7, texts[1]), (7, texts[2]), (8, texts[1]), (None, texts[0]), (None, texts[2]), (7, texts[3])])], "doc_id long, text string, row long")
    assert {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.find_leaks(rows, items).collect()} == {(7, 1, 1), (8, 1, 1)}
    assert sorted(r.row for r in decontaminate.drop_leaks(rows, items).collect()) == [2, 5, 6]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with other texts: each belongs to the component of its own text."""
    texts = {k: " ".join(f"{k}{n}" for n in range(60)) for k in "abc"}
    near = texts["a"].replace("a30", "other")
    rows = [(1, texts["a"]), (2, texts["a"]), (2, texts["b"]), (5, texts["c"]), (5, near), (1, texts["a"]), (1, texts["a"]), (None, texts["a"]), (9, ""), (9, ""), (6, texts["c"])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=5).collect())
    assert got == sorted([(1, 56, 1, True)] * 3 + [(2, 56, 1, False), (2, 56, 2, True), (5, 56, 5, True), (5, 56, 1, False), (-1, 56, None, True), (9, 0, 9, True), (9, 0, 9, True), (6, 56, 5, False)])
    kept = minhash.without_copies(df, size=5)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()) == sorted([(1, texts["a"]), (2, texts["b"]), (5, texts["c"]), (-1, texts["a"]), (9, ""), (9, "")])


def test_texts_that_collide_in_polynomial_hashes(spark):
    """The Thue-Morse sequence and its complement have equal sums of powers modulo 2 ** 64 at every odd base."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = (["ab"[b ^ flip] for b in bits] for flip in (0, 1))
    start = [f"p{k}" for k in range(10)]
    rows = [(1, " ".join(one)), (2, " ".join(start + two))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, 50)
    for r in substring.remove_repeats(df, window=50).withColumn("sha", F.sha2("kept_text", 256)).collect():
        assert (r.n_words, r.n_removed, r.sha) == want[r.doc_id]
    whole = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(whole, window=2048).collect()} == {i: n for i, (_, n, _) in brute_repeats([(1, " ".join(one)), (2, " ".join(two))], 2048).items()}
    letters = spark.createDataFrame([(1, "".join(one)), (2, "".join(two))], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(letters, size=4).collect()} == {1, 2}


def test_first_level_leaves_no_shuffle_files(spark, documents):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.rsplit("/", 1)[-1] for p in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p}
    documents.count()
    before = files()
    cleaned = substring.remove_repeats(documents, window=50)
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before
    assert cleaned.count() == documents.count()


def test_blocks_meet_every_fingerprint_within_their_radius(spark):
    rng = random.Random(12)
    items, windows = [], []
    for k in range(40):
        print_ = rng.getrandbits(64)
        items.append((k, "x", 20, print_ - (1 << 64) if print_ >> 63 else print_))
        for far in (0, 7, decontaminate.RADIUS, decontaminate.RADIUS + 1, 25):
            other = print_
            for bit in rng.sample(range(64), far):
                other ^= 1 << bit
            windows.append((len(windows), 0, 20, [str(k)], other - (1 << 64) if other >> 63 else other))
    item_rows = spark.createDataFrame(items, "item_id long, item string, n int, item_fp long")
    window_rows = spark.createDataFrame(windows, "doc_id long, first_word int, n int, window array<string>, fp long")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate._in_radius(window_rows, item_rows, ["doc_id"]).collect())
    want = sorted((d, i) for d, _, _, _, a in windows for i, _, _, b in items if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= decontaminate.RADIUS)
    assert got == want and len(got) >= 120
    assert decontaminate._in_radius(window_rows.withColumn("n", F.lit(21)), item_rows, ["doc_id"]).count() == 0


def test_recall_of_the_blocks_alone(spark):
    """Windows at a similarity of 0.8 or little more: words replaced at one end, so that each costs one shingle."""
    rng = random.Random(13)
    rows = []
    for k in range(600):
        n = rng.randrange(14, 50)
        item = [f"a{rng.randrange(5000)}" for _ in range(n)]
        gone = (n - 4) // 9  # the most that leave (n - 4 - gone) / (n - 4 + gone) at 0.8
        rows.append((k, item, item[:-gone] + [f"b{rng.randrange(5000)}" for _ in range(gone)]))
    prints = spark.createDataFrame(rows, "k int, item array<string>, window array<string>").select(decontaminate._simhash(F.col("item"), 5).alias("a"), decontaminate._simhash(F.col("window"), 5).alias("b"))
    found = prints.filter(decontaminate._distance("a", "b") <= decontaminate.RADIUS).count()
    assert found >= 0.97 * len(rows)
