"""Benchmark decontamination by SimHash, multi-index Hamming blocks and an exact check, in DataFrame functions only.

1. Words are the lower-cased runs of letters and digits. A shingle that a document shares with an item proposes the
   item-sized window that lays the item's shingle over the document's, cut to the document. A window without a shared
   shingle has similarity 0, and one in which none keeps its place is no better than one that is proposed.
2. A window's fingerprint is the 64-bit SimHash of its shingles, weighted by how often each occurs. Items stand in an
   index of BLOCKS blocks of their fingerprints, each with all values up to BLOCK_RADIUS bits away: two fingerprints
   within RADIUS bits agree so far in some block, so a window that looks up its own blocks meets every such item.
3. What the fingerprints part though a shingle is shared (a pair beyond RADIUS) goes on as well: it is a supplement, as
   a radius that lost none would select nothing.
4. Every pair is compared exactly: the weighted Jaccard similarity of window and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_key

#: An index of at most this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The same for the index of fingerprints, which has thousands of rows for an item and meets few windows.
BROADCAST_VALUES = 100_000
#: Blocks of a fingerprint, bits in which one of them may differ, and the radius that this guarantees.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Differences of a block within its radius: 697 of them.
MASKS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _shingle_rows(df: DataFrame, words: str, size: int, keep: list[str]) -> DataFrame:
    """A row (keep, at, shingle) for every run of ``size`` words; arrays are zipped, so no lambda runs for each word."""
    count = F.size(words) - F.lit(size - 1)
    lanes = [F.slice(words, F.lit(k + 1), count).alias(f"w{k}") for k in range(size)]
    zipped = F.arrays_zip(F.sequence(F.lit(0), count - 1).alias("at"), *lanes)
    long_enough = df.filter(F.size(words) >= size)
    rows = long_enough.select(*keep, F.inline(zipped).alias("at", *[f"w{k}" for k in range(size)]))
    return rows.select(*keep, "at", F.xxhash64(*[f"w{k}" for k in range(size)]).alias("shingle"))


def _small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    # beyond that the hint keeps a join by sorting: sizes after an explode() are estimated far too low
    return F.broadcast(df) if rows <= most else df.hint("merge")


def _simhash(words: Column, k: int) -> Column:
    """64 bits, each the majority of that bit in the hashes of all runs of ``k`` words; 0 where there are none."""
    runs = F.size(words) - F.lit(k - 1)
    hashes = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    counts = lambda acc, h: F.transform(acc, lambda c, bit: c + F.getbit(h, bit))
    bits = lambda acc: F.transform(acc, lambda c, bit: F.call_function("shiftleft", F.when(c * 2 > runs, F.lit(1)).otherwise(F.lit(0)).cast("long"), bit))
    whole = lambda acc: F.aggregate(bits(acc), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    return F.when(runs > 0, F.aggregate(hashes, F.array_repeat(F.lit(0), 64), counts, whole)).otherwise(F.lit(0).cast("long"))


def _block(fingerprint: Column, block: Column | int) -> Column:
    shift = F.lit(block * BLOCK_BITS) if isinstance(block, int) else block * BLOCK_BITS
    return F.call_function("shiftrightunsigned", fingerprint, shift).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _in_radius(windows: DataFrame, items: DataFrame, names: list[str]) -> DataFrame:
    """(names, item_id, item, first_word, n, window) of the windows (with fp) and the items (with item_fp) of their size within RADIUS bits."""
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    own = items.select("item_id", "item", "n", "item_fp", F.explode(blocks).alias("block"))
    index = own.select("item_id", "item", "n", "item_fp", "block", F.explode(F.lit(MASKS)).alias("mask")).withColumn("value", _block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("mask"))).drop("mask")
    probes = windows.select(*names, "first_word", "n", "window", "fp", F.explode(blocks).alias("block")).withColumn("value", _block(F.col("fp"), F.col("block")))
    met = probes.join(_small(index, items.count() * BLOCKS * len(MASKS), BROADCAST_VALUES), ["n", "block", "value"]).filter(_distance("fp", "item_fp") <= RADIUS)
    # a pair that meets in several blocks counts in the first of them
    agrees = [F.when(F.bit_count(_block(F.col("fp"), b).bitwiseXOR(_block(F.col("item_fp"), b))) <= BLOCK_RADIUS, F.lit(b)) for b in range(BLOCKS)]
    return met.filter(F.col("block") == F.coalesce(*agrees)).select(*names, "item_id", "item", "first_word", "n", "window")


def _found(texts: DataFrame, benchmark: DataFrame, names: list[str], size: int, percent: int) -> DataFrame | None:
    """(names, item_id, first_word, n_words, similarity) of every window of ``texts`` (names, words) that holds an item.

    An item is a text: rows of one item_id with other texts are compared each. None stands for an empty benchmark.
    """
    items = benchmark.filter("item_id is not null").select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.select("item_id", "words", F.size("words").alias("n"), F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("item")).dropDuplicates(["item_id", "item"])
    sizes = [r["k"] for r in items.select(F.least("n", F.lit(size)).alias("k")).distinct().orderBy("k").collect()]  # at most ``size`` values
    if not sizes:
        return None
    item_rows = None
    for k in sizes:
        part = _shingle_rows(items.filter(F.least("n", F.lit(size)) == k), "words", k, ["item_id", "item", "n"])
        item_rows = part if item_rows is None else item_rows.union(part)
    item_rows = materialise(item_rows)
    n_rows = item_rows.count()
    # windows proposed by shared shingles; the window's words are cut from the row at hand and stand for it
    key = [*names, "item_id", "item", "first_word", "n", "window"]
    found = None
    for k in sizes:
        lines = item_rows.filter(F.least("n", F.lit(size)) == k).select("shingle", F.col("at").alias("offset"), "item_id", "item", "n")
        hits = _shingle_rows(texts, "words", k, [*names, "words"]).join(_small(lines, n_rows), "shingle")
        first = F.greatest(F.least(F.col("at") - F.col("offset"), F.size("words") - F.col("n")), F.lit(0))
        placed = hits.select(*names, "item_id", "item", first.alias("first_word"), "n", "words")
        proposed = placed.select(*key[:-1], F.slice("words", F.col("first_word") + 1, F.col("n")).alias("window")).distinct()
        candidates = _candidates(materialise(proposed), items.filter(F.least("n", F.lit(size)) == k), names, k)
        of_window = _shingle_rows(candidates, "window", k, key).groupBy(*key, "shingle").agg(F.count(F.lit(1)).alias("c"))
        found = of_window if found is None else found.union(of_window)
    # exact weighted similarity
    of_item = item_rows.groupBy("item_id", "item", "shingle").agg(F.count(F.lit(1)).alias("d"))
    common = found.join(_small(of_item, n_rows), ["item_id", "item", "shingle"]).groupBy(*key).agg(F.sum(F.least("c", "d")).alias("common"))
    have = F.size("window")
    used = F.greatest(F.least(F.col("n"), have) - F.least("n", F.lit(size)) + 1, F.lit(0))
    whole = F.col("n") - F.least("n", F.lit(size)) + 1
    similarity = F.col("common") / (used + whole - F.col("common"))
    return common.select(*names, "item_id", "first_word", have.alias("n_words"), similarity.alias("similarity")).filter(F.col("similarity") * 100 >= percent)


def _candidates(proposed: DataFrame, items: DataFrame, names: list[str], k: int) -> DataFrame:
    """Pairs within RADIUS by way of the blocks, then the proposed ones beyond it."""
    of_items = materialise(items.select("item_id", "item", "n", _simhash(F.col("words"), k).alias("item_fp")))
    printed = proposed.select("*", _simhash(F.col("window"), k).alias("fp"))
    windows = printed.select(*names, "first_word", "n", "window", "fp").distinct()
    near = _in_radius(windows, of_items, names)
    beyond = printed.join(of_items.drop("n"), ["item_id", "item"]).filter(_distance("fp", "item_fp") > RADIUS)
    return near.unionByName(beyond.select(*near.columns))


def find_leaks(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): each item found in each document, at its best window.

    Items of fewer words than ``size`` count as one shingle. A document shorter than an item is compared
    whole. Null and empty texts on either side match nothing, as do rows without an id; an empty benchmark
    gives no rows. Rows that repeat a doc_id or an item_id are compared each, by their own texts, and give one
    row for each pair of ids: that of the best window.
    """
    texts = documents.filter("doc_id is not null").select("doc_id", _words(F.col("text")).alias("words"))
    judged = _found(texts, benchmark, ["doc_id"], size, percent)
    if judged is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word int, n_words int, similarity double")
    best = F.max(F.struct("similarity", -F.col("first_word"), "n_words")).alias("b")
    return judged.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.col2")).alias("first_word"), "b.n_words", "b.similarity")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` whose own text holds no item, whatever their doc_id is."""
    texts = documents.select(text_key().alias("_leaking"), _words(F.col("text")).alias("words"))
    judged = _found(texts, benchmark, ["_leaking"], size, percent)
    if judged is None:
        return documents
    return documents.join(judged.select("_leaking").distinct(), text_key() == F.col("_leaking"), "left_anti")


#: The exact result in SQL, without fingerprints: every window that a shared shingle proposes is compared.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
t AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) > 0),
ts AS (SELECT item_id, n, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM t)),
ks AS (SELECT DISTINCT k FROM t),
ds AS (SELECT doc_id, k, i, n_doc, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, ws, len(ws) AS n_doc, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks)),
starts AS (SELECT DISTINCT doc_id, item_id, n, ds.k, greatest(least(ds.i - ts.i, n_doc - n), 0) AS first FROM ds JOIN ts ON ds.g = ts.g AND ds.k = ts.k),
windows AS (SELECT doc_id, item_id, n, k, first, ws[first + 1:first + n] AS ws FROM starts JOIN d USING (doc_id)),
found AS (SELECT doc_id, item_id, first, g, count(*) AS c FROM (SELECT doc_id, item_id, first, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM windows)) GROUP BY ALL),
wanted AS (SELECT item_id, g, count(*) AS c FROM ts GROUP BY ALL),
common AS (SELECT doc_id, item_id, first, sum(least(f.c, w.c)) AS common FROM found f JOIN wanted w USING (item_id, g) GROUP BY ALL),
scored AS (SELECT doc_id, item_id, first, len(ws) AS n_words, common / ((len(ws) - k + 1) + (n - k + 1) - common)::DOUBLE AS similarity FROM common JOIN windows USING (doc_id, item_id, first))
SELECT doc_id, item_id, first::INT AS first_word, n_words::INT AS n_words, similarity FROM scored WHERE 100 * similarity >= 80
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first) = 1
"""
