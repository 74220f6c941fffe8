"""Near duplicates by one-permutation MinHash with optimal densification.

One hash of each shingle gives its bin and its value; the least value of a bin is a coordinate of the
signature. An empty bin takes the value of the first filled bin in an order of its own, so each empty bin
draws its donor independently of the others. Bands of the signature give bucket keys, and each bucket offers
only star-shaped edges, from its members to one hub, so that pairs stay in proportion to rows.

1. Documents with equal shingle sets collapse to a class; classes alone enter buckets.
2. Every bucket offers its members' edges to its least document. Edges are confirmed on full shingle sets.
3. Where a bucket still holds several components it offers more stars, around a few hubs drawn from its
   largest component, to the members outside it, until the last of ``rounds`` rounds.
4. What the stars left apart is settled exactly, by a prefix filter over the members of such buckets: sets of
   n and m shingles that reach the similarity share one of the first few in an order from rare to common, and
   its places bound what they have in common.

A document is a row, not an id: rows of one doc_id with other texts are judged each. Sets are compared by
64-bit hashes of their shingles (see textscan).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import hash_unit, join_back, materialise, no_runtime_filters, packed, text_key
from .components import connected_components

BANDS, ROWS = 52, 7
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SKETCH = "doc_id long, text_key binary, n_shingles long, set_a long, set_b long, bands array<long>"


def shingles(texts: textscan.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every distinct shingle, by text; a text of fewer words is one shingle."""
    texts.find_words()
    words = texts.word_hash()
    value, at = textscan.windows(texts, words, size)
    text = texts.text[at]
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = texts.counts[short] > k
            extra[has] = textscan.mix(extra[has] * np.uint64(0x2545F4914F6CDD1D) + words[texts.first[short[has]] + k] + np.uint64(k + 1))
        value, text = np.concatenate([value, extra]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new]


def signatures(value: np.ndarray, text: np.ndarray, n: int, bins: int) -> np.ndarray:
    """[text, bin] least values after densification; rows of texts without shingles stay empty."""
    out = np.full(n * bins, _EMPTY, np.uint64)
    spread = textscan.mix(value ^ np.uint64(0x5851F42D4C957F2D))
    place = text * bins + ((spread >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, place, textscan.mix(spread + np.uint64(0x14057B7EF767814F)) >> np.uint64(1))
    out = out.reshape(n, bins)
    filled = out != _EMPTY
    # each bin's order of donors: a walk of its own through all bins
    draw = np.random.Generator(np.random.PCG64(bins))
    steps = np.array([s for s in range(1, bins) if np.gcd(s, bins) == 1])
    start, step = draw.integers(0, bins, bins), draw.choice(steps, bins)
    row, column = np.nonzero(~filled & filled.any(1)[:, None])
    source = out.copy()
    for turn in range(bins):
        if not len(row):
            break
        donor = (start[column] + turn * step[column]) % bins
        found = filled[row, donor]
        out[row[found], column[found]] = source[row[found], donor[found]]
        row, column = row[~found], column[~found]
    return out


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting at every size: the many small tables of a run would else be broadcast from the driver, each with pages of its own."""
    return left.join(right.hint("merge"), on, how)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sketch(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_a, set_b (a fingerprint of the set) and bands (bucket keys) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in textscan.chunks(batch.column(2)):
                texts = textscan.Texts(textscan.LOWER[texts.data], texts.offsets)
                value, of = shingles(texts, size)
                n = len(texts)
                counts = np.bincount(of, minlength=n)
                sums = []
                for salt in (0x9FB21C651E98DF25, 0xB492B66FBE98F273):
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(textscan.mix(value ^ np.uint64(salt)), out=total[1:])
                    edge = np.concatenate([[0], np.cumsum(counts)])
                    sums.append(total[edge[1:]] - total[edge[:-1]])
                signature = signatures(value, of, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                key = np.broadcast_to(key, (n, BANDS)).copy()
                for k in range(ROWS):
                    key = textscan.mix(key * np.uint64(0x2545F4914F6CDD1D) + signature[:, :, k])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(_signed(key).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(low, high - low) for k in (0, 1)], pa.array(counts.astype(np.int64)), pa.array(_signed(sums[0])), pa.array(_signed(sums[1])), bands], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text")).mapInArrow(run, _SKETCH)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """Of the pairs (u, v) those whose full shingle sets have a similarity of ``percent`` or more.

    ``texts`` has node and _text of every document in a pair. A hub's text comes with each of its pairs, but
    the join on the hub may be split, as no later step needs its pairs together. ``rows`` is the number of
    texts: every partition of these joins reads a part of them, however few the pairs are.
    """
    left = packed(_met(pairs, texts.select(F.col("node").alias("u"), F.col("_text").alias("_u")), "u"), rows, 1000)
    both = _met(left, texts.select(F.col("node").alias("v"), F.col("_text").alias("_v")), "v").select("u", "v", "_u", "_v")
    both = packed(both, rows, 1000)

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, part in textscan.chunks(column):
            value, of = shingles(textscan.Texts(textscan.LOWER[part.data], part.offsets), size)
            out += np.split(value, np.searchsorted(of, np.arange(1, len(part))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                hub = batch.column(3).dictionary_encode()  # a hub's set is made once for a batch
                hubs = sets(hub.dictionary)
                keep = []
                for a, k in zip(sets(batch.column(2)), hub.indices.to_pylist(), strict=True):
                    b = hubs[k]
                    common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                    keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, key) for every shingle of every text; n is the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, part in textscan.chunks(batch.column(1)):
                value, of = shingles(textscan.Texts(textscan.LOWER[part.data], part.offsets), size)
                edges = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(edges), pa.array(_signed(value)))], names=["node", "n", "keys"])

    return texts.select("node", "_text").mapInArrow(run, "node long, n int, keys array<long>").select("node", "n", F.explode("keys").alias("key"))


def _split(placed: DataFrame) -> DataFrame:
    """key, n and top (the size and label of the largest component) of the buckets that hold several components."""
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "label")).alias("top")
    return sizes.groupBy("key").agg(largest, F.sum("n").alias("all")).filter("all > top.n").select("key", F.col("top.n").alias("n"), F.col("top.label").alias("top"))


def _offers(placed: DataFrame, turn: int) -> DataFrame:
    """(node, hub): new edges in buckets that hold several components, from (key, node, label).

    Members outside the bucket's largest component are offered to about 2 ** turn of that component's members
    (to all of a smaller one), drawn anew for each turn: the fewer documents are open, the more each is tried.
    So one at the edge of a large group meets many of its members, over all its buckets, while a bucket's
    edges stay in proportion to its members.
    """
    members = join_back(placed, _split(placed), ["key"])
    hubs = members.filter((F.col("label") == F.col("top")) & (hash_unit(turn, "key", "node") < 2.0**turn / F.col("n"))).select("key", F.col("node").alias("hub"))
    return _met(members.filter("label != top").select("key", "node"), hubs, "key").select("node", "hub")


def _remaining(placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): every pair of different components that may reach ``percent``, among members of open buckets.

    Shingles are ordered from rare to common. If the first that sets of n and m shingles share stands at places
    i and j (from 0), they share at most min(n - i, m - j), and they must share (n + m) percent / (100 + percent).
    So only the first n - n percent / 100 places count, and in the smaller set only the first
    n - 2 n percent / (100 + percent), called early. A pair is made at a shingle where one side is early; where
    members of a large group are less alike than ``percent``, what they have in common is early in none.
    """
    labels = join_back(placed, _split(placed).select("key"), ["key"]).select("node", "label").distinct()
    open_ = materialise(labels)
    tokens = materialise(_tokens(_met(texts, open_.select("node"), "node", "left_semi"), size))
    often = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("node").orderBy("often", "key")
    ranked = join_back(tokens, often, ["key"]).withColumn("at", F.row_number().over(order) - 1)
    reach = ranked.filter(F.col("at") * 100 <= F.col("n") * (100 - percent)).filter("often > 1")
    early = (F.col("n") - F.col("at")) * (100 + percent) >= 2 * percent * F.col("n")
    prefix = materialise(_met(reach, open_, "node").select("key", "node", "label", "n", "at", early.alias("early")))
    members = materialise(join_back(prefix, _split(prefix).select("key", "top"), ["key"]).select(*prefix.columns, (F.col("label") == F.col("top")).alias("inner")))
    left, right = [members.select(*[F.col(c).alias(f"{side}_{c}") for c in members.columns]) for side in ("a", "b")]
    common = percent * (F.col("a_n") + F.col("b_n"))
    near = ((F.col("a_n") - F.col("a_at")) * (100 + percent) >= common) & ((F.col("b_n") - F.col("b_at")) * (100 + percent) >= common)
    meet = (F.col("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & near
    pairs = _met(left.filter("a_early and not a_inner"), right, meet).union(_met(left.filter("a_early and a_inner"), right.filter("not b_inner"), meet))
    return pairs.select(F.greatest("a_node", "b_node").alias("u"), F.least("a_node", "b_node").alias("v"))


def judge(df: DataFrame, size: int = 5, percent: int = 80, rounds: int = 2, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles and component for every row of ``df``; see near_duplicates().

    component is null for rows that link with nothing, because they have no shingles or no doc_id.
    """
    with no_runtime_filters(df.sparkSession):
        return _judged(df, size, percent, rounds, text)


def _judged(df: DataFrame, size: int, percent: int, rounds: int, text: str) -> DataFrame:
    sketched = materialise(sketch(df, size, text))
    known = sketched.filter("n_shingles > 0 and doc_id is not null")
    sets = ["set_a", "set_b", "n_shingles"]
    # a checkpoint's partitions stay as they are, so these numbers do
    classes = materialise(known.groupBy(*sets).agg(F.min("doc_id").alias("class_id"))).withColumn("node", F.monotonically_increasing_id())
    members = _met(known, classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", *sets])
    banded = members.select("node", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    # only documents in a bucket with others go on
    buckets = materialise(join_back(banded, hubs, ["key"]).select("key", "node", "hub"))
    wanted = members.select("node", "doc_id", "text_key").join(buckets.select("node").distinct().hint("merge"), "node", "left_semi")
    every = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    texts = materialise(_met(every, wanted.distinct(), ["doc_id", "text_key"]).select("node", "_text").dropDuplicates(["node"]))

    n_buckets, n_texts = buckets.count(), texts.count()
    offered = packed(buckets.filter("node > hub").select(F.col("node").alias("u"), F.col("hub").alias("v")), n_buckets).distinct()
    tried = materialise(packed(offered, n_buckets))
    links = materialise(confirm(tried, texts, size, percent, n_texts))
    stars = connected_components(links)
    for turn in range(1, rounds + 1):
        labels = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
        placed = materialise(packed(_met(buckets.select("key", "node"), labels, "node", "left").withColumn("label", F.coalesce("label", "node")), n_buckets))
        if turn < rounds:
            again = _offers(placed, turn).select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
        else:
            again = _remaining(placed, texts, size, percent)
        again = packed(again, n_buckets).distinct()
        fresh = materialise(packed(_met(packed(again, n_buckets), tried, ["u", "v"], "left_anti"), n_buckets))
        n_fresh = fresh.count()
        if not n_fresh:
            continue
        found = materialise(confirm(packed(fresh, n_fresh), texts, size, percent, n_texts))
        tried = tried.union(fresh)
        if not found.isEmpty():
            stars = connected_components(stars.union(found))
    ends = _met(classes, stars, classes["node"] == stars["u"], "left").select(*sets, "class_id", F.coalesce("v", "node").alias("end"))
    least = ends.groupBy("end").agg(F.min("class_id").alias("component"))
    labels = join_back(ends, least, ["end"]).select(*[F.col(c).alias(f"_{c}") for c in sets], "component")
    same = [F.col(c) == F.col(f"_{c}") for c in sets]
    out = _met(sketched, labels, same[0] & same[1] & same[2], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, rounds: int = 2, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``df``.

    Words are lower-cased (A-Z); documents of equal sets, or of sets whose Jaccard similarity is ``percent`` or
    more, are linked, and component_id is the least doc_id that links reach. Null and empty texts have no
    shingles and link with nothing. Rows that repeat a doc_id are judged each by their own text. A row without
    doc_id links with nothing, and is kept with a null component. Other columns are ignored.
    """
    component = F.coalesce("component", "doc_id")
    return judge(df, size, percent, rounds, text).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_copies(df: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of ``df`` but all except one of each component: the one of least doc_id, then of least text_key.

    Rows that link with nothing stay, also where they are equal. Of equal rows of a component's first document
    one stays.
    """
    linked = judge(df, size, percent, text=text).filter("component is not null")
    rows = materialise(linked.groupBy("doc_id", "text_key", "component").agg(F.count(F.lit(1)).alias("copies")))
    first = rows.filter("doc_id = component").groupBy("component").agg(F.min("text_key").alias("first"))
    placed = join_back(rows, first, ["component"]).select("doc_id", "text_key", "copies", ((F.col("doc_id") == F.col("component")) & (F.col("text_key") == F.col("first"))).alias("stays"))
    apart = placed.filter("not stays or copies > 1").select(F.col("doc_id").alias("_copy_doc"), F.col("text_key").alias("_copy_key"))
    one = placed.filter("stays and copies > 1").select(F.col("doc_id").alias("_copy_doc"), F.col("text_key").alias("_copy_key"))
    same = (F.col("doc_id").cast("long") == F.col("_copy_doc")) & (text_key(text) == F.col("_copy_key"))
    again = df.join(one, same).dropDuplicates(["_copy_doc", "_copy_key"])
    return df.join(apart, same, "left_anti").select(*df.columns).unionByName(again.select(*df.columns))


#: The exact components for shingles of four words in SQL, by a join on shingles.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM links UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.r, d.doc_id) AS component_id, coalesce(m.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1) m USING (doc_id)
"""
