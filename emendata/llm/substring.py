"""Removal of passages that an earlier document has, by level-wise doubling.

A window of n words can only repeat if its parts of half the length do. So the first level looks for repeats
of half windows, and only what repeats there is extended to the full length:

1. Of the half windows in each full window the one of least hash stands for it. Both copies of a repeated
   window choose the same one, and neighbouring windows mostly share it, so few half windows are shuffled.
2. Half windows found in two documents or more go back to their documents, and the full windows that they
   stand for are hashed (96 bits) and shuffled; those in a document of smaller id are repeats.
3. A document's repeats are united to spans of words, and these are removed.

Before that, documents of equal word sequence collapse to the one of least id: all others are repeats from
the first word to the last. A row is told apart from others of its doc_id by its text. Texts are shuffled once, by
doc_id and a hash of the text, and that exchange serves every later join. The shuffle files of the first level go
before the second begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import join_back, materialise

_SECOND_BASE = 0xE7037ED1A0B428DB


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _least_over(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _standing(texts: textscan.Texts, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each full window the hash of the half window that stands for it, and the window's first word."""
    half = (window + 1) // 2
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, at = textscan.windows(texts, words, half)
    everywhere = np.zeros(len(words) - half + 1, np.uint64)
    everywhere[at] = value
    least = _least_over(everywhere, window - half + 1)
    whole = np.flatnonzero(texts.text[: len(words) - window + 1] == texts.text[window - 1 :])
    return least[whole], whole


def _survey(df: DataFrame, window: int) -> DataFrame:
    """doc_id, text's hash, n_words, a fingerprint of the word sequence, and the half windows that stand for its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in textscan.chunks(batch.column(2)):
                texts.find_words()
                words = texts.word_hash()
                prints = texts.sequence_prints()
                least, at = _standing(texts, words, window)
                of = texts.text[at]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
                least, of = least[new], of[new]
                edges = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                halves = pa.ListArray.from_arrays(pa.array(edges), pa.array(_signed(least)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(texts.counts.astype(np.int64)), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])), halves], names=["doc_id", "of", "n_words", "seq_a", "seq_b", "halves"])

    return df.mapInArrow(run, "doc_id long, of long, n_words long, seq_a long, seq_b long, halves array<long>")


def _full_windows(df: DataFrame, window: int) -> DataFrame:
    """(win_a, win_b, doc_id, of, at) of the windows that one of the document's repeated half windows stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for low, high, texts in textscan.chunks(batch.column(2)):
                texts.find_words()
                words = texts.word_hash()
                least, at = _standing(texts, words, window)
                part = lists.slice(low, high - low)
                repeated = textscan.mix(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + _salt(np.repeat(np.arange(len(texts)), np.diff(part.offsets.to_numpy()))))
                chosen = np.isin(textscan.mix(least + _salt(texts.text[at])), repeated)
                first, _ = textscan.windows(texts, words, window)
                second, _ = textscan.windows(texts, textscan.mix(words ^ np.uint64(_SECOND_BASE)), window, _SECOND_BASE)
                at, first, second = at[chosen], first[chosen], second[chosen]
                of = texts.text[at]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(first)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[low:high][of]), pa.array(hashes[low:high][of]), pa.array((at - texts.first[of]).astype(np.int32))], names=["win_a", "win_b", "doc_id", "of", "at"])

    return df.mapInArrow(run, "win_a long, win_b int, doc_id long, of long, at int")


def _salt(of: np.ndarray) -> np.ndarray:
    return (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _remove(df: DataFrame, window: int) -> DataFrame:
    """The result rows from doc_id, text, the first words of its repeats, and whether all is a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copies = batch.column(2), np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            for low, high, texts in textscan.chunks(batch.column(1)):
                texts.find_words()
                part = lists.slice(low, high - low)
                counts = np.diff(part.offsets.to_numpy())
                at = part.flatten().to_numpy(zero_copy_only=False) + np.repeat(texts.first, counts)
                edge = np.zeros(len(texts.starts) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = (np.cumsum(edge[:-1]) > 0) | copies[low:high][texts.text]
                yield _rows(batch.column(0).slice(low, high - low), texts, gone)

    return df.mapInArrow(run, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,after:int>>, kept_text string")


def _rows(ids: pa.Array, texts: textscan.Texts, gone: np.ndarray) -> pa.RecordBatch:
    n = len(texts)
    data, offsets = texts.joined(~gone)
    kept = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    # spans of removed words, counted from the text's first word
    inside = np.zeros(len(gone) + 1, bool)
    inside[:-1] = gone
    new = np.flatnonzero(inside[:-1] & ~(np.concatenate([[False], inside[:-2]]) & (np.concatenate([[-1], texts.text[:-1]]) == texts.text)))
    end = np.flatnonzero(inside[:-1] & ~(inside[1:] & (np.concatenate([texts.text[1:], [-1]]) == texts.text))) + 1
    owner = texts.text[new]
    spans = pa.StructArray.from_arrays([pa.array((new - texts.first[owner]).astype(np.int32)), pa.array((end - texts.first[owner]).astype(np.int32))], names=["first", "after"])
    removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([ids, pa.array(texts.counts.astype(np.int64)), pa.array(np.bincount(texts.text[gone], minlength=n).astype(np.int64)), removed, kept], names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])


def remove_repeats(df: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (spans of words) and kept_text for every row of ``df``.

    A word goes if a window of ``window`` words around it also starts in a document of smaller doc_id; all
    windows are judged on the input. kept_text joins the other words by one space; it is empty for null and
    empty texts. Texts of fewer words lose nothing. Rows that repeat a doc_id are judged each by their own text, and
    are no repeats of each other. Rows without doc_id neither lose words nor make others lose any. Other columns are
    ignored.
    """
    every = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).alias("_text"))
    texts, row = every.filter("doc_id is not null"), ["doc_id", "of"]
    survey = materialise(_survey(texts, window), drop_shuffles=True).filter(F.col("n_words") >= window)
    classes = materialise(survey.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("least")), drop_shuffles=True)
    # the first rows of each class stand for it; all others are copies
    tagged = materialise(join_back(survey.select(*row, "seq_a", "seq_b"), classes, ["seq_a", "seq_b"]).select(*row, "seq_a", (F.col("doc_id") > F.col("least")).alias("_copy")).distinct(), drop_shuffles=True)
    halves = survey.select(F.explode("halves").alias("half"), "seq_a")
    twice = halves.groupBy("half").agg(F.min("seq_a").alias("a"), F.max("seq_a").alias("b")).filter("a < b").select("half")
    listed = join_back(halves, twice, ["half"]).groupBy("seq_a").agg(F.collect_set("half").alias("_halves"))
    wanted = materialise(tagged.filter("NOT _copy").join(listed, "seq_a").groupBy(*row).agg(F.first("_halves").alias("_halves")), drop_shuffles=True)
    found = _full_windows(texts.join(wanted.hint("shuffle_hash"), row).select(*row, "_text", "_halves"), window)
    least = found.groupBy("win_a", "win_b").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("win_a", "win_b", "a")
    repeats = join_back(found, least, ["win_a", "win_b"]).filter("doc_id > a").groupBy(*row).agg(F.collect_set("at").alias("_at"))
    marks = repeats.join(tagged.filter("_copy").select(*row, "_copy"), row, "full_outer")
    marked = texts.join(marks.hint("shuffle_hash"), row, "left")
    nothing = F.array().cast("array<int>")
    ready = marked.select("doc_id", "_text", F.coalesce("_at", nothing).alias("_at"), F.coalesce("_copy", F.lit(False)).alias("_copy"))
    without = every.filter("doc_id is null").select("doc_id", "_text", nothing.alias("_at"), F.lit(False).alias("_copy"))
    return _remove(ready.unionByName(without), window)


#: The result of remove_repeats() in SQL, with the kept words as a digest.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (g) WHERE m < doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
