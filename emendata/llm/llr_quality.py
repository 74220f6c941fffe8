"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials, one of all trusted
texts and one of the whole raw corpus, give each bucket a log ratio; a text's ratio is the mean over its
n-grams. Every text is kept or not by comparing that mean with one threshold, found among the ratios of all
labelled texts. Nothing is sampled; what comes to the driver is a count for each bucket and for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import held_out, kept_fields, materialise

BUCKETS = 1 << 16
#: Fixed values of the base rules.
SYMBOL_CHARACTERS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOL_CHARACTERS.encode())] = True
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: textscan.Texts) -> dict[str, np.ndarray]:
    """The five counts of each text; find_words() and word_hash() of the texts stay with them."""
    texts.find_words()
    words = texts.hashes = texts.word_hash()
    data, n = texts.data, len(texts)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[texts.starts] += 1
    np.subtract.at(inside, texts.ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lead = (data & 0xC0) != 0x80
    # windows of three words that occur twice or more in their text
    window, at = textscan.windows(texts, words, REPEAT_WINDOW)
    again = _repeated(texts.text[at], window)
    covered = np.zeros(len(words) + REPEAT_WINDOW, bool)
    for k in range(REPEAT_WINDOW):
        covered[at[again] + k] = True
    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(texts.offsets[:-1], breaks + 1)
    line_ends = np.union1d(texts.offsets[1:], breaks)
    line_starts = line_starts[line_starts < len(data)]
    # a text that is empty or ends in a break has no last line with a word
    edges = np.unique(np.concatenate([line_starts, texts.offsets[-1:]]))
    starts = edges[:-1]
    next_break = np.searchsorted(breaks, starts)
    stop = np.where(next_break < len(breaks), breaks[np.minimum(next_break, max(len(breaks) - 1, 0))] if len(breaks) else len(data), len(data))
    ends = np.minimum(stop, edges[1:])
    has_word = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_text = np.searchsorted(texts.offsets, starts, "right") - 1
    line = texts.span_hash(starts, ends)
    order = np.lexsort((line, line_text))
    same = np.zeros(len(order), bool)
    same[1:] = (line[order][1:] == line[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
    return {
        "n_words": texts.counts.astype(np.int64),
        "word_chars": texts.sums(inside & lead),
        "n_symbols": texts.sums(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_text[order][same], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(texts.text[covered[: len(words)]], minlength=n).astype(np.int64),
    }


def _repeated(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their text."""
    order = np.lexsort((value, text))
    v, t = value[order], text[order]
    equal = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    out = np.zeros(len(order), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def ngram_buckets(texts: textscan.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of words; needs base_counts() first."""
    pair, at = textscan.windows(texts, texts.hashes, 2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([texts.hashes >> shift, pair >> shift]).astype(np.int64), np.concatenate([texts.text, texts.text[at]])


@dataclass(frozen=True)
class QualityModel:
    log_ratio: np.ndarray
    threshold: float


def corpus_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """N-grams of all rows by bucket: one partial vector for each task, summed by bucket on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, texts in textscan.chunks(batch.column(0)):
                texts.find_words()
                texts.hashes = texts.word_hash()
                total += np.bincount(ngram_buckets(texts)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def mean_ratios(texts: textscan.Texts, log_ratio: np.ndarray) -> np.ndarray:
    """The length-normalised log-likelihood ratio of each text, 0 without words; needs base_counts() first."""
    bucket, text = ngram_buckets(texts)
    total = np.bincount(text, log_ratio[bucket], len(texts))
    return total / np.maximum(np.bincount(text, minlength=len(texts)), 1)


def log_ratios(df: DataFrame, trusted: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """The log ratio of each bucket: all texts of ``trusted`` against all of ``df``; 0 where there are no trusted words."""
    target = corpus_counts(trusted)
    if not target.any():
        return np.zeros(BUCKETS)
    raw = corpus_counts(df)
    return np.log((target + smoothing) / (target.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))


def threshold(graded: DataFrame, lose: float = 0.01) -> float:
    """The least ratio to keep, from (quality, llr) of all labelled texts: it loses at most ``lose`` of the trusted.

    Of such thresholds it is the one that best parts quality 1 from quality 0 (Youden's index). Without trusted
    texts every text passes. Distinct ratios are dealt to ranges; numbers of texts below a ratio are a running
    sum within its range and the totals of the ranges before, of which there is one for each partition.
    """
    spark = graded.sparkSession
    one = (F.col("quality") == 1).cast("long")
    counted = graded.groupBy("llr").agg(F.sum(one).alias("good"), F.sum(1 - one).alias("low"))
    values = materialise(counted.repartitionByRange("llr").withColumn("part", F.spark_partition_id()))
    parts = values.groupBy("part").agg(F.min("llr").alias("first"), F.sum("good").alias("good"), F.sum("low").alias("low")).collect()
    before, n_good, n_low = [], 0, 0
    for r in sorted(parts, key=lambda r: r["first"]):
        before.append((r["part"], n_good, n_low))
        n_good, n_low = n_good + r["good"], n_low + r["low"]
    if not n_good:
        return -np.inf
    within = Window.partitionBy("part").orderBy("llr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = values.select("*", F.sum("good").over(within).alias("good_here"), F.sum("low").over(within).alias("low_here"))
    placed = running.join(F.broadcast(spark.createDataFrame(before, "part int, good_before long, low_before long")), "part")
    ranked = placed.select("llr", "good", "low", (F.col("good_before") + F.col("good_here")).alias("good_to"), (F.col("low_before") + F.col("low_here")).alias("low_to"))
    highest = ranked.filter((F.col("good") > 0) & (F.col("good_to") > int(lose * n_good))).agg(F.min("llr")).first()[0]
    cuts = ranked.filter((F.col("llr") == highest) | ((F.col("low") > 0) & (F.col("llr") < highest)))
    gain = F.col("low_to") / F.lit(max(n_low, 1)) - (F.col("good_to") - F.col("good")) / F.lit(n_good)
    best = cuts.orderBy(gain.desc(), "llr").first()
    if best["good"]:
        return best["llr"]
    return (best["llr"] + ranked.filter(F.col("llr") > best["llr"]).agg(F.min("llr")).first()[0]) / 2


def fit(df: DataFrame, trusted: DataFrame | list[str], other: DataFrame | list[str], lose: float = 0.01, smoothing: float = 1.0) -> QualityModel:
    """Ratios from all trusted texts against all of ``df``, and the threshold() between trusted and other texts.

    Texts come as a table with a column text, or as a list. Without trusted words all ratios are 0.
    """
    trusted, other = (x if isinstance(x, DataFrame) else df.sparkSession.createDataFrame([(t,) for t in x], "text string") for x in (trusted, other))
    open_ = QualityModel(log_ratios(df, trusted, smoothing), -np.inf)
    graded = [judge(x, open_, keep=(F.lit(q).alias("quality"),)).select("quality", "llr") for q, x in ((1, trusted), (0, other))]
    return QualityModel(open_.log_ratio, threshold(graded[0].unionByName(graded[1]), lose))


def judge(df: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the five counts, base_failed, llr (mean log ratio) and kept for every row.

    A null or empty text has no words, fails the base rules and is not kept. Repeated rows are judged each.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    wanted = df.select(*keep, F.col(text).alias("_text"))
    labels, width = wanted.columns[: len(keep)], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, texts in textscan.chunks(batch.column(width)):
                counts = base_counts(texts)
                llr = mean_ratios(texts, model.log_ratio)
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(low, high - low) for k in range(width)], *[pa.array(counts[c]) for c in BASE_COLUMNS], pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= model.threshold))],
                    names=[*labels, *BASE_COLUMNS, "base_failed", "llr", "kept"],
                )

    more = ", ".join(f"{c} long" for c in BASE_COLUMNS)
    return wanted.mapInArrow(run, kept_fields(wanted, len(keep), f"{more}, base_failed boolean, llr double, kept boolean"))


def quality_rules(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from every labelled row (doc_id, quality) that is not held out, and judge every row of ``df``.

    See judge() for the result. A document with labels of both kinds is learned from as both. Texts are read
    once for their ratios; these serve the threshold and the result, so that only trusted texts are joined. The
    hints keep the plan the same at every size: labels of a small table would else be broadcast.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality").distinct()
    written = df.filter(F.col("text").isNotNull() & ~held_out()).select("doc_id", "text")
    trusted = written.join(labels.filter((F.col("quality") == 1) & ~held_out()).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    open_ = QualityModel(log_ratios(df, trusted), -np.inf)
    scores = materialise(judge(df, open_, keep=("doc_id", F.col("text").isNotNull().alias("_written"))).drop("kept"))
    at_least = threshold(scores.filter(F.col("_written") & ~held_out()).join(usable.hint("merge"), "doc_id").select("quality", "llr"))
    return scores.select("doc_id", *BASE_COLUMNS, "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= at_least)).alias("kept"))
