"""Language identification by prediction by partial matching.

A bounded sample of labelled texts gives each language a byte context tree of orders 0 to 3. The statistics
are frozen, so the code length of every (context, byte) follows from the tree: escape method C, where a
context with N bytes, D of them distinct, gives a seen byte n / (N + D) and leaves D / (N + D) to the next
shorter context; order -1 is uniform. A text's score in a language is the exact sum of these code lengths
over all its bytes, and the shortest code wins.

Contexts are runs of whole bytes, and every context of the sample is kept. A context holds 256 bits that tell
which bytes follow it in any language, and the code lengths of those in each language lie one behind the
other; a byte that is not among them costs the context's escape and is looked for in the next shorter one.
So the tables are as large as what the sample holds, whatever the number of languages and scripts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import hash_unit, held_out, kept_fields

ORDERS = 4
#: Code lengths that are gathered at once while texts are scored.
GATHERED = 1 << 22
UNDETERMINED = "und"
#: A table of more languages is not broadcast.
BROADCAST_LANGUAGES = 100_000
_tables: dict[str, object] = {}  # of the last model that this worker has seen


@dataclass(frozen=True)
class LanguageModel:
    """Counts of the sample: a code is three bytes of context and the one that follows."""

    languages: tuple[str, ...]
    codes: np.ndarray
    counts: np.ndarray


@dataclass(frozen=True)
class CodeTables:
    """Row 0 is the empty context; by_order[k] gives the row of a context of k bytes, 0 where it was not seen."""

    by_order: list[np.ndarray]
    parent: np.ndarray
    escape: np.ndarray
    followers: np.ndarray
    first: np.ndarray
    bits: np.ndarray


def _contexts(texts: textscan.Texts) -> np.ndarray:
    """The three bytes before each byte, the nearest lowest; a text begins after three zeros."""
    data = texts.data.astype(np.int64)
    context = np.zeros(len(data), np.int64)
    for back in (1, 2, 3):
        context[back:] |= data[:-back] << (8 * (back - 1))
    starts, size = texts.offsets[:-1], np.diff(texts.offsets)
    for at in range(3):
        here = (starts + at)[size > at]
        context[here] &= (1 << (8 * at)) - 1
    return context


def fit(texts: dict[str, list[str]]) -> LanguageModel:
    languages = tuple(sorted(texts))
    found = []
    for name in languages:
        column = textscan.as_texts(pa.array(texts[name], pa.large_string()))
        found.append(np.unique((_contexts(column) << 8) | column.data, return_counts=True))
    codes = np.unique(np.concatenate([c for c, _ in found])) if found else np.zeros(0, np.int64)
    counts = np.zeros((len(codes), len(languages)), np.float32)
    for k, (code, count) in enumerate(found):
        counts[np.searchsorted(codes, code), k] = count
    return LanguageModel(languages, codes, counts)


def code_lengths(model: LanguageModel) -> CodeTables:
    """The tables of a model, order by order: a byte that a language lacks in a context costs its escape and the shorter context's price."""
    n = len(model.languages)
    by_order, parents, escapes, followers, firsts, bits = [], [], [], [], [], []
    rows, cells = 0, 0
    codes_before, price_before = np.arange(256), np.full((256, n), 8.0)
    for order in range(ORDERS):
        code, at = np.unique(model.codes & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        count = np.zeros((len(code), n))
        np.add.at(count, at, model.counts)
        context, place = np.unique(code >> 8, return_inverse=True)
        total, distinct = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(total, place, count)
        np.add.at(distinct, place, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            shorter = price_before[np.searchsorted(codes_before, code & ((1 << (8 * max(order, 1))) - 1))]
            price = np.where(count > 0, np.log2((total + distinct)[place] / count), escape[place] + shorter)
        lookup = np.zeros(1 << (8 * order), np.int32)  # pages of contexts that were never seen stay untouched
        lookup[context] = rows + np.arange(len(context), dtype=np.int32)
        parents.append(by_order[-1][context & ((1 << (8 * (order - 1))) - 1)] if order else np.zeros(len(context), np.int32))
        byte = code & 255
        mask = np.zeros((len(context), 4), np.uint64)
        np.bitwise_or.at(mask, (place, byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
        held = np.bitwise_count(mask).astype(np.int64)
        start = cells + np.concatenate([[0], np.cumsum(held.ravel())])[:-1]
        by_order.append(lookup)
        escapes.append(escape)
        followers.append(mask.ravel())
        firsts.append(start)
        bits.append(price)
        rows, cells = rows + len(context), cells + len(code)
        codes_before, price_before = code, price
    return CodeTables(by_order, np.concatenate(parents), np.concatenate(escapes).astype(np.float32), np.concatenate(followers), np.concatenate(firsts), np.concatenate(bits).astype(np.float32))


def _prices(byte: np.ndarray, context: np.ndarray, tables: CodeTables) -> np.ndarray:
    """Bits of each byte after its context, in each language."""
    row = tables.by_order[3][context]
    for order in (2, 1):
        none = np.flatnonzero(row == 0)
        row[none] = tables.by_order[order][context[none] & ((1 << (8 * order)) - 1)]
    out = np.zeros((len(byte), tables.bits.shape[1]), np.float32)
    todo = np.arange(len(byte))
    for _ in range(ORDERS):
        cell, bit = row.astype(np.int64) * 4 + (byte >> 6), (byte & 63).astype(np.uint64)
        mask = tables.followers[cell]
        seen = (mask >> bit) & np.uint64(1) == 1
        place = tables.first[cell] + np.bitwise_count(mask & ((np.uint64(1) << bit) - np.uint64(1)))
        if len(todo) == len(out):
            out[seen] = tables.bits[place[seen]]
        else:
            out[todo[seen]] += tables.bits[place[seen]]
        if seen.all():
            return out
        lost = ~seen
        todo, byte, row = todo[lost], byte[lost], row[lost]
        out[todo] += tables.escape[row]
        if not row.any():  # only the empty context was left
            out[todo] += np.float32(8)
            return out
        root = row == 0
        if root.any():
            out[todo[root]] += np.float32(8)
            todo, byte, row = todo[~root], byte[~root], row[~root]
        row = tables.parent[row]
    return out


def _score(texts: textscan.Texts, tables: CodeTables) -> np.ndarray:
    """Code length of each text in each language, in bits; bytes are priced in blocks that bound the memory."""
    n = tables.bits.shape[1]
    out = np.zeros((len(texts), n))
    context = _contexts(texts)
    step = max(1, GATHERED // max(n, 1))
    for low in range(0, len(context), step):
        high = min(low + step, len(context))
        cost = _prices(texts.data[low:high].astype(np.int64), context[low:high], tables)
        some = np.flatnonzero((texts.offsets[1:] > low) & (texts.offsets[:-1] < high) & (np.diff(texts.offsets) > 0))
        out[some] += np.add.reduceat(cost, np.maximum(texts.offsets[:-1][some], low) - low, axis=0, dtype=np.float64)
    return out


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred, score (the posterior under equal priors), n_bytes and code_bits (of the best).

    Null texts and texts without a letter get ``und`` and score 0. Ties go to the first language by name.
    """
    spark = df.sparkSession
    shared, model_id = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    wanted = df.select(*keep, F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    labels, width = wanted.columns[: len(keep)], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model_id not in _tables:
            _tables.clear()
            _tables[model_id] = code_lengths(model) if model.languages else None
        tables = _tables[model_id]
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            column = batch.column(width)
            letter = np.asarray(batch.column(width + 1).to_numpy(zero_copy_only=False), bool)
            if model.languages:
                cost = np.concatenate([np.zeros((0, len(model.languages))), *[_score(x, tables) for _, _, x in textscan.chunks(column)]])
                best = cost.argmin(1)
                least = cost.min(1)
                score = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(1)
            else:
                best, least, score, letter = np.zeros(len(column), int), np.zeros(len(column)), np.zeros(len(column)), np.zeros(len(column), bool)
            size = np.diff(textscan.as_texts(column).offsets)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(width)], pa.array(np.where(letter, names[best], UNDETERMINED), pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(size.astype(np.int64)), pa.array(np.where(letter, least, 0.0))],
                names=[*labels, "lang_pred", "score", "n_bytes", "code_bits"],
            )

    return wanted.mapInArrow(run, kept_fields(wanted, len(keep), "lang_pred string, score double, n_bytes long, code_bits double"))


def training_sample(df: DataFrame, rows_per_language: int = 1500, most_rows: int = 12_000, seed: int = 17) -> dict[str, list[str]]:
    """About ``rows_per_language`` whole texts of each language outside the held-out fold.

    Rows are chosen by a hash of doc_id, at a rate that the language's row count sets; ``most_rows`` bounds
    the sample over all languages. This is the only part of the corpus that comes to the driver.
    """
    usable = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    aim = min(rows_per_language, max(1, most_rows // len(sizes)))
    rates = df.sparkSession.createDataFrame([(name, min(1.0, aim / n)) for name, n in sizes.items()], "_lang string, _rate double")
    rates = F.broadcast(rates) if len(sizes) <= BROADCAST_LANGUAGES else rates
    chosen = usable.join(rates, F.col("lang") == F.col("_lang")).filter(hash_unit(seed, "doc_id") < F.col("_rate"))
    rows = chosen.select("lang", "doc_id", "text").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    out: dict[str, list[str]] = {}
    for name, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True):
        out.setdefault(name, []).append(text)
    return out


def identify(df: DataFrame, rows_per_language: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_bytes, code_bits for every row of ``df``.

    Learns from text and lang of rows that are not held out. Null or empty texts: ``und``, score 0. Without
    any labelled row every text is ``und``. Repeated rows are scored each; other columns are ignored.
    """
    model = fit(training_sample(df, rows_per_language))
    out = predict(df, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_bytes", "code_bits")
