"""Toxicity by compression distance: two zstandard dictionaries and the lengths of compressed windows.

One dictionary is trained on ordinary text. The other is trained on the passages of toxic text whose byte
5-grams are found significantly more often in toxic than in ordinary documents, and is laid behind the
ordinary one, so that both compressors know ordinary text equally well. Every text is cut into half
overlapping windows; each is compressed with both, and what the toxic dictionary saves tells how much the
window is like toxic text. A logistic curve over the savings of a document, fitted on the labelled sample,
calibrates them to a score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import hash_unit, held_out, kept_fields

WINDOW, STRIDE, LEVEL, GRAM = 32, 16, 9, 5
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
THRESHOLD = 0.3
#: Savings of a window, in bytes, from which on windows are counted.
CUTS = range(2, 10)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_compressors: dict[str, tuple] = {}  # of the last model that this worker has seen


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0] + [0.0] * (len(CUTS) + 3)))


def _lowered(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def _grams(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    size = max(len(data) - GRAM + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | data[k : k + size]
    return out


def _document_frequency(texts: list[bytes], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Each gram and the number of texts that hold it; some texts at a time, as their grams outweigh them by far."""
    gram, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for low in range(0, len(texts), at_once):
        new, n = np.unique(np.concatenate([np.unique(_grams(x)) for x in texts[low : low + at_once]]), return_counts=True)
        known, place = np.unique(np.concatenate([gram, new]), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, np.concatenate([count, n]))
        gram, count = known, total
    return gram, count


def _telling_grams(toxic: list[bytes], ordinary: list[bytes], z_least: float = 7.0, foremost: int = 60) -> np.ndarray:
    """5-grams of toxic texts that are over-represented by at least ``z_least`` standard deviations, and the ``foremost`` of all.

    Grams across two words are left out, as they hold more of the neighbours than of the word, and so are those
    with marks or digits: they tell of layout.
    """
    gram, a = _document_frequency(toxic)
    b = np.zeros(len(gram), np.int64)
    for text in ordinary if len(gram) else []:  # only grams of toxic texts matter, so no others are kept
        found = np.unique(_grams(text))
        at = np.searchsorted(gram, found).clip(0, len(gram) - 1)
        b[at[gram[at] == found]] += 1
    n, m = max(len(toxic), 1), max(len(ordinary), 1)
    share = (a + b) / (n + m)
    z = (a - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    plain = np.ones(len(gram), bool)
    for k in range(GRAM):
        byte = ((gram >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        plain &= _LETTER[byte] | (_BLANK[byte] if k in (0, GRAM - 1) else False)
    usable = plain & (a >= 3) & ((a + 0.5) / n >= 10 * (b + 0.5) / m)
    highest = np.sort(z[usable])[-foremost:].min(initial=np.inf)
    return np.sort(gram[usable & (z >= min(z_least, highest))])


def _passages(text: bytes, telling: np.ndarray) -> list[bytes]:
    """The runs of a text that telling 5-grams cover."""
    hit = np.flatnonzero(np.isin(_grams(text), telling))
    edge = np.zeros(len(text) + 2, np.int64)
    np.add.at(edge, hit + 1, 1)
    np.add.at(edge, hit + 1 + GRAM, -1)
    inside = (np.cumsum(edge) > 0).astype(np.int8)
    turns = np.flatnonzero(np.diff(inside))
    return [text[a:b] for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the last bytes of the samples where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _pair(model: ToxicityModel) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for content in (model.ordinary, model.ordinary + model.toxic):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) >= 8:
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            options["dict_data"] = trained
        out.append(zstandard.ZstdCompressor(**options))
    return out[0], out[1]


def _lengths(compressor: zstandard.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
    done = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
    return np.fromiter(map(len, done), np.int64, len(done))


def _features(texts: list[str | None], pair: tuple) -> np.ndarray:
    """For each text: 1, its largest saving, the sum of its three largest, the share of windows that save CUTS or more, and its windows."""
    out = np.zeros((len(texts), len(CUTS) + 4))
    out[:, 0] = 1
    low = 0
    while low < len(texts):
        parts, starts, sizes, owner, total, high = [], [], [], [], 0, low
        while high < len(texts) and (high == low or total < textscan.CHUNK_BYTES):
            if texts[high]:
                part = _lowered(texts[high])
                at = np.arange(0, max(len(part) - STRIDE, 1), STRIDE)
                parts.append(part)
                starts.append(at + total)
                sizes.append(np.minimum(WINDOW, len(part) - at))
                owner.append(np.full(len(at), high))
                total += len(part)
            high += 1
        low = high
        if not parts:
            continue
        data, of = b"".join(parts), np.concatenate(owner)
        segments = np.stack([np.concatenate(starts), np.concatenate(sizes)], 1).astype("<u8").tobytes()
        saved = _lengths(pair[0], data, segments) - _lengths(pair[1], data, segments)
        ranked = np.maximum(saved[np.lexsort((-saved, of))], 0)
        ids, first, n = np.unique(of, return_index=True, return_counts=True)
        out[ids, 1] = ranked[first]
        for k in range(3):
            out[ids, 2] += np.where(n > k, ranked[np.minimum(first + k, len(of) - 1)], 0)
        for k, cut in enumerate(CUTS):
            out[ids, 3 + k] = np.log1p(50 * np.add.reduceat((saved >= cut).astype(np.int64), first) / n)
        out[ids, -1] = np.log(n)
    return out


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Without texts of either kind every score is that of the curve's start, below the threshold."""
    if not toxic or not ordinary:
        return ToxicityModel()
    low_toxic, low_ordinary = [_lowered(x) for x in toxic], [_lowered(x) for x in ordinary]
    telling = _telling_grams(low_toxic, low_ordinary)
    passages = [p for x in low_toxic for p in _passages(x, telling)]
    trained = _dictionary([x[k : k + 256] for x in low_ordinary for k in range(0, len(x), 256)], ORDINARY_BYTES)
    model = ToxicityModel(trained, _dictionary([b"".join(passages[k : k + 8]) for k in range(0, len(passages), 8)], TOXIC_BYTES))
    pair = _pair(model)
    x = np.concatenate([_features(toxic, pair), _features(ordinary, pair)])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(ordinary))])
    middle, spread = x.mean(0), x.std(0)
    middle[0], spread[spread == 0] = 0, 1
    scaled = (x - middle) / spread
    weights, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(60):  # Newton's steps for a logistic curve with a small ridge
        p = 1 / (1 + np.exp(-(scaled @ weights).clip(-30, 30)))
        weights = weights + np.linalg.solve((scaled * (p * (1 - p))[:, None]).T @ scaled + ridge, scaled.T @ (y - p) - ridge @ weights)
    weights = weights / spread
    weights[0] -= weights[1:] @ middle[1:]
    return ToxicityModel(model.ordinary, model.toxic, weights)


def scores(texts: list[str | None], model: ToxicityModel, pair: tuple) -> np.ndarray:
    return (1 / (1 + np.exp(-(_features(texts, pair) @ model.weights).clip(-30, 30)))).round(9)


def labelled_sample(df: DataFrame, labels: DataFrame, toxic_rows: int = 2000, ordinary_rows: int = 4000, seed: int = 31) -> tuple[list[str], list[str], float]:
    """Whole texts of about that many toxic and ordinary rows outside the held-out fold, and the rate of toxic rows.

    The bounded sample of labels is broadcast to the corpus; only the sampled texts come to the driver.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, toxic_rows / max(sizes.get(1, 0), 1)))).otherwise(F.lit(min(1.0, ordinary_rows / max(sizes.get(0, 0), 1))))
    chosen = usable.filter(hash_unit(seed, "doc_id") < rate)
    rows = df.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    return [t for t, k in zip(texts, toxic, strict=True) if k == 1], [t for t, k in zip(texts, toxic, strict=True) if k == 0], share


def score(df: DataFrame, labels: DataFrame, toxic_rows: int = 2000, ordinary_rows: int = 4000, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, score and predicted (1 from THRESHOLD on) for every row of ``df``.

    Null and empty texts have no window and get the score of a document without savings. Repeated rows are
    scored each; a document with labels of both kinds is learned from as both. The curve's start is moved from the sample's share of toxic rows to that of all labels.
    """
    toxic, ordinary, share = labelled_sample(df, labels, toxic_rows, ordinary_rows)
    model = fit(toxic, ordinary)
    if toxic and ordinary:
        start = model.weights.copy()
        start[0] += np.log(share / (1 - share)) - np.log(len(toxic) / len(ordinary))
        model = ToxicityModel(model.ordinary, model.toxic, start)
    spark = df.sparkSession
    shared, model_id = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    wanted = df.select(*keep, F.col(text).alias("_text"))

    labels, width = wanted.columns[: len(keep)], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model_id not in _compressors:
            _compressors.clear()
            _compressors[model_id] = _pair(model)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                value = scores(part.column(width).to_pylist(), model, _compressors[model_id])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(width)], pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=[*labels, "score", "predicted"])

    return wanted.mapInArrow(run, kept_fields(wanted, len(keep), "score double, predicted int"))
