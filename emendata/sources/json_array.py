"""One JSON list of records, read by many tasks: a parallel prefix scan over the splits of its text.

Spark cuts a text file at any separator, here at each closing brace, so pieces are small and splits may begin
anywhere in the list. What a split does to the reader's state is a function with two cases, for it may begin within a
string or outside; a piece never ends behind a backslash.

1. Each split gives its function: where it leaves the string state, and by how much it changes the depth, in either case.
2. The functions of a file's splits are composed in their order, so that each split knows the state in which it begins.
3. Each split gives its whole records, and what lies before its first end and behind its last one. These fragments are
   put together; a record may run over many splits.

A file's text is shuffled only for the records at the edges of its splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: States of at most this many splits are broadcast; more are joined by a shuffle.
MOST_SPLITS = 1_000_000
_MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\],]', re.DOTALL)
_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.DOTALL)


def marks(piece: str, inside: bool) -> tuple[list[tuple[int, str]], bool]:
    """(place, mark) of what stands outside strings in a piece that may begin within one, and whether it ends within one."""
    at = 0
    if inside:
        m = _STRING.match(piece)
        if not m[1]:
            return [], True
        at = m.end()
    out, within = [], False
    for m in _MARKS.finditer(piece, at):
        if piece[m.start()] == '"':
            within = not m[1]
        else:
            out.append((m.start(), m.group()))
    return out, within


def _steps(piece: str, inside: bool) -> tuple[int, bool]:
    found, within = marks(piece, inside)
    return sum(1 if c in "{[" else -1 if c in "}]" else 0 for _, c in found), within


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("piece"), F.monotonically_increasing_id().alias("at"))


def _functions(pieces: DataFrame) -> DataFrame:
    """(file, block, depth and string state after the split: begun outside, and begun within a string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, [0, False, 0, True]
        for batch in batches:
            for key, piece in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if key != now:
                    if now:
                        yield _row(now, state)
                    now, state = key, [0, False, 0, True]
                for k in (0, 2):
                    step, within = _steps(piece, state[k + 1])
                    state[k], state[k + 1] = state[k] + step, within
        if now:
            yield _row(now, state)

    return pieces.select("file", "block", "piece").mapInArrow(run, "file string, block long, depth_out long, within_out boolean, depth_in long, within_in boolean")


def _row(key: tuple[str, int], state: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *state)], names=["file", "block", "depth_out", "within_out", "depth_in", "within_in"])


def _composed(splits: pd.DataFrame) -> pd.DataFrame:
    """(file, block, depth, within) with which each split of one file begins."""
    out, depth, within = [], 0, False
    for r in splits.sort_values("block").itertuples(index=False):
        out.append((r.file, r.block, depth, within))
        depth, within = (depth + r.depth_in, r.within_in) if within else (depth + r.depth_out, r.within_out)
    if within or depth != -1:  # a brace was put behind the last piece as well
        raise ValueError(f"{splits['file'].iloc[0]} is no whole JSON list")
    return pd.DataFrame(out, columns=["file", "block", "depth", "within"])


#: What a fragment is: a whole record; the begin, a middle part or the end of one that runs over splits.
WHOLE, BEGIN, MIDDLE, END = range(4)


def _fragments(pieces: DataFrame) -> DataFrame:
    """(file, block, n, kind, text) from pieces with the depth and string state of their split's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            rows: list[tuple] = []
            for file, block, piece, depth, within in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, block) != now:
                    if reader:
                        rows += reader.rest()
                    now, reader = (file, block), _Reader(file, block, depth, within)
                rows += reader.read(piece)
            yield _batch(rows)
        if reader:
            yield _batch(list(reader.rest()))

    return pieces.select("file", "block", "piece", "depth", "within").mapInArrow(run, "file string, block long, n long, kind int, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "block", "n", "kind", "text"])


class _Reader:
    """Records of a split, a piece at a time."""

    def __init__(self, file: str, block: int, depth: int, within: bool):
        self.key, self.depth, self.within, self.n = (file, block), depth, within, 0
        self.open = depth > 1 or within  # a record that an earlier split began
        self.parts: list[str] = []
        self.over = False

    def read(self, piece: str) -> Iterator[tuple]:
        found, self.within = marks(piece, self.within)
        begin = 0
        for at, c in found:
            if self.over:
                break
            if self.depth == 0:
                if c != "[" or piece[:at].strip(" \t\r\n\ufeff"):
                    raise ValueError(f"{self.key[0]} is no JSON list")
                self.depth, begin = 1, at + 1
                continue
            if self.depth == 1 and c in ",]":
                yield from self.done(piece[begin:at])
                begin = at + 1
                if c == "]":
                    self.depth, self.over = 0, True
            elif c in "{[":
                self.depth += 1
            elif c in "}]":
                self.depth -= 1
        if not self.over:
            self.parts.append(piece[begin:])
        elif piece[begin:].strip("} \t\r\n"):
            raise ValueError(f"{self.key[0]} goes on behind its list")

    def done(self, last: str) -> Iterator[tuple]:
        text = "".join([*self.parts, last])
        self.parts = []
        if self.open or text.strip():
            yield (*self.key, self.n, END if self.open else WHOLE, text)
            self.n += 1
        self.open = False

    def rest(self) -> Iterator[tuple]:
        text = "".join(self.parts)
        closed = self.depth == 1 and not self.within  # behind a brace nothing of the record is left
        if self.open or text.strip():
            yield (*self.key, self.n, (END if closed else MIDDLE) if self.open else WHOLE if closed else BEGIN, text)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _n, value): the text of each element of the JSON lists in ``path``, in the order of these numbers.

    Elements may hold anything, but only closing braces part a text, so a list without any is one piece. Blank
    lists have no elements. A file that is no whole list fails the read.
    """
    pieces = _pieces(spark, path)
    states = _functions(pieces).groupBy("file").applyInPandas(_composed, "file string, block long, depth long, within boolean")
    n = pieces.select("file", "block").distinct().count()
    if n <= MOST_SPLITS:
        ready = pieces.join(F.broadcast(states), ["file", "block"])
    else:
        ready = pieces.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    fragments = _fragments(ready)
    whole = fragments.filter(F.col("kind") == WHOLE).select("file", "block", "n", "text")
    parts = fragments.filter(F.col("kind") != WHOLE)
    # a record's parts lie behind one another: those up to its end have as many ends before them
    order = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("record", F.coalesce(F.sum((F.col("kind") == END).cast("long")).over(order), F.lit(0)))
    part = F.struct("block", "n", "text")
    joined = placed.groupBy("file", "record").agg(F.min(F.struct("block", "n")).alias("first"), F.array_sort(F.collect_list(part)).alias("parts"))
    mended = joined.select("file", "first.block", "first.n", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return whole.union(mended).select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("n").alias("_n"), F.col("text").alias("value"))


def read_records(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The records of the JSON lists in ``path``, with _file, _block and _n; one that is broken fails the read."""
    parsed = F.from_json("value", StructType.fromDDL(ddl), {"mode": "FAILFAST"})
    return read_elements(spark, path).select(parsed.alias("_row"), "_file", "_block", "_n").select("_row.*", "_file", "_block", "_n")
