"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks. Block j of a source of weight w is released at slot floor(j / w) and due by
ceil((j + 1) / w); of the released blocks the one with the earliest deadline takes the next slot. As the
weights sum to one, no deadline is missed, and at every slot each source has had its weight's share of the
slots to within one block. When a source is used up, the others share its weight and start anew.

The schedule is made on the driver from the number of blocks of each source; blocks grow with the corpus so
that there are at most MOST_BLOCKS and one for each source; up to twice MOST_BLOCKS are broadcast. All rows are placed; none is dropped or repeated.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed_rank, materialise, text_key

MOST_BLOCKS = 1 << 18
LEAST_BLOCK_ROWS = 16
#: The heaviest source's weight as a whole number.
UNIT = 1 << 30


def schedule(blocks: dict[str, int], weights: dict[str, float], fan: int = 1024) -> list[tuple[str, int]]:
    """(source, block) for each slot. Sources without a positive weight follow when the others are used up.

    More than ``fan`` sources are dealt to groups of so many, heaviest first, each with the weights of its members:
    the slots are dealt to groups, and a group's slots to its members, within one block at either step.
    """
    if len(blocks) <= fan:
        return _flat(blocks, weights)
    ordered = sorted((s for s, n in blocks.items() if n), key=lambda s: (-max(weights.get(s, 0), 0), s))
    n_groups = -(-len(ordered) // fan)
    members = [ordered[g::n_groups] for g in range(n_groups)]
    inner = [iter(_flat({s: blocks[s] for s in m}, weights)) for m in members]
    names = {f"{g:012d}": g for g in range(len(members))}
    outer = schedule({name: sum(blocks[s] for s in members[g]) for name, g in names.items()}, {name: sum(max(weights.get(s, 0), 0) for s in members[g]) for name, g in names.items()}, fan)
    return [next(inner[names[name]]) for name, _ in outer]


def _flat(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int]]:
    """The schedule of a few sources; whenever one is used up, a phase with the others begins."""
    names = sorted(s for s, n in blocks.items() if n)
    # weights as whole numbers, so that releases and deadlines are exact
    heaviest = max((weights.get(s, 0) for s in names), default=0)
    whole = np.array([max(1, round(weights.get(s, 0) / heaviest * UNIT)) if weights.get(s, 0) > 0 else 0 for s in names], np.int64)
    left, done, out = np.array([blocks[s] for s in names], np.int64), [0] * len(names), []
    while left.any():
        active = np.flatnonzero((left > 0) & (whole > 0))
        share = whole[active]
        if not len(active):
            active = np.flatnonzero(left > 0)
            share = np.ones(len(active), np.int64)
        taken = _phase(share, left[active], out_of := [])
        for k in out_of:
            source = active[k]
            out.append((names[source], done[source]))
            done[source] += 1
        left[active] -= taken
    return out


def _phase(share: np.ndarray, left: np.ndarray, slots: list[int]) -> np.ndarray:
    """Appends the source of each slot until one is used up: earliest deadline first among what is released, ties in order.

    All first blocks are released at once, so they are sorted by their deadlines, and only later blocks go through heaps.
    """
    total = int(share.sum())
    first = -(-total // share)
    order = np.lexsort((np.arange(len(share)), first))
    weight, fresh, at = share.tolist(), order.tolist(), 0
    due = first.tolist()
    waiting: list[tuple[int, int]] = []
    ready: list[tuple[int, int]] = []
    turn: dict[int, int] = {}
    slot, taken = 0, np.zeros(len(share), np.int64)
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(turn[k] + 1) * total // weight[k]), k))
        new = (due[fresh[at]], fresh[at]) if at < len(fresh) else None
        if ready and (new is None or ready[0] < new):
            _, k = heapq.heappop(ready)
        elif new is not None:
            k, at = new[1], at + 1
        else:
            slot = waiting[0][0]
            continue
        slots.append(k)
        taken[k] += 1
        if taken[k] == left[k]:
            return taken
        turn[k] = turn.get(k, 0) + 1
        slot += 1
        heapq.heappush(waiting, (turn[k] * total // weight[k], k))


def tempered_weights(rows: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of the sources' sizes: below 1 they favour small sources."""
    raw = {s: n**power for s, n in rows.items()}
    total = sum(raw.values()) or 1.0
    return {s: v / total for s, v in raw.items()}


def mix(df: DataFrame, weights: dict[str, float] | None = None, block_rows: int | None = None, source: str = "source", keys: tuple[str | Column, ...] = ("doc_id",), ties: tuple[str | Column, ...] = ()) -> DataFrame:
    """``df`` with mix_block, mix_slot and mix_position (gapless from 0): the order in which to read it.

    Within a source rows follow a hash of ``keys`` and ``ties``, then these themselves; ties spread rows of one
    key, as of none. Weights default to tempered_weights(). A null source is a source of its own, named "".
    Equal rows take neighbouring places. An empty table stays empty. Input columns with the names of the new
    ones are replaced; all others are kept, whatever their names.
    """
    base = df.select(F.struct("*").alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), *[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate((*keys, *ties))])
    counts = {r["source"]: r["n"] for r in base.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    size = block_rows or max(LEAST_BLOCK_ROWS, -(-total // MOST_BLOCKS))
    blocks = {s: -(-n // size) for s, n in counts.items()}
    order = schedule(blocks, weights or tempered_weights(counts))
    start, at = [], 0
    for s, j in order:  # the last block of a source may be short
        start.append(at)
        at += min(size, counts[s] - j * size)
    plan = pa.table({"_s": pa.array([s for s, _ in order], pa.string()), "_j": pa.array([j for _, j in order], pa.int64()), "mix_slot": pa.array(range(len(order)), pa.int64()), "start": pa.array(start, pa.int64())})
    placed = df.sparkSession.createDataFrame(plan)
    ranked = bucketed_rank(base, F.col("source"), [F.col(f"k{i}") for i in range(len(keys) + len(ties))], "rank")
    with_block = ranked.withColumn("mix_block", F.expr(f"rank div {size}"))
    joined = with_block.join(F.broadcast(placed) if len(order) <= 2 * MOST_BLOCKS else placed, (F.col("source") == F.col("_s")) & (F.col("mix_block") == F.col("_j")))
    position = F.col("start") + F.col("rank") - F.col("mix_block") * size
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ("mix_block", "mix_slot", "mix_position")]
    return joined.select(*kept, "mix_block", "mix_slot", position.alias("mix_position"))


def mixed(df: DataFrame, weights: dict[str, float] | None = None, block_rows: int | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df`` laid out in mixed order: partitions are ranges of the order, sorted within.

    Rows equal in doc_id and text lie together. Those without doc_id are told apart by their texts.
    """
    keyed = materialise(df.select("doc_id", source, text_key(text).alias("key")))
    placed = mix(keyed, weights, block_rows, source, ties=("key",))
    lone = placed.groupBy(F.col("doc_id").alias("_mix_doc"), F.col("key").alias("_mix_key")).agg(F.min("mix_position").alias("_mix_at"))
    ordered = df.join(lone, df["doc_id"].eqNullSafe(F.col("_mix_doc")) & text_key(text).eqNullSafe(F.col("_mix_key")), "left")
    return ordered.repartitionByRange("_mix_at").sortWithinPartitions("_mix_at").select(*[df[c] for c in df.columns])
