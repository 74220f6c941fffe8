"""Sharding by a k-d tree over metadata, in DataFrame functions only.

A node that must give k shards is split where its weight parts as floor(k/2) : ceil(k/2), along the metadata
dimension that is widest within the node. The split is the weighted quantile of a 63-bit coordinate. The low bits
of a coordinate are a hash of the row, so a value that holds a third of all rows can be split anywhere.

1. Nodes of more rows than a task should hold are split by counting: the weight of each of a few hundred cells of the
   range, then of the cells of the cell that holds the quantile, until that cell is lighter than a thousandth of a
   shard. Rows carry only their coordinates and weight in these passes.
2. Rows are dealt once by the nodes that are left, and running sums in the order of the widest coordinate split these
   to the last leaf: every level is two windows over what a task holds already, however many leaves there are.

What comes to the driver is the tree, one node for each split, and CELLS cells for a pass. A row finds its leaf by
walking the tree, held in literal arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed_rank, materialise

DIMENSIONS = ("source", "lang", "size", "doc")
#: Cells counted in a pass over all nodes, and bits of a coordinate that hold the dimension's value.
CELLS, VALUE_BITS, TIE_BITS = 1 << 15, 31, 32
#: Rows of a node that one task splits to the last leaf: at least so many, and at least this part of all rows.
LOCAL_ROWS, LOCAL_PARTS = 1 << 14, 1 << 12


@dataclass
class _Node:
    shards: int
    first: int
    axis: int = -1
    split: int = 0
    low: int = -1
    high: int = -1


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def _coordinates(df: DataFrame, text: str) -> list[Column]:
    """A coordinate in each dimension; absent columns and nulls lie at 0."""
    whole = F.lit(float((1 << VALUE_BITS) - 1))
    named = [F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")).cast("double") / float(1 << 32), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in ("source", "lang")]
    values = [*named, F.log2(_size(text).cast("double")) / 63.0, F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)]
    tie = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))), F.lit(1 << TIE_BITS))
    return [F.shiftleft((v * whole).cast("long"), TIE_BITS).bitwiseOR(tie).alias(f"x{k}") for k, v in enumerate(values)]


def _literal(values: list[int]) -> Column:
    """Whole numbers as one literal array, whatever their number is."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _leaf(nodes: list[_Node], depth: int) -> Column:
    """The number of the node that a row reaches after ``depth`` splits."""
    axis, split, low, high = (_literal([getattr(n, name) for n in nodes]) for name in ("axis", "split", "low", "high"))
    keys = F.array(*[F.col(f"x{k}") for k in range(len(DIMENSIONS))])

    def descend(at: Column, _: Column) -> Column:
        x = F.get(keys, F.greatest(F.get(axis, at), F.lit(0)).cast("int"))
        return F.when(F.get(axis, at) < 0, at).when(x <= F.get(split, at), F.get(low, at)).otherwise(F.get(high, at)).cast("int")

    # a lambda binds the node once for each level; nested expressions would grow with a power of the depth
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), descend) if depth else F.lit(0)


def _quantiles(rows: DataFrame, wanted: dict[int, tuple[int, int, int, int]], tolerance: float) -> dict[int, int]:
    """For each node (axis, low, high, weight to the left) the coordinate up to which that weight lies."""
    open_, out, before = dict(wanted), {}, dict.fromkeys(wanted, 0)
    while open_:
        per_node = max(2, CELLS // len(open_))
        numbered = sorted(open_)
        steps = {node: max(1, -(-(high - low + 1) // per_node)) for node, (_, low, high, _) in open_.items()}
        # the open nodes' axis, range and step, found by the node's place among them
        place = F.array_position(_literal(numbered), F.col("node").cast("long")).cast("int") - 1
        of = rows.select("size", "node", place.alias("place"), F.array(*[F.col(f"x{k}") for k in range(len(DIMENSIONS))]).alias("x")).filter("place >= 0")
        axis, low, high, step = (_literal(v) for v in ([open_[n][0] for n in numbered], [open_[n][1] for n in numbered], [open_[n][2] for n in numbered], [steps[n] for n in numbered]))
        here = of.select("size", "node", F.get("x", F.get(axis, "place").cast("int")).alias("x"), F.get(low, "place").alias("low"), F.get(high, "place").alias("high"), F.get(step, "place").alias("step"))
        cells = here.filter("x BETWEEN low AND high").groupBy("node", F.expr("CAST((x - low) DIV step AS INT)").alias("cell")).agg(F.sum("size").alias("w")).collect()
        weight: dict[int, list] = {node: [] for node in open_}
        for r in cells:
            weight[r["node"]].append((r["cell"], r["w"]))
        for node, found in weight.items():
            axis_no, low_x, high_x, goal = open_.pop(node)
            step_x, gone, last = steps[node], before[node], max(found)[0]
            for cell_no, w in sorted(found):
                end = min(high_x, low_x + (cell_no + 1) * step_x - 1)
                if gone + w >= goal or cell_no == last:
                    nearer_start = goal - gone < gone + w - goal
                    if step_x == 1 or w <= tolerance:
                        out[node] = low_x + cell_no * step_x - 1 if nearer_start else end
                    else:
                        open_[node], before[node] = (axis_no, low_x + cell_no * step_x, end, goal), gone
                    break
                gone += w
    return out


def _split(nodes: list[_Node], node: int, axis: int, split: int) -> list[int]:
    """Gives a node its split and two children; their numbers."""
    here = nodes[node]
    here.axis, here.split, left = axis, split, here.shards // 2
    here.low, here.high = len(nodes), len(nodes) + 1
    nodes += [_Node(left, here.first), _Node(here.shards - left, here.first + left)]
    return [here.low, here.high]


def build_tree(rows: DataFrame, shards: int, local_rows: int | None = None) -> tuple[list[_Node], int]:
    """The tree over rows (size, x0..x3), and its depth."""
    nodes, level, depth = [_Node(shards, 0)], [0], 0
    ranges = [F.expr(f"{f}(x{k})").alias(f"{f}{k}") for k in range(len(DIMENSIONS)) for f in ("min", "max")]
    whole = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *ranges).first()
    if not whole["w"] or shards == 1:
        return nodes, 0
    spread = [max((whole[f"max{k}"] >> TIE_BITS) - (whole[f"min{k}"] >> TIE_BITS), 1) for k in range(len(DIMENSIONS))]
    most = local_rows or max(LOCAL_ROWS, -(-whole["n"] // LOCAL_PARTS))
    local: list[int] = []
    while level:
        at = rows.withColumn("node", _leaf(nodes, depth))
        seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *ranges).collect()}
        local += [k for k in level if nodes[k].shards > 1 and k in seen and seen[k]["n"] <= most]
        level = [k for k in level if nodes[k].shards > 1 and k in seen and seen[k]["n"] > most]
        wanted = {}
        for node in level:
            r = seen[node]
            widths = [(r[f"max{k}"] >> TIE_BITS) - (r[f"min{k}"] >> TIE_BITS) for k in range(len(DIMENSIONS))]
            axis = max(range(len(widths)), key=lambda k: (widths[k] / spread[k], -k))
            wanted[node] = (axis, r[f"min{axis}"], r[f"max{axis}"], r["w"] * (nodes[node].shards // 2) // nodes[node].shards)
        splits = _quantiles(at.filter(F.col("node").isin(level)) if len(level) < 1000 else at, wanted, whole["w"] / shards / 1000) if wanted else {}
        level = [child for node in level for child in _split(nodes, node, wanted[node][0], splits[node])]
        depth += bool(level)
    if local:
        depth += _finish(rows.withColumn("node", _leaf(nodes, depth)), nodes, local, spread)
    return nodes, depth


def _finish(at: DataFrame, nodes: list[_Node], local: list[int], spread: list[int]) -> int:
    """Splits the ``local`` nodes of rows (size, x0..x3, node) to their last leaves; the levels that this takes."""
    levels = max((nodes[k].shards - 1).bit_length() for k in local)
    place = F.array_position(_literal(local), F.col("node").cast("long")).cast("int") - 1
    now = at.withColumn("place", place).filter("place >= 0")
    now = now.select("node", "size", *[f"x{k}" for k in range(len(DIMENSIONS))], F.get(_literal([nodes[k].first for k in local]), "place").alias("first"), F.get(_literal([nodes[k].shards for k in local]), "place").alias("k"), F.array().cast("array<struct<first:bigint,k:bigint,axis:int,x:bigint,left:boolean>>").alias("path"))
    now = now.repartition("node")  # every window below is over what the task has
    for _ in range(levels):
        within = Window.partitionBy("node", "first", "k")
        widths = [(F.shiftright(F.max(f"x{k}").over(within), TIE_BITS) - F.shiftright(F.min(f"x{k}").over(within), TIE_BITS)) / F.lit(float(spread[k])) for k in range(len(DIMENSIONS))]
        wide = now.select("*", F.array(*widths).alias("widths"), F.sum("size").over(within).alias("whole"))
        axis = (F.array_position("widths", F.array_max("widths")) - 1).cast("int")  # the first of equal ones
        chosen = wide.select(*now.columns, axis.alias("axis"), F.expr("whole * (k DIV 2) DIV k").alias("goal")).withColumn("x", F.get(F.array(*[F.col(f"x{k}") for k in range(len(DIMENSIONS))]), F.col("axis")))
        along = within.orderBy("x")
        sums = chosen.select("*", F.sum("size").over(along.rangeBetween(Window.unboundedPreceding, 0)).alias("to"), F.coalesce(F.sum("size").over(along.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        # equal coordinates stay together, on the side that leaves the weights nearer to the goal
        left = (F.col("to") <= F.col("goal")) | (F.col("before") < F.col("goal")) & (F.col("goal") - F.col("before") >= F.col("to") - F.col("goal"))
        open_, half = F.col("k") > 1, F.expr("k DIV 2")
        step = F.struct("first", "k", "axis", "x", left.alias("left"))
        now = sums.select("node", "size", *[f"x{k}" for k in range(len(DIMENSIONS))], F.when(open_ & ~left, F.col("first") + half).otherwise(F.col("first")).alias("first"), F.when(~open_, F.col("k")).when(left, half).otherwise(F.col("k") - half).alias("k"), F.when(open_, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"))
    steps = now.select("node", F.inline("path"))
    found = steps.groupBy("first", "k").agg(F.min("axis").alias("axis"), F.max(F.when(F.col("left"), F.col("x"))).alias("split")).collect()
    splits = {(r["first"], r["k"]): (r["axis"], -1 if r["split"] is None else r["split"]) for r in found}
    todo = list(local)
    while todo:
        node = todo.pop()
        if nodes[node].shards > 1:  # a node without rows is cut anywhere
            todo += _split(nodes, node, *splits.get((nodes[node].first, nodes[node].shards), (0, 0)))
    return levels


def shards_for(df: DataFrame, target_bytes: int, text: str = "text") -> int:
    """How many shards of about ``target_bytes`` the table fills."""
    total = df.agg(F.sum(_size(text)).alias("w")).first()["w"] or 0
    return max(1, -(-total // target_bytes))


def assign_shards(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, text: str = "text") -> DataFrame:
    """``df`` with shard (from 0) and size: UTF-8 bytes of the text (null: none) plus 8.

    Give the number of shards, or the bytes at which a leaf is small enough. Only rows equal in doc_id and
    text cannot be parted. Nulls in doc_id, source or lang, and absent columns, lie at one end of their
    dimension. An empty table has no rows in any shard.
    """
    shards = shards or shards_for(df, target_bytes or (1 << 30), text)
    names = {c: f"_in_{k}" for k, c in enumerate(df.columns) if c in ("size", "node", "shard", "slot", *[f"x{k}" for k in range(len(DIMENSIONS))])}
    keys = materialise(df.select(_size(text).alias("size"), *_coordinates(df, text)))
    nodes, depth = build_tree(keys, shards)
    first = _literal([n.first for n in nodes])
    own = df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
    placed = own.select("*", *_coordinates(own, text))
    out = placed.withColumn("shard", F.get(first, _leaf(nodes, depth)).cast("int")).withColumn("size", _size(text))
    return out.select(*[F.col(names.get(c, c)).alias(f"in_{c}" if c in names else c) for c in df.columns], "size", "shard")


def number_slots(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "text_crc32", "size"), along: str | None = None) -> DataFrame:
    """``df`` (shard and ``keys``) with slot: gapless from 0 within each shard, in an order set by a hash of the keys.

    With ``along``, a column of gapless positions from 0 over all rows, slots follow these instead. An input
    column slot is replaced; others are kept, whatever their names.
    """
    return bucketed_rank(df, F.col("shard"), [F.col(k) for k in keys], "slot", along=F.col(along) if along else None)
