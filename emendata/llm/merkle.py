"""Merkle manifest of a dataset, by an associative monoid of sparse forests.

A group's leaves are numbered by key; every run of ``arity`` neighbours has a parent, and the last run may be
shorter. Group roots, in the order of the groups, are the leaves of the tree above. A *forest* is the set of nodes
that are known and whose parents are not yet, each keyed by (tree, level, index). Two forests merge by union,
after which every run of siblings that is complete gives its parent; how many a run has follows from the number
of the tree's leaves, so that merging is associative and needs no order.

1. Rows are laid in ranges of (group, key, leaf). A range gives one forest; as it is a contiguous piece of the
   leaves, the forest has a few nodes for each level, whatever the range holds.
2. Forests merge by a tree reduction, FAN at a time. Its rounds are DataFrame aggregations and not
   RDD.treeReduce, which would drop the merged nodes that proofs need and end in the driver.
3. Each range reads the nodes beside its edges, and proves its leaves from these and its own.

The driver gets the root alone. A range holds at most about ROWS rows, so no task needs a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, materialise

#: Rows of a range, and forests that one step of the reduction merges.
ROWS, FAN = 1 << 18, 32
#: Rows whose proofs are built at once.
BATCH = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above all groups; the groups' own trees are numbered from 0.
ABOVE = -1

_NODES = "part long, tree long, n long, level int, idx long, digest string"
_PROVED = "doc string, lang string, leaf string, subroot string, root string, proof array<struct<at:int,siblings:array<string>>>, folded_root string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for a null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Tree:
    """Sizes of the levels of a tree over ``n`` leaves."""

    def __init__(self, n: int, arity: int):
        self.counts, self.arity = [n], arity
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // arity))

    def run(self, level: int, idx: int) -> range:
        """The siblings of a node, itself among them."""
        first = idx // self.arity * self.arity
        return range(first, min(first + self.arity, self.counts[level]))


class Piece:
    """The nodes over a contiguous piece of a tree's leaves: level by level a range of whole nodes."""

    def __init__(self, tree: int, n: int, first: int, leaves: list[str], arity: int):
        self.tree, self.n, self.shape = tree, n, Tree(n, arity)
        self.levels = [(first, leaves)]
        for level in range(len(self.shape.counts) - 1):
            low, nodes = self.levels[-1]
            above = -(-low // arity)  # the first parent that has no child before the piece
            end = above
            parents = []
            while nodes and end < self.shape.counts[level + 1] and (run := self.shape.run(level, end * arity)).stop <= low + len(nodes):
                parents.append(digest(*nodes[run.start - low : run.stop - low]))
                end += 1
            self.levels.append((above, parents))

    def get(self, level: int, idx: int) -> str | None:
        low, nodes = self.levels[level]
        return nodes[idx - low] if low <= idx < low + len(nodes) else None

    @property
    def root(self) -> str | None:
        return self.get(len(self.shape.counts) - 1, 0)

    def open_nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        """(tree, n, level, idx, digest) of the nodes whose parent is not in the piece."""
        for level, (low, nodes) in enumerate(self.levels):
            above, parents = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            a, b = above * self.shape.arity, (above + len(parents)) * self.shape.arity
            for k in [*range(low, min(a, low + len(nodes))), *range(max(b, low), low + len(nodes))] if parents else range(low, low + len(nodes)):
                yield self.tree, self.n, level, k, nodes[k - low]


def forest(pieces: list[Piece], trees: int, arity: int) -> list[tuple[int, int, int, int, str]]:
    """The open nodes of the pieces of a range: neighbouring trees, of which the first and last may be partial."""
    out, roots, first = [], [], None
    for piece in pieces:
        if piece.root is None:
            out += piece.open_nodes()
        else:
            first = piece.tree if first is None else first
            roots.append(piece.root)
    return out + (list(Piece(ABOVE, trees, first, roots, arity).open_nodes()) if roots else [])


def merge(nodes: list[tuple[int, int, int, int, str]], trees: int, arity: int) -> list[tuple[int, int, int, int, str, bool]]:
    """The nodes that complete runs of ``nodes`` give, level by level, and whether each is still open at the end.

    Given nodes that stay open are returned too.
    """
    shapes: dict[int, Tree] = {}
    known, made, closed = {(t, level, k): (n, d) for t, n, level, k, d in nodes}, set(), set()
    todo = list(known)
    while todo:
        tree, level, idx = todo.pop()
        n, d = known[tree, level, idx]
        shape = shapes.get(tree) or shapes.setdefault(tree, Tree(n, arity))
        if level == len(shape.counts) - 1:
            if tree == ABOVE:
                continue
            parent, value, children = (ABOVE, 0, tree), (trees, d), [(tree, level, idx)]
        else:
            children = [(tree, level, k) for k in shape.run(level, idx)]
            if not all(c in known for c in children):
                continue
            parent, value = (tree, level + 1, idx // arity), (n, digest(*[known[c][1] for c in children]))
        if parent not in known:
            known[parent] = value
            made.add(parent)
            closed.update(children)
            todo.append(parent)
    return [(k[0], known[k][0], k[1], k[2], known[k][1], k not in closed) for k in known if k in made or k not in closed]


def _laid(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, g, at, doc, lang, leaf, claim) in ranges of (g, key, leaf), and how many rows there are.

    Equal rows are told apart by their place in the checkpointed leaves, so that any number of them is spread.
    """
    leaves = materialise(keys)
    rows = leaves.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    order = ["g", F.col("key").asc_nulls_first(), "leaf", "place"]
    placed = leaves.withColumn("place", F.monotonically_increasing_id())
    laid = materialise(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place", "key"))
    of = F.monotonically_increasing_id()
    return laid.select("*", F.shiftright(of, 33).alias("part"), of.bitwiseAND((1 << 33) - 1).alias("at")), rows


def _segments(laid: DataFrame) -> DataFrame:
    """(part, g, first, n, rank, size): the leaf at which a group's piece begins, the group's leaves and rank, the piece's leaves.

    A window over parts has one row for each range, of ROWS rows, and group.
    """
    pieces = laid.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"), F.sum("size").over(whole).alias("n"))
    firsts = materialise(firsts.withColumn("begins", (F.col("first") == 0).cast("long")))
    starts = firsts.groupBy(F.col("part").alias("_part")).agg(F.sum("begins").alias("s"))
    earlier = starts.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.sum("begins").over(Window.partitionBy("part").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    return materialise(firsts.join(earlier, F.col("part") == F.col("_part")).select("part", "g", "first", "n", (F.col("earlier") + within - 1).alias("rank"), "size"))


def _by_part(laid: DataFrame, segments: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All that a range needs, in the order in which it is read: nodes beside it, then each piece and its leaves.

    ``kind`` is 0 for a node, 1 for a piece, 2 for a leaf.
    """
    no_text, no_long = F.lit(None).cast("string"), F.lit(0).cast("long")
    rows = laid.select("part", "g", F.lit(2).alias("kind"), "at", no_long.alias("tree"), no_long.alias("n"), F.lit(0).alias("level"), "doc", "lang", "leaf", "claim")
    pieces = segments.select("part", "g", F.lit(1), F.col("first"), F.col("rank"), "n", F.lit(0), no_text, no_text, no_text, no_text)
    out = rows.union(pieces)
    if nodes is not None:
        out = out.union(nodes.select("part", F.lit(""), F.lit(0), F.col("idx"), "tree", "n", "level", no_text, no_text, F.col("digest"), no_text))
    return out.repartition("part").sortWithinPartitions("part", F.when(F.col("kind") == 0, 0).otherwise(1), "g", "kind", "at")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], list[tuple[dict, list[dict]]]]]:
    """(part, nodes, pieces with their leaves) for each range of a task."""
    part, nodes, pieces = None, [], []
    for batch in batches:
        for of, _, kind, at, tree, n, level, doc, lang, leaf, claim in zip(*[c.to_pylist() for c in batch.columns]):
            if of != part:
                if part is not None:
                    yield part, nodes, pieces
                part, nodes, pieces = of, [], []
            if kind == 2:
                pieces[-1][1].append((doc, lang, leaf, claim))
            elif kind == 1:
                pieces.append(({"tree": tree, "n": n, "at": at}, []))
            else:
                nodes.append({"tree": tree, "level": level, "at": at, "leaf": leaf})
    if part is not None:
        yield part, nodes, pieces


def _forests(dealt: DataFrame, trees: int, arity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, pieces in _parts(batches):
            built = [Piece(p["tree"], p["n"], p["at"], [leaf for _, _, leaf, _ in rows], arity) for p, rows in pieces]
            found = forest(built, trees, arity)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int64()), *[pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))]], names=["part", "tree", "n", "level", "idx", "digest"])

    return dealt.mapInArrow(run, _NODES)


def _tree_reduce(forests: DataFrame, trees: int, arity: int) -> DataFrame:
    """Every node of the forests and of their merged forests; the root is among them."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[["tree", "n", "level", "idx", "digest"]].itertuples(index=False, name=None)
        out = pd.DataFrame(merge(list(rows), trees, arity), columns=["tree", "n", "level", "idx", "digest", "open"])
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    nodes, now = [forests], forests
    parts = forests.agg(F.max("part").alias("m")).first()["m"]
    while True:
        merged = materialise(now.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInPandas(step, _NODES + ", open boolean"))
        nodes.append(merged.drop("open"))
        now, parts = merged.filter("open").drop("open"), parts // FAN
        if not parts:
            break
    every = nodes[0]
    for more in nodes[1:]:
        every = every.union(more)
    return every.drop("part").distinct()  # an open node is returned again in each round


def _wanted(segments: DataFrame, trees: int, arity: int) -> DataFrame:
    """(part, tree, level, idx) of the runs at the edges of each piece, and of each range's trees in the tree above."""
    partial = segments.filter("size < n").select("part", F.col("rank").alias("tree"), "n", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    above = segments.groupBy("part").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).select("part", F.lit(ABOVE).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), "first", "last")
    edges = partial.union(above).select("part", "tree", "n", F.explode(F.array("first", "last")).alias("leaf"))
    levels = edges.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int"))).alias("level"))
    levels = levels.withColumn("span", F.pow(F.lit(float(arity)), F.col("level") + 1).cast("long"))
    run = F.expr("leaf div span") * arity
    return levels.select("part", "tree", "level", F.explode(F.sequence(run, run + (arity - 1))).alias("idx")).distinct()


def _prove(dealt: DataFrame, trees: int, arity: int, root: str) -> DataFrame:
    shape_above = Tree(trees, arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, pieces in _parts(batches):
            beside = {(r["tree"], r["level"], r["at"]): r["leaf"] for r in nodes}
            built = [Piece(p["tree"], p["n"], p["at"], [leaf for _, _, leaf, _ in rows], arity) for p, rows in pieces]
            for b in built:
                if b.root is not None:
                    beside[ABOVE, 0, b.tree] = b.root
            whole = [b for b in built if b.root is not None]
            over = Piece(ABOVE, trees, whole[0].tree, [b.root for b in whole], arity) if whole else None
            for b, (_, rows) in zip(built, pieces):
                upper = _path(shape_above, b.tree, lambda level, k: over.get(level, k) if over and over.get(level, k) else beside[ABOVE, level, k], {}, 0)
                subroot = b.root or beside[ABOVE, 0, b.tree]
                first, cache = b.levels[0][0], {}

                def get(level, k, b=b):
                    return b.get(level, k) or beside[b.tree, level, k]

                for low in range(0, len(rows), BATCH):
                    part = rows[low : low + BATCH]
                    proofs = [[*_path(b.shape, first + low + i, get, cache, 0), *upper] for i in range(len(part))]
                    folded = [fold(claim or leaf, proof) for (_, _, leaf, claim), proof in zip(part, proofs)]
                    yield _batch(part, subroot, root, proofs, folded)

    return dealt.mapInArrow(run, _PROVED)


def _batch(rows: list[tuple], subroot: str, root: str, proofs: list[list[tuple[int, list[str]]]], folded: list[str]) -> pa.RecordBatch:
    steps = [step for proof in proofs for step in proof]
    siblings = pa.ListArray.from_arrays(_offsets([s for _, s in steps]), pa.array([d for _, s in steps for d in s], pa.string()))
    struct = pa.StructArray.from_arrays([pa.array([at for at, _ in steps], pa.int32()), siblings], names=["at", "siblings"])
    text = [pa.array(c, pa.string()) for c in ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [subroot] * len(rows), [root] * len(rows))]
    return pa.RecordBatch.from_arrays([*text, pa.ListArray.from_arrays(_offsets(proofs), struct), pa.array(folded, pa.string())], names=["doc", "lang", "leaf", "subroot", "root", "proof", "folded_root"])


def _offsets(lists: list[list]) -> pa.Array:
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    return pa.array(ends, pa.int32())


def _path(shape: Tree, idx: int, get, cache: dict, level: int) -> list[tuple[int, list[str]]]:
    """(place in the run, siblings) for each level from the node to its tree's root."""
    if level == len(shape.counts) - 1:
        return []
    if (have := cache.get((level, idx))) is not None:
        return have
    run = shape.run(level, idx)
    here = [(idx - run.start, [get(level, k) for k in run if k != idx]), *_path(shape, idx // shape.arity, get, cache, level + 1)]
    if level:
        cache[level, idx] = here
    return here


def fold(leaf: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof give."""
    for at, siblings in proof:
        leaf = digest(*siblings[:at], leaf, *siblings[at:])
    return leaf


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, claim: Column | None = None, arity: int = 2) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded_root, verified) for every row of ``df``.

    A leaf is the digest of ``fields``; absent columns count as null. Leaves of a group ascend by key, null keys
    first, equal keys by leaf; rows that are equal in all fields have neighbouring leaves. Groups ascend by the
    bytes of their names, the null group first. A proof has for each level the place in the run and the siblings,
    from the leaf via the group's root to the root. ``claim`` is the leaf that is to be verified instead of the
    row's own, where it is not null. An empty table has no rows and no root. Other columns are ignored, whatever
    their names.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    shape = f"{key} {kind.simpleString()}, {group} string, leaf string, subroot string, root string, proof array<struct<at:int,siblings:array<string>>>, folded_root string, verified boolean"
    of = [F.col(f) if f in df.columns else F.lit(None).cast("string") for f in fields]
    name = F.col(group).cast("string") if group in df.columns else F.lit(None).cast("string")
    keys = df.select(F.coalesce(F.concat(F.lit("1"), name), F.lit("")).alias("g"), F.col(key).alias("key"), F.col(key).cast("string").alias("doc"), name.alias("lang"), leaf_of(*of).alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    laid, rows = _laid(df, keys)
    if not rows:
        return spark.createDataFrame([], shape)
    segments = _segments(laid)
    trees = segments.agg(F.max("rank").alias("m")).first()["m"] + 1
    forests = materialise(_forests(_by_part(laid, segments), trees, arity))
    nodes = materialise(_tree_reduce(forests, trees, arity))
    root = nodes.filter((F.col("tree") == ABOVE) & (F.col("level") == len(Tree(trees, arity).counts) - 1)).first()["digest"]
    wanted = _wanted(segments, trees, arity)
    # a subroot that is not in its range's own piece is a node of the tree above
    beside = wanted.join(nodes, ["tree", "level", "idx"]).select("part", "tree", "n", "level", "idx", "digest")
    proved = _prove(_by_part(laid, segments, beside), trees, arity, root)
    return proved.select(F.col("doc").cast(kind).alias(key), F.col("lang").alias(group), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The manifest of documents, with proofs as digests and the stated tampering, in SQL.
ORACLE = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, {{leaf}} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {{tampered}} ELSE {{leaf}} END AS claim FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), levels AS (
    SELECT lang, 0 AS level, i AS k, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lang, level + 1, k // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY k)) FROM levels WHERE n > 1 GROUP BY lang, level, n, k // 2
), subroots AS (
    SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM levels WHERE n = 1
), above AS (
    SELECT 0 AS level, i AS k, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, k // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY k)) FROM above WHERE n > 1 GROUP BY level, n, k // 2
), nodes AS (
    SELECT lang, level, k, h FROM levels
), steps AS (
    SELECT l.doc_id, l.leaf, l.lang, l.i AS own, s.subroot, t.level, (l.i >> t.level) & 1 AS side, o.h AS sibling
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, unnest(range(0, s.height)) AS t(level)
    LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = t.level AND o.k = xor(l.i >> t.level, 1)
    UNION ALL
    SELECT l.doc_id, l.leaf, l.lang, l.i, s.subroot, s.height + t.level, (s.i >> t.level) & 1, o.h
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, unnest(range(0, (SELECT max(level) FROM above))) AS t(level)
    LEFT JOIN above o ON o.level = t.level AND o.k = xor(s.i >> t.level, 1)
), proofs AS (
    SELECT lang, own, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM steps GROUP BY lang, own
), folded AS (
    SELECT lang, i AS own, 0 AS level, claim AS h FROM leaves
    UNION ALL
    SELECT f.lang, f.own, f.level + 1, sha256(CASE WHEN side = 1 THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
    FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.own = f.own AND s.level = f.level
), ends AS (
    SELECT lang, own, arg_max(h, level) AS h FROM folded GROUP BY lang, own
)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT max_by(h, level) FROM above) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
    e.h AS folded_root, e.h = (SELECT max_by(h, level) FROM above) AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.own = l.i
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.own = l.i
"""


def _leaf_sql(changed: str | None = None) -> str:
    parts = [f"coalesce(strlen(v{k}) || ':' || v{k}, '-')".replace(f"v{k}", f"(({f} + 1)::VARCHAR)" if f == changed else f"({f}::VARCHAR)") for k, f in enumerate(FIELDS)]
    return f"sha256({' || '.join(parts)})"


ORACLE = ORACLE.format(leaf=_leaf_sql(), tampered=_leaf_sql("n_chars"))
