"""Manifests against a plain Merkle tree; the monoid's laws; tampering."""

import random
from hashlib import sha256

import pytest
from emendata.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, k, arity):
    out = []
    for level in levels[:-1]:
        first = k // arity * arity
        out.append((k - first, [x for i, x in enumerate(level[first : first + arity]) if i != k - first]))
        k //= arity
    return out


def leaf(row):
    doc, source, lang, n, text = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def brute(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]], arity) for g in names}
    above = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for i, g in enumerate(names):
        for k, row in enumerate(groups[g]):
            out.append((row[0], leaf(row), trees[g][-1][0], above[-1][0], siblings(trees[g], k, arity) + siblings(above, i, arity)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(k, rng.choice(["s", None]), rng.choice(["de", "en", "en", "en", "fr", "é", "z", None]), rng.choice([None, k]), f"text {k} ü") for k in range(150)]
    return made + [made[5]] * 40 + [(None, None, None, None, None), (None, "s", "en", 1, None), (1009, "s", "only", 2, "")]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_plain_trees(spark, rows, arity):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part string, at int").repartition(3)
    got = merkle.manifest(df, arity=arity).collect()
    shaped = sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, [(s.at, list(s.siblings)) for s in r.proof]) for r in got)
    assert shaped == sorted((repr(d), *rest) for d, *rest in brute(rows, arity))
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_tampered_rows_do_not_verify(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = merkle.leaf_of(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(df, claim=F.when(F.col("doc_id") % 3 == 0, changed)).collect()
    empty = {r[0] for r in rows if r[3] is None}
    for r in got:
        assert r.verified == (r.doc_id is None or r.doc_id % 3 > 0 or r.doc_id in empty) == (r.folded_root == r.root)


def test_small_and_empty_tables(spark):
    shape = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], shape)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, "en", 2, "a")], shape)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf((1, None, "en", 2, "a")) and one.proof == [] and one.verified
    bare = merkle.manifest(spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()  # absent columns are null
    assert {r.leaf for r in bare} == {leaf((k, None, None, None, None)) for k in (1, 2)} and all(r.verified for r in bare)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_merging_forests_is_associative(arity):
    rng = random.Random(arity)
    for n in (1, 2, 7, 40, 81):
        sizes = [n, 1, 2 * n]
        leaves = [[h(str(g), str(k)) for k in range(m)] for g, m in enumerate(sizes)]
        root = tree([tree(x, arity)[-1][0] for x in leaves], arity)[-1][0]
        forests = []
        for g, m in enumerate(sizes):
            cuts = sorted({0, m, *[rng.randrange(m + 1) for _ in range(4)]})
            forests += [merkle.forest([merkle.Piece(g, m, a, leaves[g][a:b], arity)], len(sizes), arity) for a, b in zip(cuts, cuts[1:])]
        for _ in range(3):
            rng.shuffle(forests)
            left = list(forests)
            while len(left) > 1:  # any two, in any order
                k = rng.randrange(len(left) - 1)
                left[k : k + 2] = [[x[:5] for x in merkle.merge(left[k] + left[k + 1], len(sizes), arity) if x[5]]]
            (only,) = left[0]
            assert only[0] == merkle.ABOVE and only[4] == root


def test_a_forest_has_few_nodes_for_each_level():
    piece = merkle.Piece(0, 1 << 20, 12345, [h(str(k)) for k in range(5000)], 2)
    assert len(list(piece.open_nodes())) < 30
