"""Golden rows and properties of the functions that parse programs or compare outputs."""

import ast
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from emendata.functions import code, compare, extract, mutate, prompts, similarity, stemmer, syntax, templates
from emendata.operators import grading, harness, passk
from emendata.plans import mutations
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tests import plain_mutations

SOURCE = "def f(a, b=1):\n    '''Doc.'''\n    total = 0\n    for i in range(len(a)):\n        if a[i] > 2 and not b:\n            total += a[i - 1] * 3\n            break\n    return sorted([x for x in a if x], reverse=True)\n"


@pytest.mark.parametrize("n, c, k, want", [(10, 3, 1, 0.3), (10, 3, 5, 0.916667), (10, 0, 5, 0.0), (5, 5, 1, 1.0), (4, 1, 1, 0.25), (3, 1, 5, 1.0), (1, 0, 5, 1.0)])
def test_pass_at_k(spark, n, c, k, want):
    row = spark.createDataFrame([(n, c)], "n int, c int").select(F.round(passk.pass_at_k(F.col("n"), F.col("c"), k), 6).alias("p")).first()
    assert row.p == want


def test_verdict_folding(spark):
    rows = spark.createDataFrame([([1, 1],), ([1, -2],), ([-1],), ([],)], "codes array<int>")
    got = rows.select(passk.all_passed(F.col("codes")).alias("a"), passk.verified(F.col("codes")).alias("v")).collect()
    assert [(r.a, r.v) for r in got] == [(True, 1), (False, 0), (False, 0), (True, 0)]


def test_reward(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.0), (1, 0.2), (None, 0.0)], "p int, d double")
    assert [round(r.r, 6) for r in rows.select(grading.reward(F.col("p"), [F.col("d")]).alias("r")).collect()] == [-0.2, 0.1, -0.1, -0.2]


def test_complexities():
    assert code.complexities("def g(a, b): return a and b") == (2, 1)
    assert code.complexities("def f(a, b):\n if a and b:\n  for x in a: return x\n return 0") == (3, 3)
    assert code.complexities("def h(a): return [x for x in a if x]") == (3, 2)
    assert code.complexities("") == code.complexities("def (") == code.complexities(None) == (None, None)
    assert code.complexities("try:\n a()\nexcept E:\n b()\nfinally:\n c()") == (3, 1)
    assert code.complexities("match x:\n case 1:\n  y = a and b\n case _:\n  z = 1") == (5, 4)


def test_standard_form():
    assert code.standardise("def f(a, b):\n    # note\n    return a+b\n") == "def f(a, b):\n    return a + b"
    assert code.standardise("  ") == "  "
    assert code.standardise(code.standardise(SOURCE)) == code.standardise(SOURCE)
    assert code.standardise("x = 'a # b' # c\n  bad(") == "x = 'a # b'\n  bad("


def test_tokens_and_bodies():
    assert code.code_tokens("x = 1\n") == ["x", "=", "1", "\n"] == code.code_tokens("x = 1  # c\n")
    assert code.code_tokens("x = 1") == ["x", "=", "1", ""]
    assert code.function_body(SOURCE).startswith("    total = 0")
    assert code.function_body("def f():\n    'only'\n") == ""
    assert code.function_body("def f(a):\n    return a\n").startswith("def f(a):")
    assert code.insert_docstring("def f(a):\n    pass\n", "'''d'''") == "def f(a):\n    '''d'''\n    pass\n"


def test_responses():
    two = "Hi\n```python\nx=1\n```\nand\n```\nyy=22\n```\n"
    assert code.response_code(two) == "yy=22"
    assert code.response_code("plain text, no code") == "" and code.response_code("x = 1") == "x = 1"
    assert code.response_code("say\n```python\nopen(") == "open("
    assert code.response_code("<think>\n```python\nlonger = 12345\n```\n</think>\n```python\na=1\n```") == "a=1"


def test_extraction_expressions(spark):
    two = "Hi\n```python\nx=1\n```\nand\n```\nyy=22\n```\n"
    rows = spark.createDataFrame([(two,), ("none",), ("```python\nopen",)], "t string")
    got = rows.select(extract.last_block(F.col("t")).alias("last"), extract.longest_block(F.col("t")).alias("longest")).collect()
    assert [(r.last, r.longest) for r in got] == [("yy=22", "yy=22"), (None, ""), (None, "open")]


def test_blocks_of_model_styles(spark):
    texts = ["a\n```Python\nx\n```\nb\n```\ny\n```", "```python\nopen\nend", "```\n1\n```\n```\n2\n```", "one ``` only", "[PYTHON]\nz\n[/PYTHON]", "no"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", extract.between_last_fences(F.col("t")).alias("a"), extract.between_last_fences(F.col("t"), "llama").alias("b"), extract.between_last_fences(F.col("t"), "base").alias("c"), extract.assert_line(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.a for r in got] == ["x", "open\nend", "2", "", "", ""]
    assert [r.b for r in got] == ["y", "", "2", "", "z", ""]
    assert [r.c for r in got] == texts
    assert [r.d for r in got] == ["x", "", "1", "", "", ""]


def test_execution_answers(spark):
    texts = ["[ANSWER]\nassert f(1) == 2\n[/ANSWER] x", "f(1) == 3\nmore", "4\n5", "think == no [ANSWER] f() == 6 [/ANSWER]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.a for r in rows.select(extract.execution_answer(F.col("t"), steps=True).alias("a")).collect()] == ["2", "3", "4", "6"]
    assert [r.a for r in rows.select(extract.execution_answer(F.col("t")).alias("a")).collect()] == ["2", "3", "4", "no [ANSWER] f()"]


def test_structured_diff():
    assert code.structured_diff("a", "a") == [{"type": "context", "content": "a"}] and code.structured_diff("", "") == []
    assert code.structured_diff("a\nb", "a\nc") == [{"type": "context", "content": " a"}, {"type": "removed", "content": "b"}, {"type": "added", "content": "c"}]
    assert code.structured_diff("a\n", "a") == [{"type": "removed", "content": "a"}, {"type": "added", "content": "a"}]
    assert code.structured_diff("\n".join("ab" * 600), "x") == [{"type": "summary", "content": "Files too large for diff. Reference: 1200 lines, Prediction: 1 lines"}]


def plain_pairs(a, b):
    """Whether places are a common subsequence, for any list of them."""
    return lambda found: all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_common_pairs_are_a_longest_common_subsequence(a, b):
    found = code.common_pairs(a, b)
    assert plain_pairs(a, b)(found) and len(found) == plain_common(a, b)


def test_changed_leaf_lines():
    base = "def f(a, b=2):\n    # note\n    x = a.b + 1\n    if x:\n        return [x, 'é']\n    return None\n"
    assert code.changed_leaf_lines(base, base) == 0
    assert code.changed_leaf_lines(base, base.replace("# note", "# other").replace("x = a.b + 1", "x=(a.b+1)")) == 0  # comments and layout are no leaves
    assert code.changed_leaf_lines(base, base.replace("a.b + 1", "a.c - 1")) == 1
    assert code.changed_leaf_lines(base, base.replace("b=2", "c=3").replace("None", "b")) == 2
    assert code.changed_leaf_lines("x = 1\n", "x = 1\ny = (2,\n 3)\n") == 2
    assert code.changed_leaf_lines("x = 1", "x = ") == -1 == code.changed_leaf_lines("(", "x")
    assert code.changed_leaf_lines("", "") == 0 and code.changed_leaf_lines("", "x = 1") == 1
    rng = random.Random(5)
    lines = ["a = 1", "b = a", "c(a, b)", "a += 2", "pass"]
    for _ in range(60):
        one, two = ([rng.choice(lines) for _ in range(rng.randrange(6))] for _ in range(2))
        found, leaves = code.changed_leaf_lines("\n".join(one), "\n".join(two)), [code.leaves("\n".join(x)) for x in (one, two)]
        labels = [[x for x, _, _ in side] for side in leaves]
        changed = sum(map(len, labels)) - 2 * plain_common(*labels)
        assert (found == 0) == (changed == 0) and found <= max(len(one), len(two))


def chunks(pairs):
    return sum(1 for k, (i, j) in enumerate(pairs) if not k or pairs[k - 1] != (i - 1, j - 1))


def every_alignment(ref, pred, synonyms, i=0, used=frozenset(), pairs=()):
    """(pairs of each stage, less than none, chunks) of all alignments."""
    if i == len(pred):
        stages = [0, 0, 0]
        for a, b in pairs:
            stages[0 if pred[a] == ref[b] else 1 if code._stem(pred[a]) == code._stem(ref[b]) else 2] -= 1
        yield (*stages, chunks(pairs))
        return
    yield from every_alignment(ref, pred, synonyms, i + 1, used, pairs)
    for j, w in enumerate(ref):
        if j not in used and (w == pred[i] or code._stem(w) == code._stem(pred[i]) or w in synonyms.get(pred[i], ())):
            yield from every_alignment(ref, pred, synonyms, i + 1, used | {j}, (*pairs, (i, j)))


def test_alignments_equal_exhaustive_search():
    rng = random.Random(2)
    words = ["run", "running", "cat", "dog", "the", "hound"]
    synonyms = {"dog": {"hound", "cat"}, "cat": {"the"}}
    for _ in range(250):
        ref, pred = ([rng.choice(words) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        found = code.align(ref, pred, synonyms)
        stages = [0, 0, 0]
        for a, b in found:
            stages[0 if pred[a] == ref[b] else 1 if code._stem(pred[a]) == code._stem(ref[b]) else 2] -= 1
        assert (*stages, chunks(found)) == min(every_alignment(ref, pred, synonyms)), (ref, pred)
    assert code.meteor_aligned("the hound sat", "the dog sat", {"dog": {"hound"}}) == pytest.approx(1 - 0.5 / 27)
    assert code.meteor_aligned("a b a c", "a c", {}) > code.meteor("a b a c", "a c")  # one chunk where the first places make two


def test_long_texts_against_themselves_have_the_fewest_chunks():
    rng = random.Random(5)
    for size in (300, 600):
        ref = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(size)]
        known = {f"zz9{w}": {w} for w in ref if w < "e"}
        hits = [i for i, w in enumerate(ref) if w < "e"]
        found = code.align(ref, [f"zz9{w}" for w in ref], known)
        fewest = sum(1 for i in hits if i - 1 not in hits)
        assert (len(found), chunks(found)) == (len(hits), fewest)
        want = len(hits) / size * (1 - 0.5 * (fewest / len(hits)) ** 3)
        assert code.meteor_aligned(" ".join(ref), " ".join(f"zz9{w}" for w in ref), known) == want


def test_meteor_with_a_table_of_synonyms(spark):
    rows = spark.createDataFrame([(1, "The hound sat", "the DOG sat"), (2, "a", None), (3, "x", "y"), (4, "", "")], "id int, a string, b string")
    known = spark.createDataFrame([("dog", "Hound"), ("dog", "cat"), (None, "x"), ("y", None), ("dog", "Hound")], "word string, synonym string")
    got = {r.id: r.meteor for r in similarity.meteor(rows, ["id"], "a", "b", known).collect()}
    assert got == {1: pytest.approx(1 - 0.5 / 27), 2: None, 3: 0.0, 4: 0.0}


def test_functions_by_name(spark):
    from emendata.functions import registry

    names = registry.register(spark)
    assert len(names) == len(set(names)) and {"diff_rows", "pass_at_k", "changed_leaf_lines"} <= set(names)
    rows = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, "x", None), (3, "x", "x")], "id int, before string, after string")
    got = spark.sql("SELECT id, d.* FROM {r} r, LATERAL diff_rows(r.before, r.after) d", r=rows).collect()
    assert sorted(map(tuple, got)) == sorted((r.id, k, d["type"], d["content"]) for r in rows.collect() if r.after for k, d in enumerate(code.structured_diff(r.before, r.after)))
    one = spark.sql("SELECT pass_at_k(10, 3, 5), pass_at_k(4, 1, 1), pass_at_k(3, 0, 5), changed_leaf_lines('x = 1', 'x = 2'), all_verified(array()), without_thought('<think>a</think> b')").first()
    assert list(one) == [pytest.approx(0.916667, abs=1e-6), 0.25, 1.0, 1, False, " b"]


def test_stems():
    words = "caresses ponies cats feed agreed plastered motoring sing conflated hopping falling filing happy sky relational conditional valenci electricity hopeful adoption controll roll generalizations oscillators"
    want = "caress poni cat feed agre plaster motor sing conflat hop fall file happi sky relat condit valenc electr hope adopt control roll gener oscil"
    assert [stemmer.stem(w) for w in words.split()] == want.split()


def test_text_metrics():
    assert code.rouge_l("the cats sat", "the cat sat") == pytest.approx(1.0) or code.rouge_l("the cats sat", "the cat sat") > 0.6
    assert code.meteor("the cat sat", "the cat sat") == pytest.approx(1 - 0.5 / 27)
    assert code.meteor("a", "b") == 0 and code.codebleu(SOURCE, SOURCE) == pytest.approx(1.0)
    assert code.codebleu("", SOURCE) == 0


def test_lists_of_mutators():
    assert (len(mutate.BASE), len(mutate.FAMILIES["extra"])) == (14, 20)
    assert {r.name for r in mutate.FAMILIES["both"]} == set(plain_mutations.FAMILIES["both"])


LONGER_SOURCE = """
def f(a, b={'k': [1, 2][0]}, *, c=max(3, 4) < 5):
    x = [y for y in a if (y or b) if not c] + sorted(a, key=lambda q: -q[-1], reverse=c)
    total_é = 0.0
    for i, z in enumerate(zip(a[1:-2], b.items()), 3):
        if (x and not z) or (a and (b or c)) is None:
            x.append((i, 'é"x', b.get(i, 0)))
            continue
        while not (i - 1) * 2 // 3 >= abs(a[i + 1] - 7):
            x.extend([a[0].strip(), round(2.5)])
            break
        else:
            break
    try:
        return '-'.join(str(v).lower() for v in range(len(x))) if any(x) else a.copy().find(max(b))[2:5]
    except ValueError:
        return {k: v for k in range(2, 9, 3) for v in set(k) if True}

def g(n):
    return n < 1
"""


def test_rules_equal_the_plain_ones(spark):
    """Every rule and draw, over programs of one and of many candidates, against trees that are edited one by one."""
    programs = [SOURCE, LONGER_SOURCE, *[p for _, _, b, _ in mutations.CASES if (p := mutations._program(b))]]
    rows = [(k, c, r.name, d) for k, c in enumerate(programs) for r in mutate.FAMILIES["both"] for d in (0, 1)]
    made = mutate.mutated_by(spark.createDataFrame(rows, "k int, program string, rule string, draw int").repartition(4), "program", "rule", "draw").collect()
    assert len(made) == len(rows) and sum(r.code is not None for r in made) > 300
    for r in made:
        assert r.code == plain_mutations.apply_rule(r.program, r.rule, plain_mutations.Draws(r.draw)), (r.rule, r.program)


@pytest.mark.parametrize("family", ["base", "extra", "both"])
def test_mutations_keep_the_signature(spark, family):
    programs = [(f"task/{k}", c) for k in range(12) for c in (SOURCE, LONGER_SOURCE)]
    df = spark.createDataFrame([(f"{k}/{len(c)}", c, 1, "x") for k, c in programs], "task string, program string, text int, key string")
    made = mutate.corrupt(df, "program", "task", family=family).collect()
    assert {r.task: r.mutated for r in made} == {r.task: r.mutated for r in mutate.corrupt(df.repartition(3), "program", "task", family=family).collect()}
    assert len({tuple(r.mutated.mutations) for r in made}) > 5  # each row has an order of its own
    for r in made:
        names = r.mutated.mutations
        assert r.mutated.error is None and names and len(names) == len(set(names)) <= (mutate.MOST_BASE if family == "base" else mutate.MOST_EXTRA)
        could = {r.program}
        for name in names:
            could = {x for c in could for d in (0, 1) if (x := plain_mutations.apply_rule(c, name, plain_mutations.Draws(d)))}
        assert r.mutated.code in could
        assert ast.dump(ast.parse(r.mutated.code).body[0].args) == ast.dump(ast.parse(r.program).body[0].args)


def test_programs_that_cannot_be_mutated(spark):
    rows = spark.createDataFrame([("a", "x = 1"), ("b", "def ("), ("c", "def f(a): return a"), ("d", None), (None, "def f(a): return a + 1")], "k string, c string")
    got = {r.k: (r.mutated.code, r.mutated.error) for r in mutate.corrupt(rows, "c", "k").collect()}
    assert got.pop(None)[1] is None
    assert got == {"a": (None, "no function"), "b": (None, "the code does not parse"), "c": (None, "no mutation fits"), "d": (None, "no code")}
    assert mutate.corrupt(rows.limit(0), "c", "k").count() == 0


TEXTS = st.lists(st.sampled_from(["a", "b", "cc", "é"]), max_size=6)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


LONGER = st.lists(st.sampled_from("abcde"), max_size=90)


@settings(max_examples=200, deadline=None)
@given(LONGER, LONGER)
def test_bit_parallel_tables(a, b):
    assert code.sequence_distance(a, b) == plain_distance(a, b)
    assert code.common_length(a, b) == plain_common(a, b)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=20))
def test_sequence_distance(spark, pairs):
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", similarity.sequence_distance(F.col("a"), F.col("b")).alias("d"), similarity.sequence_distance(F.col("b"), F.col("a")).alias("e")).collect()
    for r in rows:
        assert r.d == r.e == plain_distance(r.a, r.b)


def test_distance_of_long_lists(spark):
    """More different elements than any one-byte alphabet holds."""
    rng = random.Random(1)
    pairs = [([f"t{rng.randrange(n)}" for _ in range(rng.randrange(n))], [f"t{rng.randrange(n)}" for _ in range(rng.randrange(n))]) for n in (1, 40, 200, 400) for _ in range(3)]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", similarity.sequence_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in rows] == [plain_distance(r.a, r.b) for r in rows]
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")).alias("a"))
    assert wide.select(similarity.sequence_distance(F.slice("a", 59_000, 900), F.slice("a", 59_010, 900)).alias("d")).first().d == 20


def test_outputs(spark):
    cases = [("1 2\n3", "1.0 2\n3.00", True), ("a b", "a  b", False), ("a\nb", "a", False), (" a \n", "a", True), ("1e2", "100", True), ("x", "y", False)]
    rows = spark.createDataFrame(cases, "got string, want string, equal boolean")
    for r in rows.select("equal", compare.stdout_equal(F.col("got"), F.col("want")).alias("a"), compare.decimals("got", "want").alias("b")).collect():
        assert r.a == r.b == r.equal
    assert compare.decimals_equal("1" + "0" * 50, "1" + "0" * 50 + ".0")


def test_lenient_outputs():
    assert compare.lenient_equal("1.0000000001", "1") and compare.lenient_equal("a b\n c", "a b\nc")
    assert compare.lenient_equal("b a\nc", "a b\nc") and compare.lenient_equal(["1", "2"], "1\n2")
    assert compare.lenient_equal("x 1", "y 1")  # words that are no numbers may differ
    assert not compare.lenient_equal("1\n2", "1\n3") and not compare.lenient_equal("1", "2\n3")


def test_other_helpers(spark):
    assert code.assert_right_side("assert f(1) == [1, 2]") == "[1, 2]" and code.assert_right_side("x = 1") == "Not an assert statement"
    assert code.expected_equal("assert f() == [1, 'a']", '[1, "a"]') and not code.expected_equal("assert f() == g()", "1")
    assert code.expected_equal("# assert f() == 1\nassert f() == 2", "2") and code.expected_equal("[1]", "[1]")
    assert code.integer_keys('{"01": {"-2": 1}}') == '{"1": {"-2": 1}}'
    assert "def wrapped_function():" in code.as_function("import os\nx = 1\nprint(x)")
    assert code.without_main_guard("x = 1\nif __name__ == '__main__':\n    print(x)\n") == "x = 1\nprint(x)"
    report = "\u001b[31m1-3:\u001b[0m\nx\n2:\n7:\n"
    assert spark.createDataFrame([(report,)], "t string").select(extract.changed_lines(F.col("t")).alias("n")).first().n == 4


def plain_clipped(a, b, n):
    x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
    return sum((x & y).values()), sum(y.values()), sum(x.values())


@settings(max_examples=200, deadline=None)
@given(LONGER, LONGER)
def test_clipped_counts(a, b):
    assert code.clipped(a, b, 6) == [plain_clipped(a, b, n) for n in range(1, 7)]


def test_metrics_as_columns(spark):
    pairs = [(1, "the cat sat on the mat", "the cat sat on a mat"), (2, "a b c", "x y z"), (3, "one two", "one two three four five"), (4, "same same same", "same"), (5, "", "a")]
    rows = spark.createDataFrame(pairs, "id long, r string, p string")
    tokens = rows.select("id", similarity.tokens(F.col("r")).alias("r"), similarity.tokens(F.col("p")).alias("p"))
    bleu = {r.id: r.bleu for r in similarity.sentence_bleu(tokens, ["id"], "r", "p").collect()}
    letters = {r.id: r.chrf for r in similarity.chrf(rows, ["id"], "r", "p").collect()}
    rouge = {r.id: r for r in similarity.rouge(rows, ["id"], "r", "p").collect()}
    whole = {r.id: r.bleu for r in similarity.corpus_bleu(tokens, ["id"], "r", "p").collect()}
    for i, a, b in pairs:
        one = [plain_clipped(a.split(), b.split(), n) for n in range(1, 5)]
        want = math.prod(((m or 0.1) / max(p, 1)) ** 0.25 for m, p, _ in one) * (1 if len(b.split()) > len(a.split()) else math.exp(1 - len(a.split()) / len(b.split()))) if one[0][0] else 0
        assert bleu[i] == pytest.approx(want) and whole[i] == pytest.approx(want)
        assert letters[i] == pytest.approx(code.chrf(a, b))
        assert (rouge[i].rouge_1, rouge[i].rouge_2, rouge[i].rouge_l) == pytest.approx(code.rouges(a, b))


def test_prompts(spark):
    rows = spark.createDataFrame([("Add.", "def f():", "x = 1"), ("Add.", "", "x = 1")], "content string, starter string, code string")
    c = [F.col(n) for n in ("content", "starter", "code")]
    got = rows.select(
        templates.question(c[0], c[1]).alias("question"),
        prompts.user_message(c[0], c[2]).alias("user"),
        prompts.strip_fence(F.lit("```python\nx\n```")).alias("bare"),
        prompts.clean_problem(F.lit(" a. DROP b "), ("DROP ",)).alias("clean"),
    ).collect()
    with_code, without = got
    assert with_code.question == f"### Question:\nAdd.\n\n### Format: {templates.WITH_STARTER}\n```python\ndef f():\n```\n\n{templates.ANSWER_FORMAT}"
    assert without.question == f"### Question:\nAdd.\n\n### Format: {templates.WITHOUT_STARTER}\n{templates.YOUR_CODE}{templates.ANSWER_FORMAT}"
    assert with_code.user.endswith("The function I have written so far is:\nx = 1 \n\n" + prompts.ASK + prompts.WRAP)
    assert (with_code.bare, with_code.clean) == ("x", "a. b")


def test_unknown_error_codes_and_unmatched_problems_raise(spark):
    row = spark.createDataFrame([("q", "x = 1", False, '{"error_code": -9}')], "question_content string, code string, passed boolean, metadata string")
    with pytest.raises(Exception, match="unknown error code"):
        templates.repair_prompts(row).collect()
    asked = row.withColumn("question_id", F.lit(1))
    graded = spark.createDataFrame([(2, ["a"], [False], ["{}"])], "question_id int, code_list array<string>, graded_list array<boolean>, metadata array<string>")
    with pytest.raises(Exception, match="not one evaluated row"):
        harness.repair_rows(asked, graded).collect()
    failed = templates.repair_prompts(row.withColumn("metadata", F.lit("{}"))).filter("style = 'Gemini'").first()
    assert "```python\nx = 1\n```\n\n\n### Format" in failed.prompt.messages[0].content


def test_names_of_functions():
    assert code.function_name("class A:\n    def f(self): pass") == "f"
    assert code.function_name("def f(): pass\ndef g(): pass") is None and code.function_name("def (") is None and code.function_name("x = 1") is None


def test_mutation_rounds_share_few_workers(spark):
    rows = spark.createDataFrame([(1, "def f(a):\n    return a < 3")], "id long, program string")
    plan = mutate.corrupt(rows, "program", "id", family="both")._jdf.queryExecution().sparkPlan().toString()
    stages = [part.count("MapInArrow") for part in re.split(r"Exchange|Repartition", plan)]
    assert sum(stages) == mutate.MOST_EXTRA + 1 and max(stages) <= 3


def test_programs_are_shaped_in_small_slices():
    class Table:
        columns, schema = ["code"], StructType([StructField("code", StringType())])

        def mapInArrow(self, run, schema):  # noqa: N802  name of the interface
            return run

    whole = pa.record_batch({"code": [f"def f(): return {k}" for k in range(1000)]})
    made = list(syntax.with_syntax(Table(), "code")(iter([whole])))
    assert max(b.num_rows for b in made) <= 200
    assert [x for b in made for x in b.column(1).to_pylist()] == [f"def f():\n    return {k}" for k in range(1000)]
