"""Functions that must parse programs: one Arrow function each, over plain Python underneath.

The plain functions are pure and total: they give a defined value for code that does not parse.
"""

from __future__ import annotations

import ast
import base64
import difflib
import heapq
import io
import json
import math
import re
import tokenize
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import stemmer

LEFT_OUT = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT}
MOST_DIFF_LINES = 1000
# Fixed value: what stands for a diff of longer programs.
TOO_LARGE = "Files too large for diff. Reference: {} lines, Prediction: {} lines"
#: Fixed keywords that weigh more in the code metric.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())


def parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@lru_cache(maxsize=4096)
def standardise(code: str) -> str:
    """Without comments and in one layout; code that does not parse only loses its comments."""
    if not code.strip():
        return code
    if parses(code):
        try:
            return ast.unparse(ast.parse(code))
        except (RecursionError, ValueError):
            pass
    try:
        kept = [t for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type != tokenize.COMMENT]
        return tokenize.untokenize(kept)
    except (tokenize.TokenError, SyntaxError, IndentationError, ValueError):
        return "\n".join(_uncommented(line) for line in code.splitlines())


_QUOTED = re.compile(r"'''.*?(?:'''|$)|\"\"\".*?(?:\"\"\"|$)|'(?:\\.|[^'\\])*(?:'|$)|\"(?:\\.|[^\"\\])*(?:\"|$)|#.*")


def _uncommented(line: str) -> str:
    """A line up to the first # outside quotes."""
    for m in _QUOTED.finditer(line):
        if m[0].startswith("#"):
            return line[: m.start()].rstrip()
    return line


def code_tokens(code: str) -> list[str]:
    """Tokens without comments and layout, or words where the text is no program."""
    try:
        return [t.string for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in LEFT_OUT]
    except (tokenize.TokenError, SyntaxError, IndentationError, ValueError):
        return code.split()


def first_function(tree: ast.AST) -> ast.FunctionDef | None:
    return next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)), None)


def function_name(code: str) -> str | None:
    """The name of the one function in a program; null where there are none or several."""
    names = [n.name for n in ast.walk(ast.parse(code)) if isinstance(n, ast.FunctionDef)] if parses(code) else []
    return names[0] if len(names) == 1 else None


# What opens a function, and a block of documentation.
_DEF_LINE = re.compile(r"def\s+[^:]+:\s*\n")
_DOC_BLOCK = re.compile(r"^\s*(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')\s*\n")


@lru_cache(maxsize=4096)
def function_body(code: str) -> str:
    """What follows the first function's docstring; with no docstring, from its def line on."""
    code = standardise(code)
    function = first_function(ast.parse(code)) if parses(code) else None
    if function is None:
        head = _DEF_LINE.search(code)
        if head is None:
            return code
        rest = code[head.end() :]
        doc = _DOC_BLOCK.search(rest)
        return rest[doc.end() :] if doc else rest
    begin = function.lineno
    if ast.get_docstring(function, clean=False) is not None:
        if len(function.body) == 1:
            return ""
        begin = function.body[1].lineno
    return "\n".join(code.splitlines()[begin - 1 :])


def insert_docstring(code: str, text: str) -> str:
    """The docstring under the first def line; code without such a line stays as it is."""
    head = re.search(r"def\s+[^:]+:\s*\n", code) if text else None
    if head is None:
        return code
    line = head[0].rstrip("\n")
    return f"{code[: head.start()]}{line}\n    {text}\n{code[head.end() :]}"


def response_code(text: str) -> str:
    """The program in a response: all of it if it parses, else the longest closed block, else what an open fence begins."""
    text = text.strip()
    if parses(text):
        return text
    for mark in ("</think>", "</thought>"):
        text = text.rpartition(mark)[2]
    blocks = [b.strip() for b in re.findall(r"(?im)^```(?:python)?\s*\n([\s\S]*?)\n```", text)]
    if blocks:
        return max(blocks, key=len)
    opened = re.search(r"(?im)^```(?:python)?\s*\n([\s\S]*)\Z", text)
    return opened[1].strip() if opened else ""


# Complexity: a walk with the nesting depth, by a table of what each kind of node adds.
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def complexities(code: str | None) -> tuple[int | None, int | None]:
    """(cyclomatic, cognitive), or nulls for empty code and code that does not parse.

    Tests of if, for and while are not looked into; functions do not nest; bodies of match cases count twice,
    nested as a block and once more as plain children.
    """
    if not code:
        return None, None
    tidy = standardise(code)
    tree = ast.parse(tidy) if parses(tidy) else ast.parse(code) if parses(code) else None
    if tree is None:
        return None, None
    total = Counter(cyclomatic=1, cognitive=0)
    todo: list[tuple[ast.AST, int]] = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        plain, nested, branches = _steps(node)
        total["cyclomatic"] += branches[0]
        total["cognitive"] += branches[1] + branches[2] * (1 + depth)
        todo += [(child, depth) for child in plain] + [(child, depth + 1) for child in nested]
    return total["cyclomatic"], total["cognitive"]


def _steps(node: ast.AST) -> tuple[list, list, tuple[int, int, int]]:
    """(children at this depth, children one deeper, (cyclomatic, flat cognitive, cognitive that grows with depth))."""
    children = list(ast.iter_child_nodes(node))
    if isinstance(node, ast.If):
        chained = len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If)
        return (node.orelse, node.body, (1, 0, 1)) if chained else ([], node.body + node.orelse, (1, 0, 1))
    if isinstance(node, _LOOPS):
        return [], node.body + node.orelse, (1, 0, 1)
    if isinstance(node, ast.Try):
        handled = [s for h in node.handlers for s in h.body]
        return [], node.body + handled + node.orelse + node.finalbody, (len(node.handlers) + bool(node.finalbody), 0, len(node.handlers))
    if isinstance(node, (ast.With, ast.AsyncWith)):
        return [], node.body, (0, 0, 0)
    if isinstance(node, ast.BoolOp):
        return children, [], (len(node.values) - 1, len(node.values) - 1, 0)
    if isinstance(node, ast.IfExp):
        return children, [], (1, 0, 1)
    if isinstance(node, ast.comprehension):
        return children, [], (1 + len(node.ifs), 0, 1 + len(node.ifs))
    if isinstance(node, ast.Assert):
        return children, [], (1, 0, 0)
    if isinstance(node, ast.Match):
        return children, [s for c in node.cases for s in c.body], (len(node.cases), 0, len(node.cases))
    return children, [], (0, 0, 0)


def structured_diff(before: str, after: str) -> list[dict[str, str]]:
    """Rows (type, content): context (its mark, a space, stays), added or removed; equal texts are one context row, long ones a summary."""
    if not before and not after:
        return []
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    if a == b:
        return [{"type": "context", "content": before}]
    if max(len(a), len(b)) > MOST_DIFF_LINES:
        return [{"type": "summary", "content": TOO_LARGE.format(len(a), len(b))}]
    out = []
    for line in difflib.unified_diff(a, b, lineterm=""):
        if line.startswith(("+++", "---", "@@")):
            continue
        kind = {"+": "added", "-": "removed"}.get(line[0], "context")
        out.append({"type": kind, "content": (line if kind == "context" else line[1:]).rstrip()})
    return out


@udtf(returnType="row long, type string, content string")
class DiffRows:
    """structured_diff() as a table function: of the rows of a table it is called laterally, also by name in SQL."""

    def eval(self, before: str, after: str):
        if before is not None and after is not None:
            for k, row in enumerate(structured_diff(before, after)):
                yield k, row["type"], row["content"]


def leaves(code: str) -> list[tuple[str, int, int]]:
    """(label, first line, last line) of what the syntax tree of a program is made of, in the order of the source.

    A node without nodes in it is a leaf, and so is each name or constant that a node holds itself. What has no
    place of its own, such as an operator, has that of the node around it.
    """
    out: list[tuple[str, int, int]] = []
    todo: list[tuple[ast.AST, int, int]] = [(ast.parse(code), 1, 1)]
    while todo:
        node, first, last = todo.pop()
        first, last = getattr(node, "lineno", first), getattr(node, "end_lineno", last)
        inner = []
        for name, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST):
                    if not isinstance(x, ast.expr_context):
                        inner.append((x, first, last))
                elif x is not None and name not in ("kind", "type_comment", "type_ignores"):
                    single = first if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else last
                    out.append((f"{type(node).__name__}.{name}={x!r}", first, single))
        if not inner and not any(x is not None and not isinstance(x, (list, ast.expr_context)) for _, x in ast.iter_fields(node)):
            out.append((type(node).__name__, first, last if not isinstance(node, ast.Module) else first))
        todo += reversed(inner)
    return out


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence: equal ends first, then rows of bit sets, walked backwards."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    places, whole = _places(x), (1 << len(x)) - 1
    rows = [whole]
    for item in y:
        hit = rows[-1] & places.get(item, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & whole)
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()  # noqa: E731  of the prefixes
    i, j, found = len(x), len(y), []
    while i and j:
        best = length(i, j)
        if length(i, j - 1) == best:
            j -= 1
        elif length(i - 1, j) == best:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((low + i, low + j))
    ends = [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    return [(k, k) for k in range(low)] + found[::-1] + ends


def changed_leaf_lines(reference: str, prediction: str) -> int:
    """How many line numbers hold a leaf that only one of the programs has; -1 if either does not parse.

    Numbers of both sides count as one set. This is the library's own measure in the place of an external tool's.
    """
    if not parses(reference) or not parses(prediction):
        return -1
    sides = [leaves(reference), leaves(prediction)]
    pairs = common_pairs(*[[label for label, _, _ in side] for side in sides])
    lines: set[int] = set()
    for side, kept in zip(sides, ({i for i, _ in pairs}, {j for _, j in pairs}), strict=True):
        for k, (_, first, last) in enumerate(side):
            if k not in kept:
                lines.update(range(first, last + 1))
    return len(lines)


def _places(items: list[str]) -> dict[str, int]:
    """For each element the positions that hold it, as bits."""
    out: dict[str, int] = {}
    for i, x in enumerate(items):
        out[x] = out.get(x, 0) | 1 << i
    return out


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time (bit-parallel)."""
    places, whole = _places(a), (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def sequence_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists by Myers' bit-parallel columns: vertical steps of +1 and -1 as two bit sets."""
    if not a or not b:
        return len(a) + len(b)
    places, whole, last = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = whole, 0, len(a)
    for y in b:
        equal = places.get(y, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | (whole & ~(diagonal | up)), up & diagonal
        score += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = (right_up << 1) | 1, right_down << 1
        up, down = (right_down | ~(diagonal | right_up)) & whole, right_up & diagonal & whole
    return score


_stem = lru_cache(maxsize=1 << 16)(stemmer.stem)


def _rouge_words(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return [_stem(w) if len(w) > 3 else w for w in words]


def rouge_l(reference: str, prediction: str) -> float:
    return rouges(reference, prediction)[2]


def meteor(reference: str, prediction: str) -> float:
    """Unigram matches, exact and then by stem, with a penalty for chunks (0.9, 3, 0.5); synonyms need a table, see meteor_aligned()."""
    ref, pred = reference.lower().split(), prediction.lower().split()
    free, pairs = set(range(len(ref))), {}
    for form in (lambda w: w, _stem):
        places: dict[str, list[int]] = {}
        for j in sorted(free, reverse=True):
            places.setdefault(form(ref[j]), []).append(j)
        for i, word in enumerate(pred):
            if i not in pairs and places.get(form(word)):
                pairs[i] = places[form(word)].pop()
                free.discard(pairs[i])
    return _meteor_of(len(ref), len(pred), sorted(pairs.items()))


def _meteor_of(n_ref: int, n_pred: int, pairs: list[tuple[int, int]]) -> float:
    """The score of an alignment, pairs (place in the prediction, place in the reference) in order."""
    if not pairs:
        return 0.0
    m = len(pairs)
    mean = 10 * m / (9 * n_ref + n_pred)  # of precision and recall, in whole numbers: rounded once
    return mean * (1 - 0.5 * (_chunks(pairs) / m) ** 3)


def _chunks(pairs: list[tuple[int, int]]) -> int:
    return 1 + sum(1 for (i, j), (k, n) in zip(pairs, pairs[1:], strict=False) if k != i + 1 or n != j + 1)


#: Alignments that the search for the fewest chunks keeps at each word, and places that it tries for a word.
BEAM, WIDTH = 16, 8


def align(ref: list[str], pred: list[str], synonyms: dict[str, set[str]]) -> list[tuple[int, int]]:
    """Pairs (place in ``pred``, place in ``ref``): as many equal words as there are, then equal stems, then synonyms, in the fewest chunks.

    Of a word as many pairs are equal as both sides have it; only what is left over on either side goes to the later
    stages. The longest common runs, one after the other, are an alignment, and the result if it has all pairs and no
    chunk more than there must be, as for a text against itself with words replaced. Else a search from left to right
    keeps, of the alignments that have used the same places and end alike, the best, and BEAM of these: those with the
    fewest chunks, then those that can go on for longest; the better of both counts. So the result is exact for the
    former texts, whatever their length, and for those with no more open choices than BEAM.
    """
    mine, theirs = Counter(pred), Counter(ref)
    equal = {w: min(n, theirs[w]) for w, n in mine.items()}
    spare = {w: n - equal.get(w, 0) for w, n in theirs.items()}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, []).append(j)
    by_stem: dict[str, list[str]] = {}
    for w in places:
        by_stem.setdefault(_stem(w), []).append(w)
    takes: dict[str, dict[int, int]] = {}  # for each word the places that it may take, and the stage
    for w in mine:
        later = {j: 2 for x in synonyms.get(w, ()) if x != w and spare.get(x) for j in places[x]} | {j: 1 for x in by_stem.get(_stem(w), ()) if x != w and spare[x] for j in places[x]}
        takes[w] = later | (dict.fromkeys(places[w], 0) if equal[w] else {})
    runs: list[dict[int, int]] = [{} for _ in range(len(pred) + 1)]  # how many words can go on from a pair
    for i in range(len(pred) - 1, -1, -1):
        runs[i] = {j: 1 + runs[i + 1].get(j + 1, 0) for j in takes[pred[i]]}
    tiled = _longest_first(runs)
    stages = Counter(takes[pred[i]][j] for i, j in tiled)
    fewest = sum(1 for i, now in enumerate(runs[:-1]) if now and not (i and any(j - 1 in runs[i - 1] for j in now)))
    mixed = len({stage for found in takes.values() for stage in found.values() if stage}) > 1
    if not mixed and stages[0] == sum(equal.values()) and len(tiled) == sum(map(bool, runs)) and (not tiled or _chunks(tiled) == fewest):
        return tiled
    counted = {w for w, n in equal.items() if n and (mine[w] > n or theirs[w] > n)}  # others need no account of their stages

    # (less pairs of each stage, then chunks), places used, last pair, pairs of counted words by stage, pairs as a linked list
    states = [((0, 0, 0, 0), 0, (-2, -2), {}, None)]
    left = Counter(pred)
    for i, word in enumerate(pred):
        left[word] -= 1
        longest = max(runs[i].values(), default=0)
        grown: dict[tuple, tuple] = {}
        for value, used, last, done, pairs in states:
            need = equal[word] - done.get((0, word), 0) if word in counted else bool(equal[word]) * (left[word] + 1)
            if need <= left[word]:  # the word may stay alone
                key = (used, last)
                if key not in grown or value < grown[key][0]:
                    grown[key] = (value, used, last, done, pairs)
            on = last[1] + 1 if last[0] == i - 1 else -2
            if on in runs[i] and runs[i][on] == longest and not used >> on & 1 and (takes[word][on] == 0) == bool(need):
                free = [on]  # no other place goes on for longer
            elif len(free := [j for j in takes[word] if not used >> j & 1]) > 1:
                free.sort(key=lambda j: (j != on, -runs[i][j], j))
            for j in free[:WIDTH]:
                stage, other = takes[word][j], ref[j]
                if stage == 0 and not need or stage and (need > left[word] or other in counted and done.get((1, other), 0) >= spare[other]):
                    continue
                mark = (0, word) if stage == 0 else (1, other)
                new = [*value]
                new[stage] -= 1
                new[3] += j != on
                key, state = (used | 1 << j, (i, j)), tuple(new)
                if key not in grown or state < grown[key][0]:
                    grown[key] = (state, key[0], (i, j), {**done, mark: done.get(mark, 0) + 1} if mark[1] in counted else done, ((i, j), pairs))
        ahead = lambda x, i=i: -runs[i + 1].get(x[2][1] + 1, 0) if x[2][0] == i else 0
        states = sorted(grown.values(), key=lambda x: (x[0], ahead(x), x[2]))[:BEAM]
    if tiled and (-stages[0], -stages[1], -stages[2], _chunks(tiled)) < states[0][0]:
        return tiled
    out, node = [], states[0][4]
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _longest_first(runs: list[dict[int, int]]) -> list[tuple[int, int]]:
    """Pairs of the longest run (how many words go on from a pair), then of the longest one among the places still free, and so on."""
    todo = [(-n, i, j) for i, now in enumerate(runs) for j, n in now.items() if not (i and j - 1 in runs[i - 1])]
    heapq.heapify(todo)
    mine: dict[int, int] = {}
    used: set[int] = set()
    while todo:
        n, i, j = heapq.heappop(todo)
        begin, parts = 0, []
        for k in range(1 - n):
            if k == -n or i + k in mine or j + k in used:
                if k > begin:
                    parts.append((begin - k, i + begin, j + begin))
                begin = k + 1
        if parts != [(n, i, j)]:
            for part in parts:
                heapq.heappush(todo, part)
            continue
        for k in range(-n):
            mine[i + k] = j + k
            used.add(j + k)
    return sorted(mine.items())


def meteor_aligned(reference: str, prediction: str, synonyms: dict[str, set[str]]) -> float:
    """METEOR with a stage of synonyms, over the alignment with few chunks."""
    ref, pred = reference.lower().split(), prediction.lower().split()
    return _meteor_of(len(ref), len(pred), align(ref, pred, synonyms))


def _grams(items: list[str], n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def clipped(a: list, b: list, orders: int) -> list[tuple[int, int, int]]:
    """(matches, n-grams of b, n-grams of a) for n up to ``orders``, of two lists; exact, without a table of n-grams."""
    _, known = np.unique(np.array([*a, *b], dtype=object), return_inverse=True) if a or b else (None, np.zeros(0, np.int64))
    letters, out = (known[: len(a)], known[len(a) :]), []
    grams = list(letters)
    for n in range(1, orders + 1):
        if n > 1:  # a gram is the number of the one before it, and one element more
            grams = [g[:-1] * len(known) + x[n - 1 :] if len(g) > 1 else g[:0] for g, x in zip(grams, letters, strict=True)]
            _, both = np.unique(np.concatenate(grams), return_inverse=True)
            grams = [both[: len(grams[0])], both[len(grams[0]) :]]
        size = int(max((g.max(initial=-1) for g in grams))) + 1
        counts = [np.bincount(g, minlength=size) for g in grams]
        out.append((int(np.minimum(*counts).sum()), len(grams[1]), len(grams[0])))
    return out


def bleu_counts(reference: list[str], prediction: list[str]) -> list[int]:
    """What a pair adds to a corpus score: both lengths, then matches and n-grams of the prediction for n up to 4."""
    return [len(reference), len(prediction), *[x for matches, predicted, _ in clipped(reference, prediction, 4) for x in (matches, predicted)]]


def bleu_of_counts(counts: list[float]) -> float:
    """BLEU-4; zero matches count as 0.1, without a common token it is 0."""
    expected, predicted, *pairs = counts
    if not pairs[0]:
        return 0.0
    product = math.prod((pairs[k] or 0.1) / max(pairs[k + 1], 1) for k in range(0, 8, 2))
    return product**0.25 * _brevity(predicted, expected)


def sentence_bleu(reference: list[str], prediction: list[str]) -> float:
    return bleu_of_counts(bleu_counts(reference, prediction))


def _brevity(predicted: int, expected: int) -> float:
    return 1.0 if predicted > expected else math.exp(1 - expected / predicted) if predicted else 0.0


def rouge_n(reference: str, prediction: str, n: int) -> float:
    return rouges(reference, prediction)[n - 1]


def rouges(reference: str, prediction: str) -> tuple[float, float, float]:
    """ROUGE-1, ROUGE-2 and ROUGE-L (F1) over stems."""
    a, b = _rouge_words(reference), _rouge_words(prediction)
    one, two = (2 * matches / (predicted + expected) if matches else 0.0 for matches, predicted, expected in clipped(a, b, 2))
    common = common_length(a, b)
    return one, two, 2 * common / (len(a) + len(b)) if common else 0.0


def chrf(reference: str, prediction: str) -> float:
    """Mean F-score (beta 3) of character n-grams up to 6, white space removed; an order that a side lacks is 0."""
    scores = []
    for matches, predicted, expected in clipped(list("".join(reference.split())), list("".join(prediction.split())), 6):
        precision, recall = matches / max(predicted, 1), matches / max(expected, 1)
        scores.append(10 * precision * recall / (9 * precision + recall) if matches else 0.0)
    return sum(scores) / 6


CODEBLEU_PARTS = ("n_reference", "n_prediction", *(f"{kind}_{part}{n}" for kind in ("plain", "keyword") for n in range(1, 5) for part in ("right", "total")), "tree_right", "tree_total")


@lru_cache(maxsize=1024)
def _prepared(code: str) -> tuple[int, list[Counter], Counter | None]:
    """Tokens, n-grams and subtrees of a program: made once, however many pairs it is in."""
    tokens = code_tokens(code)
    return len(tokens), [_grams(tokens, n) for n in range(1, 5)], _subtrees(code)


def _weight(gram: tuple[str, ...]) -> float:
    """Words that are no keywords count a fifth."""
    return 0.2 if len(gram) == 1 and gram[0] not in KEYWORDS else 1.0


def codebleu_parts(reference: str, prediction: str) -> dict[str, float]:
    """What one pair adds to the corpus score: lengths, clipped and weighted n-gram counts, equal subtrees."""
    (n_reference, expected, x), (n_prediction, found, y) = _prepared(reference), _prepared(prediction)
    out = {"n_reference": float(n_reference), "n_prediction": float(n_prediction)}
    for n in range(1, 5):
        right, total = found[n - 1] & expected[n - 1], found[n - 1]
        out[f"plain_right{n}"], out[f"plain_total{n}"] = float(sum(right.values())), float(sum(total.values()))
        out[f"keyword_right{n}"], out[f"keyword_total{n}"] = (sum(_weight(g) * c for g, c in grams.items()) for grams in (right, total))
    out["tree_right"] = float(sum((x & y).values())) if x and y else 0.0
    out["tree_total"] = float(sum(x.values())) if x else 0.0
    return out


def codebleu_of_parts(parts: dict[str, float]) -> float:
    """Mean of n-gram match, n-gram match with weighted keywords and syntax match, for weights 1/3, 1/3, 1/3, 0."""
    brief = _brevity(parts["n_prediction"], parts["n_reference"])
    scores = []
    for kind in ("plain", "keyword"):
        product = 1.0 if parts[f"{kind}_right1"] else 0.0
        for n in range(1, 5):
            product *= (parts[f"{kind}_right{n}"] or 0.1) / (parts[f"{kind}_total{n}"] or 1.0)
        scores.append(brief * product**0.25)
    scores.append(parts["tree_right"] / parts["tree_total"] if parts["tree_total"] else 0.0)
    return sum(scores) / 3


def _subtrees(code: str) -> Counter | None:
    if not parses(code):
        return None
    return Counter(ast.dump(n, annotate_fields=False) for n in ast.walk(ast.parse(code)) if isinstance(n, (ast.stmt, ast.expr)))


def codebleu(reference: str, prediction: str) -> float:
    """codebleu_of_parts() of one pair; the syntax match counts equal subtrees of the built-in parser."""
    return codebleu_of_parts(codebleu_parts(reference, prediction))


def private_tests(packed: str) -> str | None:
    """JSON of hidden tests: plain, or base64 of zlib of JSON. A pickle inside is not opened."""
    try:
        json.loads(packed)
        return packed
    except ValueError:
        pass
    try:
        text = zlib.decompress(base64.b64decode(packed)).decode()
        json.loads(text)
        return text
    except (ValueError, zlib.error):
        return None


#: Fixed messages of assert_right_side().
NO_PARSE, NO_STATEMENT, NO_ASSERT, NO_EQUALITY = "Invalid syntax", "Empty statement", "Not an assert statement", "Not an equality assertion"


def assert_right_side(line: str) -> str:
    """The source of what an assert compares with, or a message that says why there is none."""
    if not parses(line):
        return NO_PARSE
    body = ast.parse(line).body
    if not body:
        return NO_STATEMENT
    if not isinstance(body[0], ast.Assert):
        return NO_ASSERT
    test = body[0].test
    if not isinstance(test, ast.Compare) or not isinstance(test.ops[0], ast.Eq):
        return NO_EQUALITY
    return ast.get_source_segment(line, test.comparators[0]) or ""


def expected_equal(text: str, expected: str) -> bool:
    """Whether an assert's right side, or else the whole text, equals a JSON value; only literals are read, nothing is run.

    Of several lines the first with an assert that is no comment counts.
    """
    lines = text.splitlines()
    if len(lines) > 1:
        text = next((x for x in lines if "assert" in x and not x.startswith("#")), text)
    text = text.strip()
    try:
        return ast.literal_eval(assert_right_side(text) if "assert" in text else text) == json.loads(expected)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return False


def integer_keys(text: str) -> str:
    """JSON whose objects of number-like keys have plain integers as keys, for those that all are."""

    def fixed(x):
        if isinstance(x, dict):
            return {(str(int(k)) if k.lstrip("-").isdigit() else k): fixed(v) for k, v in x.items()}
        return [fixed(v) for v in x] if isinstance(x, list) else x

    try:
        return json.dumps(fixed(json.loads(text)))
    except ValueError:
        return text


def as_function(code: str, name: str = "wrapped_function") -> str:
    """A script as a module whose imports stay outside and whose other statements form one function."""
    tree = ast.parse(code)
    imports = [n for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    rest = [n for n in tree.body if n not in imports] or [ast.Pass()]
    shell = ast.parse(f"def {name}():\n    pass").body[0]
    shell.body = rest
    return ast.unparse(ast.Module([*imports, shell], []))


def without_main_guard(code: str) -> str:
    """A script whose last `if __name__ == '__main__'` block is laid open."""
    if not parses(code):
        return code
    tree = ast.parse(code)
    last = tree.body[-1] if tree.body else None
    if isinstance(last, ast.If) and ast.unparse(last.test) == "__name__ == '__main__'":
        return "\n".join(ast.unparse(ast.Module(part, [])) for part in (tree.body[:-1], last.body))
    return code


def as_function_or_same(code: str) -> str:
    return as_function(code) if parses(code) else code


# What graders put before a program.
PRELUDE = (
    "import sys\nimport time\nimport itertools\nfrom itertools import accumulate, product, permutations, combinations\nimport collections\n"
    "from collections import Counter, OrderedDict, deque, defaultdict, ChainMap\nfrom functools import lru_cache\nimport math\n"
    "from math import sqrt, sin, cos, tan, ceil, fabs, floor, gcd, exp, log, log2\nimport fractions\nfrom typing import List, Tuple\n"
    "import numpy as np\nimport random\nimport heapq\nfrom heapq import *\n"
)
STREAMS = "\nstdin = sys.stdin\nstdout = sys.stdout\n"


def with_prelude(code: str) -> str:
    """A program whose function is to be called."""
    return PRELUDE + code


def script_forms(code: str) -> tuple[str, str]:
    """A script that reads standard input, as a function code() and as a script, with the prelude before its first plain line.

    Imports of all names cannot stand in a function, so that form has them before it.
    """
    lines = code.split("\n")
    star = [x for x in lines if "import *" in x]
    plain = lambda x: x not in star and not x.startswith(("from ", "import "))
    first = next((i for i, x in enumerate(lines) if plain(x)), len(lines))
    head, body = lines[:first], lines[first:]
    text = lambda rows, indent="": "".join(f"{indent}{x}\n" for x in rows)
    if not body:
        return text(x for x in head if x not in star), text(head)
    names = "\n".join(x.lstrip("\t") for x in star)
    function = text(x for x in head if x not in star) + PRELUDE + names + STREAMS + "def code():\n" + text((x for x in body if x not in star), "\t")
    return function, text(head) + PRELUDE + STREAMS + text(body)


def _each(function, kind: DataType):
    """A pandas function over strings; nulls stay null."""

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(function, na_action="ignore")

    return run


def _each_pair(function, kind: DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)])

    return run


standardise_code = _each(standardise, StringType())
tokenise_code = _each(code_tokens, ArrayType(StringType()))
body_of = _each(function_body, StringType())
code_of_response = _each(response_code, StringType())
function_named = _each(function_name, StringType())
opened = _each(without_main_guard, StringType())
wrapped = _each(as_function_or_same, StringType())
whole_keys = _each(integer_keys, StringType())
prefixed = _each(with_prelude, StringType())
forms_of = _each(lambda code: list(script_forms(code)), ArrayType(StringType()))
right_side = _each(assert_right_side, StringType())
tests_of = _each(private_tests, StringType())
insert_doc = _each_pair(insert_docstring, StringType())
rouge_l_of = _each_pair(rouge_l, DoubleType())
chrf_of = _each_pair(chrf, DoubleType())
bleu_of = _each_pair(lambda a, b: sentence_bleu(list(a), list(b)), DoubleType())
bleu_counts_of = _each_pair(lambda a, b: bleu_counts(list(a), list(b)), ArrayType(LongType()))
rouges_of = _each_pair(lambda a, b: list(rouges(a, b)), ArrayType(DoubleType()))
meteor_of = _each_pair(meteor, DoubleType())
distance_of = _each_pair(lambda a, b: sequence_distance(list(a), list(b)), IntegerType())
leaf_lines_of = _each_pair(changed_leaf_lines, IntegerType())
codebleu_of = _each_pair(codebleu, DoubleType())
diff_of = _each_pair(structured_diff, ArrayType(StructType([StructField("type", StringType()), StructField("content", StringType())])))
equals_expected = _each_pair(expected_equal, BooleanType())


@F.pandas_udf(DoubleType())
def aligned_meteor_of(reference: pd.Series, prediction: pd.Series, words: pd.Series, synonyms: pd.Series) -> pd.Series:
    """meteor_aligned(), with the synonyms of a row as two lists: words, and a synonym for each."""

    def score(a, b, w, s):
        known: dict[str, set[str]] = {}
        for x, y in zip([] if w is None else w, [] if s is None else s):
            known.setdefault(x, set()).add(y)
        return None if a is None or b is None else meteor_aligned(a, b, known)

    return pd.Series([score(*row) for row in zip(reference, prediction, words, synonyms, strict=True)], dtype="Float64")


@F.pandas_udf(StructType([StructField("cyclomatic", IntegerType()), StructField("cognitive", IntegerType())]))
def complexity_of(code: pd.Series) -> pd.DataFrame:
    found = [complexities(c) if isinstance(c, str) else (None, None) for c in code]
    return pd.DataFrame({"cyclomatic": pd.array([a for a, _ in found], "Int32"), "cognitive": pd.array([b for _, b in found], "Int32")})
