"""A program's first function as a list of syntax nodes with places in its text, which expressions can filter and edit.

A node is (kind, name, form, start, end, parts). Its parts are its own pieces, each (role, n, kind, start, end, value,
number): operands, operators, arguments, keywords and the points where more can be put. Places count characters.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .code import first_function, parses

_TEXT, _PLACE = StringType(), IntegerType()
PART = StructType([StructField(n, t) for n, t in (("role", _TEXT), ("n", _PLACE), ("kind", _TEXT), ("start", _PLACE), ("end", _PLACE), ("value", _TEXT), ("number", LongType()))])
NODE = StructType([StructField(n, t) for n, t in (("kind", _TEXT), ("name", _TEXT), ("form", _TEXT), ("start", _PLACE), ("end", _PLACE), ("parts", ArrayType(PART)))])
#: text is the program in standard layout; args_start and args_end enclose what must not change.
SYNTAX = StructType([StructField(n, t) for n, t in (("text", _TEXT), ("error", _TEXT), ("args_start", _PLACE), ("args_end", _PLACE), ("nodes", ArrayType(NODE)))])

#: Programs that Python holds at a time as lists of nodes, which are many times as large as the texts.
SLICE = 128


class _Places:
    def __init__(self, text: str):
        self.text, self.begins, self.lines = text, [0], text.split("\n")
        for line in self.lines:
            self.begins.append(self.begins[-1] + len(line) + 1)

    def at(self, line: int, byte: int) -> int:
        whole = self.lines[line - 1]
        return self.begins[line - 1] + (byte if whole.isascii() else len(whole.encode()[:byte].decode()))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def between(self, left: ast.AST, right: ast.AST) -> tuple[int, int]:
        """The operator between two operands: what is left of the gap without spaces and brackets."""
        low, high = self.span(left)[1], self.span(right)[0]
        gap = self.text[low:high]
        bare = gap.strip(" ()\n")
        low += gap.index(bare)
        return low, low + len(bare)


def _whole(value: object) -> int | None:
    return int(value) if isinstance(value, int) and abs(value) < 1 << 62 else None


def _part(p: _Places, role: str, node: ast.AST, n: int = 0) -> tuple:
    """A piece with what expressions ask of it: a constant's type and value, a list's length, what a call calls."""
    kind, value, number = type(node).__name__, None, None
    if isinstance(node, ast.Constant):
        kind, value, number = type(node.value).__name__, str(node.value), _whole(node.value)
    elif isinstance(node, ast.List):
        number = len(node.elts)
    elif isinstance(node, ast.Name):
        value = node.id
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        value = node.func.id
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        kind = "Not"
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and (number := _whole(node.operand.value)) is not None:
        kind = "Negative"
    return (role, n, kind, *p.span(node), value, number)


def _point(role: str, at: int, value: str = "") -> tuple:
    return (role, 0, "point", at, at, value, None)


def _of_call(p: _Places, node: ast.Call) -> tuple[str | None, str | None, list[tuple]]:
    parts, end = [], p.span(node)[1]
    func_end = p.span(node.func)[1]
    name = form = None
    if isinstance(node.func, ast.Name):
        name, form = node.func.id, "name"
    elif isinstance(node.func, ast.Attribute):
        name, form = node.func.attr, "method"
        parts.append(_part(p, "object", node.func.value))
    if name:
        parts.append(("callee", 0, "name", func_end - len(name), func_end, name, None))
    for n, x in enumerate(node.args):
        parts.append(_part(p, "arg", x, n))
        if isinstance(x, ast.List) and x.elts:
            parts.append(_part(p, "arg.first", x.elts[0], n))
    for n, k in enumerate(node.keywords):
        parts += [("keyword", n, k.arg or "", *p.span(k), None, None), _part(p, f"={k.arg or ''}", k.value, n)]
    if node.args:
        parts.append(_point("args_end", p.span(node.args[-1])[1]))
    begin = p.text.index("(", func_end)
    parts += [("inside", 0, "text", begin + 1, end - 1, None, len(node.args)), _point("close", end - 1, ", " if node.args or node.keywords else "")]
    return name, form, parts


def _parts(p: _Places, node: ast.AST) -> tuple[str | None, str | None, list[tuple]]:
    """(name, form, parts) of a node."""
    if isinstance(node, ast.Call):
        return _of_call(p, node)
    if isinstance(node, ast.Constant):
        return str(node.value), type(node.value).__name__, [_part(p, "self", node)]
    parts: list[tuple] = []
    if isinstance(node, ast.Compare):
        sides = [node.left, *node.comparators]
        parts = [("op", i, type(op).__name__, *p.between(sides[i], sides[i + 1]), None, len(node.ops)) for i, op in enumerate(node.ops)]
        parts += [_part(p, "comparator", c, i) for i, c in enumerate(node.comparators)]
    elif isinstance(node, ast.BinOp):
        parts = [("op", 0, type(node.op).__name__, *p.between(node.left, node.right), None, None)]
    elif isinstance(node, ast.BoolOp):
        parts = [_part(p, "value", v, i) for i, v in enumerate(node.values)]
    elif isinstance(node, ast.Assign):
        parts = [*[_part(p, "target", t, i) for i, t in enumerate(node.targets)], _part(p, "value", node.value)]
    elif isinstance(node, ast.If):
        parts = [_part(p, "test", node.test)]
        if isinstance(node.test, ast.UnaryOp):
            parts.append(_part(p, "test.operand", node.test.operand))
        if isinstance(node.test, ast.Compare):
            parts += [_part(p, "comparator", c, i) for i, c in enumerate(node.test.comparators)]
    elif isinstance(node, ast.Subscript):
        at = node.slice
        parts = [_part(p, "slice", at)]
        if isinstance(at, ast.BinOp):
            parts += [_part(p, "slice.left", at.left), ("slice.op", 0, type(at.op).__name__, 0, 0, None, None), _part(p, "slice.right", at.right)]
        if isinstance(at, ast.Slice):
            parts += [_part(p, role, bound) for role in ("lower", "upper") if (bound := getattr(at, role)) is not None]
    elif isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp)):
        held = next((g for g in node.generators if g.ifs), None)
        if held is not None:
            low, high = p.span(held.ifs[0])
            begin = p.text.rindex(" if ", 0, low)
            parts = [("filter", 0, "text", begin, high + p.text[begin:low].count("("), None, None)]
    return None, None, parts


def syntax(code: str | None) -> tuple:
    """SYNTAX of a program: its first function's nodes in the order of a walk by levels."""
    if code is None:
        return None, "no code", None, None, None
    if not parses(code):
        return None, "the code does not parse", None, None, None
    text = ast.unparse(ast.parse(code))
    function = first_function(ast.parse(text))
    if function is None:
        return None, "no function", None, None, None
    p = _Places(text)
    spans = [p.span(n) for n in ast.walk(function.args) if hasattr(n, "lineno")]
    nodes = []
    for node in ast.walk(function):
        if isinstance(node, (ast.expr, ast.stmt)) and node is not function:
            name, form, parts = _parts(p, node)
            start, end = p.span(node)
            nodes.append((type(node).__name__, name, form, start, end, [(*x,) for x in parts]))
    return text, None, min((a for a, _ in spans), default=0), max((b for _, b in spans), default=0), nodes


def standard(code: str | None) -> str | None:
    """A program in standard layout; null if it does not parse."""
    return ast.unparse(ast.parse(code)) if code is not None and parses(code) else None


def _mapped(df: DataFrame, column: str, kinds: StructType, function) -> DataFrame:
    """``df`` with the columns ``kinds``, which ``function`` gives for each value of a column, as dicts."""
    from pyspark.sql.pandas.types import to_arrow_type

    at, types = df.columns.index(column), [to_arrow_type(f.dataType) for f in kinds.fields]
    names, new = [*df.columns, *kinds.names], kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                rows = [function(x) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[n] for r in rows], t) for n, t in zip(new, types, strict=True)]], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *kinds.fields]))


def _shaped(code: str | None) -> dict:
    text, error, low, high, nodes = syntax(code)
    found = None if nodes is None else [dict(zip(NODE.names, n[:5])) | {"parts": [dict(zip(PART.names, x)) for x in n[5]]} for n in nodes]
    return dict(zip(SYNTAX.names, (text, error, low, high, found), strict=True))


def with_syntax(df: DataFrame, code: str) -> DataFrame:
    """``df`` with the columns of SYNTAX of the programs in a column."""
    return _mapped(df, code, SYNTAX, _shaped)


def with_standard(df: DataFrame, code: str, name: str) -> DataFrame:
    """``df`` with the programs of a column in standard layout."""
    return _mapped(df, code, StructType([StructField(name, StringType())]), lambda x: {name: standard(x)})
