"""Seeded program mutation: small edits that keep a function's signature, as expressions over a table of rules.

A rule says in SQL which syntax nodes it looks at, which of their parts it edits and what stands there afterwards; it
edits the first node, in a walk by levels, that it applies to. Python parses a program (syntax.py) and puts the
edited text in standard layout; which edits there are, their order and their draws are the engine's work. Draws and
orders are stable hashes of a row's key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import syntax

MOST_BASE, MOST_EXTRA = 2, 10
#: Rounds of mutation in one stage: a task has a Python worker for each of them at once, and one more at the end.
ROUNDS = 2


@dataclass(frozen=True)
class Rule:
    """SQL over a node ``n``, its part ``p``, the program's ``text`` and ``draw``; the first part that fits is edited."""

    name: str
    where: str
    part: str
    becomes: str
    start: str = "p.start"
    end: str = "p.end"
    #: A rule for programs to which this one does not apply.
    otherwise: "Rule | None" = None

    def edits(self, nodes: str = "nodes") -> str:
        """SQL for the list of the rule's edits, of which the first counts."""
        part = f"transform(slice(filter(n.parts, p -> {self.part}), 1, 1), p -> named_struct('start', {self.start}, 'end', {self.end}, 'text', {self.becomes}))"
        found = f"slice(flatten(transform(filter({nodes}, n -> {self.where}), n -> {part})), 1, 1)"
        return f"concat({found}, {self.otherwise.edits(nodes)})" if self.otherwise else found


def _text(of: str) -> str:
    return f"substring(text, {of}.start + 1, {of}.end - {of}.start)"


def _first(role: str) -> str:
    return f"get(filter(n.parts, q -> q.role = '{role}'), 0)"


def _has(role: str, more: str = "TRUE") -> str:
    return f"exists(n.parts, q -> q.role = '{role}' AND {more})"


def _swap(of: str, **table: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def _names(*names: str) -> str:
    return ", ".join(f"'{x}'" for x in names)


SELF = "n.start", "n.end"
ARGS = f"{_first('inside')}.number"
COMPARISONS = {"Lt": "<=", "LtE": "<", "Gt": ">=", "GtE": ">", "Eq": "!=", "NotEq": "=="}
ARITHMETIC = {"Add": "-", "Sub": "+", "Mult": "//", "FloorDiv": "/"}
CALLS = {"mean": "median", "max": "min", "sum": "len"}
_PLUS = "CASE draw % 2 WHEN 0 THEN ' + 1' ELSE ' - 1' END"
_MINUS = "CASE draw % 2 WHEN 0 THEN ' - 1' ELSE ' + 1' END"


def _call(name: str | tuple[str, ...], form: str | None = "name") -> str:
    names = (name,) if isinstance(name, str) else name
    return f"n.kind = 'Call' AND n.name IN ({_names(*names)})" + (f" AND n.form = '{form}'" if form else "")


_SORTS = f"({_call('sorted')} OR {_call(('sort', 'sort_values'), 'method')})"
_ORDER = "CASE n.name WHEN 'sorted' THEN 'reverse' ELSE 'ascending' END"
_FLIP = "CASE p.value WHEN 'True' THEN 'False' ELSE 'True' END"
_GIVEN = "q.role IN ('=reverse', '=ascending')"
_ZERO_ONE = "(p.number IN (0, 1) OR p.kind = 'float' AND TRY_CAST(p.value AS DOUBLE) IN (0, 1))"
_ONE = "(q.number = 1 AND q.kind IN ('int', 'bool') OR q.kind = 'float' AND TRY_CAST(q.value AS DOUBLE) = 1)"
_INT = "p.kind IN ('int', 'bool') AND p.number IS NOT NULL"

BASE = (
    Rule("comparison_operators", "n.kind = 'Compare'", f"p.role = 'op' AND p.kind IN ({_names(*COMPARISONS)})", _swap("p.kind", **COMPARISONS)),
    # the end of range(n) moves by one either way; range(a, b) loses its last or its first number
    Rule("range_bounds", f"{_call('range')} AND {ARGS} IN (1, 2)", f"p.role = 'arg' AND p.n = CASE WHEN {ARGS} = 2 AND draw % 2 = 0 THEN 1 ELSE 0 END", f"concat('(', {_text('p')}, ')', {_MINUS})"),
    # an order is flipped, or given where there is none; one that is no constant cannot be given twice
    Rule(
        "sort_order",
        _SORTS,
        f"p.role IN ('=reverse', '=ascending') AND p.kind = 'bool' OR p.role = 'close' AND NOT exists(n.parts, q -> {_GIVEN} AND q.kind = 'bool') AND NOT exists(n.parts, q -> q.role = concat('=', {_ORDER}))",
        f"CASE p.role WHEN 'close' THEN concat(p.value, {_ORDER}, '=False') ELSE {_FLIP} END",
    ),
    Rule(
        "accumulator_init",
        f"n.kind = 'Assign' AND size(filter(n.parts, q -> q.role = 'target')) = 1 AND {_has('target', chr(39).join(('q.kind = ', 'Name', ' AND lower(q.value) RLIKE ', 'sum|total|count', '')))}",
        "p.role = 'value' AND (p.number = 0 AND p.kind IN ('int', 'bool', 'List') OR p.kind = 'float' AND TRY_CAST(p.value AS DOUBLE) = 0)",
        "CASE p.kind WHEN 'List' THEN '[0]' ELSE '1' END",
    ),
    Rule("arithmetic_operators", "n.kind = 'BinOp'", f"p.role = 'op' AND p.kind IN ({_names(*ARITHMETIC)})", _swap("p.kind", **ARITHMETIC)),
    # a negation goes, else the first comparison with 0 or 1 gets the other of the two
    Rule(
        "edge_case_guards",
        "n.kind = 'If'",
        f"p.role = 'test' AND p.kind = 'Not' OR p.role = 'comparator' AND {_ZERO_ONE}",
        f"CASE WHEN p.role = 'test' THEN concat('(', {_text(_first('test.operand'))}, ')') WHEN p.kind = 'float' THEN CAST(1 - TRY_CAST(p.value AS DOUBLE) AS STRING) ELSE CAST(1 - p.number AS STRING) END",
    ),
    Rule(
        "list_indexing",
        "n.kind = 'Subscript'",
        f"p.role = 'slice' AND (p.kind = 'BinOp' AND {_has('slice.op', chr(39).join(('q.kind IN (', 'Add', ', ', 'Sub', ')')))} AND {_has('slice.right', _ONE)} OR {_INT} AND p.number >= 0)",
        f"CASE p.kind WHEN 'BinOp' THEN concat('(', {_text(_first('slice.left'))}, ')') ELSE CAST(p.number + 1 AS STRING) END",
    ),
    Rule("function_call_name", _call(tuple(CALLS), None), "p.role = 'callee'", _swap("p.value", **CALLS)),
    Rule("remove_copy_calls", f"{_call('copy', 'method')} AND {ARGS} = 0 AND NOT {_has('keyword')}", "p.role = 'object'", f"concat('(', {_text('p')}, ')')", *SELF),
    Rule("boolean_constants", "n.kind = 'Constant' AND n.form = 'bool'", "p.role = 'self'", _FLIP),
    Rule(
        "numeric_constants",
        "n.kind = 'Constant'",
        "p.kind = 'int' AND p.number NOT IN (0, 1) OR p.kind = 'float'",
        "CASE p.kind WHEN 'int' THEN CAST(p.number + CASE draw % 2 WHEN 0 THEN 1 ELSE -1 END AS STRING) ELSE CAST(TRY_CAST(p.value AS DOUBLE) + CASE draw % 2 WHEN 0 THEN 0.1D ELSE -0.1D END AS STRING) END",
    ),
    # a constant bound v, the lower one first, becomes v + 1 or 2v - 1
    Rule("slice_bounds", "n.kind = 'Subscript'", f"p.role IN ('lower', 'upper') AND {_INT}", "CAST(CASE draw % 2 WHEN 0 THEN p.number + 1 ELSE 2 * p.number - 1 END AS STRING)"),
    Rule("conditional_inversion", "n.kind = 'BoolOp'", "p.kind <> 'Not'", f"concat('not (', {_text('p')}, ')')"),
    # a range without a step gets 2, also as its second argument; a constant step grows by one
    Rule("range_step", _call("range"), f"p.role = 'args_end' AND {ARGS} IN (1, 2) OR p.role = 'arg' AND {ARGS} = 3 AND p.n = 2 AND {_INT}", "CASE WHEN p.role = 'args_end' THEN ', 2' WHEN p.number = 0 THEN '2' ELSE CAST(p.number + 1 AS STRING) END"),
)


def _renamed(name: str, form: str | None, **table: str) -> Rule:
    """Calls of a name get the name beside it."""
    return Rule(name, _call(tuple(table), form), "p.role = 'callee'", _swap("p.value", **table))


_NONE = {"Eq": "is", "Is": "==", "NotEq": "is not", "IsNot": "!="}
_KEPT = f"array_join(transform(filter(n.parts, q -> q.role = 'arg' OR q.role = 'keyword' AND q.kind <> 'key'), q -> {_text('q')}), ', ')"
_ARG = f"get(filter(n.parts, q -> q.role = 'arg' AND q.n = {{}}), 0)"
EXTRA = (
    _renamed("min_max_usage", None, min="max", max="min"),
    _renamed("string_lower_upper", "method", lower="upper", upper="lower"),
    _renamed("strip_variant", "method", strip="rstrip", rstrip="strip", lstrip="strip"),
    _renamed("set_vs_list_cast", "name", set="list", list="set"),
    _renamed("round_to_int", "name", round="int", int="round"),
    _renamed("find_vs_index", "method", find="index", index="find"),
    _renamed("any_all_swap", "name", any="all", all="any"),
    Rule("dict_items_variant", _call(("items", "keys", "values"), "method"), "p.role = 'callee'", "get(CASE p.value WHEN 'items' THEN array('keys', 'values') WHEN 'keys' THEN array('items', 'values') ELSE array('items', 'keys') END, CAST(draw % 2 AS INT))"),
    # append(x) becomes extend([x]); extend of a list that is written out becomes append of its first element
    Rule(
        "append_extend",
        f"{_call(('append', 'extend'), 'method')} AND {ARGS} = 1 AND NOT {_has('keyword')}",
        "p.role = 'arg' AND n.name = 'append' OR p.role = 'arg.first' AND n.name = 'extend'",
        f"CASE n.name WHEN 'append' THEN concat('extend([', {_text('p')}, '])') ELSE concat('append(', {_text('p')}, ')') END",
        f"{_first('callee')}.start",
        "n.end",
    ),
    # the first abs(x) is unwrapped; where there is none, the first operation is wrapped
    Rule("abs_usage", f"{_call('abs')} AND {ARGS} = 1", "p.role = 'arg'", f"concat('(', {_text('p')}, ')')", *SELF, otherwise=Rule("abs_usage", "n.kind = 'BinOp'", "p.role = 'op'", f"concat('abs(', {_text('n')}, ')')", *SELF)),
    # a constant start becomes 0 if it is 1, else 1; a call without one gets start=1
    Rule("enumerate_start", _call("enumerate"), f"p.role = '=start' AND {_INT} OR p.role = 'close' AND NOT {_has('=start')}", "CASE WHEN p.role = 'close' THEN concat(p.value, 'start=1') WHEN p.number = 1 THEN '0' ELSE '1' END"),
    # get(x) gets the default 1; a constant whole number becomes 0 if it is 1, else 1
    Rule("dict_get_default", _call("get", "method"), f"p.role = 'args_end' AND {ARGS} = 1 OR p.role = 'arg' AND p.n = 1 AND {_INT}", "CASE WHEN p.role = 'args_end' THEN ', 1' WHEN p.number = 1 THEN '0' ELSE '1' END"),
    Rule("join_separator", f"{_call('join', 'method')}", "p.role = 'object' AND p.kind = 'str'", "concat('\\'', CASE p.value WHEN '' THEN ' ' WHEN ' ' THEN '' ELSE ',' END, '\\'')"),
    Rule("sorted_toggle_key_len", f"({_call('sorted')} OR {_call('sort', 'method')})", f"p.role = 'inside' AND {_has('=key')} OR p.role = 'close' AND NOT {_has('=key')}", f"CASE p.role WHEN 'inside' THEN {_KEPT} ELSE concat(p.value, 'key=len') END"),
    Rule("comp_filter_remove", "n.kind IN ('ListComp', 'SetComp', 'DictComp')", "p.role = 'filter'", "''"),
    Rule("zip_arg_order", f"{_call('zip')} AND {ARGS} > 1", "p.role = 'arg' AND p.n = 0", f"concat({_text(_ARG.format(1))}, ', ', {_text('p')})", "p.start", f"{_ARG.format(1)}.end"),
    Rule("len_range_endpoint", f"{_call('range')} AND {ARGS} = 1", "p.role = 'arg' AND p.kind = 'Call' AND p.value = 'len'", f"concat('(', {_text('p')}, ')', {_PLUS})"),
    # a negative constant index, or a slice's lower or else upper bound, moves one further from the end
    Rule("negative_indexing_shift", "n.kind = 'Subscript'", "p.role IN ('slice', 'lower', 'upper') AND p.kind = 'Negative'", "concat('-', CAST(p.number + 1 AS STRING))"),
    Rule("none_equality_operator", f"n.kind = 'Compare' AND {_has('comparator', 'q.n = 0 AND q.kind = ' + repr('NoneType'))}", f"p.role = 'op' AND p.number = 1 AND p.kind IN ({_names(*_NONE)})", _swap("p.kind", **_NONE)),
)
#: The first break in reading order becomes a continue.
_BREAK = Rule("break_to_continue", "", "", "")
FAMILIES = {"base": (*BASE,), "extra": (*EXTRA, _BREAK), "both": (*BASE, *EXTRA, _BREAK)}


def _edit(rule: Rule) -> str:
    """SQL for a rule's edit of columns text, nodes and draw; null where it does not apply."""
    if rule is _BREAK:
        return "get(transform(slice(array_sort(transform(filter(nodes, n -> n.kind = 'Break'), n -> n.start)), 1, 1), s -> named_struct('start', s, 'end', s + 5, 'text', 'continue')), 0)"
    return f"get({rule.edits()}, 0)"


#: The text after an edit; null without one, and where it lies within the arguments.
_EDITED = "CASE WHEN edit.start >= args_end OR edit.end <= args_start THEN concat(substring(text, 1, edit.start), edit.text, substring(text, edit.end + 1)) END"


def mutated_by(rows: DataFrame, code: str, name: str, draw: str, out: str = "code") -> DataFrame:
    """``rows`` with each program after the mutation that column ``name`` names, with a given draw; null where it does not apply."""
    kept = [c for c in rows.columns if c != out]
    ready = rows.select(F.struct("*").alias("row"), F.col(name).alias("rule"), F.col(draw).alias("draw"), F.col(code).alias("code"))
    chosen = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {_edit(r)}" for r in FAMILIES["both"]) + " END"
    edited = syntax.with_syntax(ready, "code").withColumn("edit", F.expr(chosen)).select("row", F.expr(_EDITED).alias("edited"))
    return syntax.with_standard(edited, "edited", "made").select(*[F.col(f"row.`{c}`") for c in kept], F.col("made").alias(out))


def corrupt(rows: DataFrame, code: str, key: str, seed: int = 42, family: str = "base", most: int | None = None) -> DataFrame:
    """``rows`` with mutated: struct<code, mutations, error>: the first function with up to ``most`` mutations that leave its arguments.

    The rules come in an order of the row's own; one that does not apply when its turn comes is passed over. Null
    programs, and those that do not parse, have no function or fit no rule, have an error and no code.
    """
    rules = FAMILIES[family]
    rounds = min(most or (MOST_BASE if family == "base" else MOST_EXTRA), len(rules))
    now = rows.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(code).alias("code"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("applied"), F.lit(-(1 << 63)).cast("long").alias("turn"))
    options = ", ".join(f"named_struct('turn', xxhash64({seed}, key, '{r.name}'), 'name', '{r.name}', 'edit', {_edit(r)})" for r in rules)
    fits = "o.turn > turn AND o.edit IS NOT NULL AND (o.edit.start >= args_end OR o.edit.end <= args_start)"
    for n in range(rounds):
        if n and n % ROUNDS == 0:  # a shuffle ends the stage, so that the next one takes over its workers
            now = now.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # a program without a turn is done, and is not parsed again
        ready = now.select("row", "key", "code", F.col("error").alias("earlier"), "applied", "turn", F.when(F.col("turn").isNotNull(), F.col("code")).alias("todo"))
        parsed = syntax.with_syntax(ready, "todo").withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "key", F.lit(n)), F.lit(1 << 20)))
        chosen = parsed.withColumn("option", F.expr(f"array_min(filter(array({options}), o -> {fits}))")).withColumn("edit", F.col("option.edit"))
        applied = F.when(F.col("option").isNotNull(), F.concat("applied", F.array("option.name"))).otherwise(F.col("applied"))
        now = chosen.select("row", "key", F.when(F.col("option").isNotNull(), F.expr(_EDITED)).otherwise(F.col("code")).alias("code"), F.coalesce("earlier", F.col("error") if n == 0 else F.lit(None)).alias("error"), applied.alias("applied"), F.col("option.turn").alias("turn"))
    now = syntax.with_standard(now.drop("key", "turn"), "code", "made")
    done = F.size("applied") > 0
    mutated = F.struct(F.when(done, F.col("made")).alias("code"), F.col("applied").alias("mutations"), F.when(~done, F.coalesce("error", F.lit("no mutation fits"))).alias("error"))
    return now.select("row.*", mutated.alias("mutated"))
