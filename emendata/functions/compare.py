"""Comparison of a program's output with what is expected; no program is run here."""

from __future__ import annotations

import math
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

RELATIVE, ABSOLUTE = 1e-05, 1e-08


def decimals_equal(got: str, want: str) -> bool:
    """Lines compared stripped, then line by line as exact decimals of any size; another number of lines is unequal."""
    a, b = ([line.strip() for line in text.strip().split("\n")] for text in (got, want))
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        if x == y:
            continue
        try:
            if [Decimal(t) for t in x.split()] != [Decimal(t) for t in y.split()]:
                return False
        except InvalidOperation:
            return False
    return True


def _close(x: str, y: str) -> bool | None:
    """Whether two numbers agree, null where either is none."""
    try:
        a, b = float(x), float(y)
    except ValueError:
        return None
    return math.isclose(a, b, rel_tol=0, abs_tol=ABSOLUTE + RELATIVE * abs(b)) or a == b


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.split("\n") if line.strip()]


def text_equal(got: str, want: str) -> bool:
    """Equal when stripped, as numbers, or as rows of words; words that differ and are not both numbers pass.

    That last rule is lenient on purpose: results must match those graded so far.
    """
    got, want = got.strip(), want.strip()
    close = None if got == want else _close(got, want)
    if got == want or close is not None:
        return got == want or close
    a, b = _rows(got), _rows(want)
    return len(a) == len(b) and all(len(x) == len(y) and all(p == q or _close(p, q) is not False for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def _sets(rows: list[list[str]], digits: int | None = None) -> set[frozenset] | None:
    try:
        return {frozenset(w if digits is None else round(float(w), digits) for w in row) for row in rows}
    except ValueError:
        return None


def lenient_equal(got: str | list[str], want: str | list[str]) -> bool:
    """The lenient cascade for standard output: as text, as lists of lines, as numbers, as sets of sets of words."""
    shown = got if isinstance(got, str) else "\n".join(got)
    wanted = want if isinstance(want, str) else "\n".join(want)
    if text_equal(shown, wanted):
        return True
    have = [x.strip() for x in (shown.split("\n") if isinstance(got, str) else got) if x.strip()]
    need = [x.strip() for x in (wanted.split("\n") if isinstance(want, str) else want) if x.strip()]
    if have == need:
        return True
    if len(have) == len(need) and all(_close(x, y) for x, y in zip(have, need, strict=True)):
        return True
    a, b = [x.split() for x in have], [x.split() for x in need]
    if _sets(a) == _sets(b):
        return True
    return (rounded := _sets(a, 3)) is not None and rounded == _sets(b, 3)


def _pairs(function):
    @F.pandas_udf(BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)])

    return run


lenient = _pairs(lenient_equal)
decimals = _pairs(decimals_equal)


def stdout_equal(got: Column, want: Column) -> Column:
    """decimals_equal() as a column; null where either output is."""
    return decimals(got, want)
