"""All queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, files, harness, mutations, programs, prompt_styles, relations, sandboxed, scores, texts, training

_MODULES = (scores, relations, harness, texts, programs, mutations, prompt_styles, files, checks, sandboxed, training)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
