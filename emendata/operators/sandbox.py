"""Running untrusted programs: opt-in, each in a supervised child process (runner.py).

The registered queries run fixed programs only (plans/sandboxed.py), and none from a table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .runner import Runner, shared

VERDICT = "status string, details map<string,string>, tests_run int, failures int, errors int, skipped int, was_successful boolean"
CODES = "codes array<int>, metadata string"
#: Fixed limits, in seconds.
SOLUTION_SECONDS, TEST_SECONDS, ASSERTION_SECONDS, VERIFY_SECONDS = 240, 6, 3, 60
MOST_TESTS = 5
#: Fixed texts of failed tests.
MESSAGES = {-2: "Wrong Answer", -3: "Time Limit Exceeded", -4: "Runtime Error"}
TRUNCATED = "...(truncated) ..."
# What the strict grader puts before a program.
ALL_OF = "string re datetime collections heapq bisect copy math random statistics itertools functools operator io sys json builtins typing".split()
BY_NAME = ALL_OF[:-2]
STRICT_PRELUDE = "".join(f"from {m} import *\n" for m in ALL_OF) + "".join(f"import {m}\n" for m in BY_NAME) + "sys.setrecursionlimit(50000)\n"


def run_unittest(code: str, test: str, seconds: float = SOLUTION_SECONDS, runner: Runner | None = None) -> dict:
    blank = {"details": {}, "tests_run": 0, "failures": 0, "errors": 0, "skipped": 0, "was_successful": False}
    with (runner or shared()).session("unittest", code, seconds, seconds + 1, test=test) as (made, step):
        done = step(seconds + 1) if made["ended"] == "ok" else made
    if done["ended"] in ("over", "slow"):
        return blank | {"status": "timeout"}
    if done["ended"] != "ok":
        return blank | {"status": "fail", "details": {"ALL": done.get("text") or done.get("error") or done["ended"]}}
    run, failures, errors, skipped, good, details = done["result"]
    return {"status": "pass" if good and not details else "fail", "details": details, "tests_run": run, "failures": failures, "errors": errors, "skipped": skipped, "was_successful": good}


def _short(value: object, length: int = 300) -> str:
    text = str(value)
    return text if len(text) <= length else f"{text[: length // 2]}{TRUNCATED}{text[-(length // 2) :]}"


def run_graded(code: str, tests: list[tuple[str, str]], name: str | None, seconds: float = TEST_SECONDS, runner: Runner | None = None) -> tuple[list[int], dict]:
    """A code for each test up to the first that fails (1 right, -2 wrong, -3 too slow, -4 an error), and what failed.

    One child runs all tests of a program: a function is called on one object, a script becomes a function that
    reads and writes real streams. A timer within the child ends each test. All tests together may take a second
    more for each and five in all; the child is killed then, within whatever test, and every one counts as -1. A
    program that cannot be prepared, has no such function, or whose tests are no JSON gives [-4]. A grader that
    fails itself gives [-2] and the error code -5.
    """
    from ..functions.code import as_function_or_same, without_main_guard
    from ..functions.compare import decimals_equal

    begin = time.monotonic()
    try:
        if not tests:
            return [], {"execution time": 0.0}
        end = begin + (seconds + 1) * len(tests) + 5
        overdue = [-1] * len(tests), {"error": "global timeout", "error_code": -1, "error_message": "Time Limit Exceeded"}
        program = STRICT_PRELUDE + "\n" + (code if name else as_function_or_same(without_main_guard(code)))
        out: list[int] = []
        with (runner or shared()).session("call" if name else "stdio", program, seconds, end - time.monotonic(), name=name or "wrapped_function") as (made, step):
            if made["ended"] == "over":
                return overdue
            if made["ended"] != "ok":
                return [-4], {"error_code": -4, "error_message": f"Error during testing: {made.get('text') or made['ended']}"}
            for given, want in tests:
                if name and not (_is_json(want) and all(_is_json(x) for x in given.split("\n"))):
                    return [-4], {"error_code": -4, "error_message": "Error during testing: a test is no JSON"}
                done = step(max(0.0, end - time.monotonic()), input=given, expected=want)
                if done["ended"] == "over":
                    return overdue
                right = done["ended"] == "ok" and (done["right"] if name else decimals_equal(done["output"], want))
                out.append(-3 if done["ended"] == "slow" else -4 if done["ended"] != "ok" else 1 if right else -2)
                if out[-1] != 1:
                    about = {"inputs": _short(given), "expected": _short(want), "error_code": out[-1], "error_message": MESSAGES[out[-1]]}
                    return out, about | ({"output": _short(done["output"])} if out[-1] == -2 else {"error": done.get("error", done["ended"])})
    except Exception as e:  # noqa: BLE001  the grader's own failure is a verdict
        return [-2], {"error": repr(e), "error_code": -5, "error_message": "TestRunnerError"}
    return out, {"execution time": time.monotonic() - begin}


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def run_tests(code: str, tests: list[tuple[str, str]], name: str | None, seconds: float = TEST_SECONDS) -> list[int]:
    return run_graded(code, tests, name, seconds)[0]


def verify(code: str, tests: list[tuple[str, str]], name: str | None = None, seconds: float = VERIFY_SECONDS, most: int = MOST_TESTS, runner: Runner | None = None) -> list[int]:
    """The lenient verifier: 1 passed, 0 false, -1 too slow, -3 an error, up to the first that is not 1; -2 if it does not compile.

    Of more than ``most`` tests those of longest input count. A script runs anew for each test; one whose first
    test ends with return code 1 is tried once more as a function. A function is prepared once; a result also
    passes if it equals the first element of an expected list.
    """
    from ..functions.code import parses, script_forms, with_prelude
    from ..functions.compare import lenient_equal

    if len(tests) > most:
        tests = sorted(tests, key=lambda t: -len(t[0]))[:most]
    if not parses(code):
        return [-2]

    def scripted(program: str) -> tuple[list[int], int]:
        out: list[int] = []
        for given, want in tests:
            got, _, code_no = (runner or shared()).script(program, given, seconds)
            out.append(-1 if got is None else -3 if code_no else int(lenient_equal(got.rstrip("\n"), want)))
            if out[-1] <= 0:
                return out, code_no
        return out, 0

    if name:
        out: list[int] = []
        with (runner or shared()).session("call", with_prelude(code), seconds, seconds + 1, name=name, lenient=True) as (made, step):
            if made["ended"] != "ok":
                return [-1] if made["ended"] in ("over", "slow") else [-2] if "AttributeError" in made.get("error", "") else [-3]
            for given, want in tests:
                done = step(seconds + 1, input=given, expected=want)
                out.append(-1 if done["ended"] in ("over", "slow") else -3 if done["ended"] != "ok" else int(done["right"]))
                if out[-1] <= 0:
                    break
        return out
    function, script = script_forms(code)
    out, code_no = scripted(script)
    if out == [-3] and code_no == 1:
        out, _ = scripted(f"{function}\ncode()\n")
    return out


def verified(df: DataFrame, code: str = "code", tests: str = "tests", name: str = "fn_name", seconds: float = VERIFY_SECONDS, most: int = MOST_TESTS) -> DataFrame:
    """``df`` with codes of verify() and passed: whether there is a test and all pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = [verify(c or "", [(t["input"], t["output"]) for t in (ts if ts is not None else [])], n if isinstance(n, str) else None, seconds, most) for c, ts, n in zip(frame[code], frame[tests], frame[name], strict=True)]
            yield frame.assign(codes=codes, passed=[bool(c) and all(x == 1 for x in c) for c in codes])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, codes array<int>, passed boolean")


def run_assertion(code: str, output: str, generation: str, seconds: float = ASSERTION_SECONDS) -> bool:
    """Whether the program's known output equals what a generation says it is."""
    out, _, code_no = shared().script(f"{code}\nassert {output} == {generation}\n", "", seconds)
    return out is not None and code_no == 0


def execution_results(df: DataFrame, seconds: float = ASSERTION_SECONDS) -> DataFrame:
    """(id, graded): a verdict for each generation that does not quote the input; all wrong where every one does.

    ``df`` has id, code, input, output and generations.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                used = [g for g in r.generations if r.input not in g]
                rows.append((r.id, [run_assertion(r.code, r.output, g, seconds) for g in used] or [False] * len(r.generations)))
            yield pd.DataFrame(rows, columns=["id", "graded"])

    return df.select("id", "code", "input", "output", "generations").mapInPandas(run, "id string, graded array<boolean>")


def execute_solutions(df: DataFrame, code: str = "solution", test: str = "test_code", seconds: float = SOLUTION_SECONDS) -> DataFrame:
    """``df`` with VERDICT. Repartition before it: rows are slow and uneven."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in VERDICT.split(", ")]
        for frame in frames:
            rows = [run_unittest(c or "", t or "", seconds) for c, t in zip(frame[code], frame[test], strict=True)]
            yield pd.concat([frame, pd.DataFrame(rows, columns=names, index=frame.index)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {VERDICT}")


def grade(df: DataFrame, code: str = "code", tests: str = "tests", name: str = "fn_name", seconds: float = TEST_SECONDS) -> DataFrame:
    """``df`` with CODES from its tests, array<struct<input, output>>; by standard input where the name is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            graded = [run_graded(c or "", [(t["input"], t["output"]) for t in (ts if ts is not None else [])], n if isinstance(n, str) else None, seconds) for c, ts, n in zip(frame[code], frame[tests], frame[name], strict=True)]
            yield frame.assign(codes=[c for c, _ in graded], metadata=[json.dumps(m) for _, m in graded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {CODES}")
