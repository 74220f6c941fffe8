"""JSON lists read in splits, and sinks that survive a stop between any two steps."""

import json
import random

import pytest
from emendata.sources import batch_jobs, connectors, json_array
from emendata.sources.cache import PromptCache
from emendata.sources.versions import Conflict, VersionedTable, read, rewrite
from pyspark.sql import functions as F


def splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: splits(spark, size)
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice('ab{}[],:"\\\né😀 ') for _ in range(rng.randrange(30)))
    if kind < 4:
        return rng.choice([1, -2.5, None, True])
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {f"k{k}": value(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 2])
def test_lists_in_splits_of_any_size(spark, tmp_path, small_splits, indent):
    rng = random.Random(11 + (indent or 0))
    lists = {f"f{k}": [{"id": i, "v": value(rng), "long": "x}" * rng.choice([0, 3, 400])} for i in range(n)] for k, n in enumerate((60, 1, 0, 25))}
    for name, rows in lists.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(indent)) + ("\n" if indent else ""), encoding="utf-8")
    for size in (97, 700, 1 << 20):
        small_splits(size)
        read = json_array.read_elements(spark, str(tmp_path))
        got = {}
        for r in read.collect():
            got.setdefault(r._file.rsplit("/", 1)[1][:-5], []).append((r._block, r._n, json.loads(r.value)))
        assert {f: [v for _, _, v in sorted(x, key=lambda y: y[:2])] for f, x in got.items()} == {f: rows for f, rows in lists.items() if rows}


def test_one_list_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [{"question_id": str(k), "code_list": ["a}" * (k % 50)]} for k in range(2000)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    small_splits(4096)
    read = json_array.read_records(spark, str(tmp_path / "one.json"), "question_id string, code_list array<string>")
    blocks = {r._block for r in read.select("_block").distinct().collect()}
    assert len(blocks) > 20
    assert sorted((r.question_id, list(r.code_list)) for r in read.collect()) == sorted((r["question_id"], r["code_list"]) for r in rows)


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    rows = [{"a": 1}, {"a": ["}" * 5000, {"b": '"}{' * 2000}]}, {"a": 2}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    small_splits(512)
    got = [json.loads(r.value) for r in json_array.read_elements(spark, str(tmp_path / "l.json")).orderBy("_block", "_n").collect()]
    assert got == rows


@pytest.mark.parametrize("text", ['[{"a": 1}', '{"a": 1}', '[{"a": "1}]', '[{"a": 1}] x', '[{"a": 1}]]', 'x[{"a": 1}]', '[{"a": {}]'])
def test_what_is_no_list_fails(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="list|JSON|PARSE|parse|Malformed|MALFORMED"):
        json_array.read_records(spark, str(tmp_path / "bad.json"), "a int").collect()


def ids(spark, path):
    return sorted(r.id for r in read(spark, path, "id long").collect())


class Stopped(Exception):
    pass


def stopping(at):
    def step(name):
        if name == at:
            raise Stopped(name)

    return step


def test_rewrite_of_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(6).write.json(path)
    for k in range(4):
        rewrite(read(spark, path, "id long").filter(f"id > {k}"), path)
        assert ids(spark, path) == list(range(k + 1, 6))
    names = {p.name for p in (tmp_path / "t").iterdir()}
    assert len([n for n in names if n.startswith("data-")]) == 2 and len(list((tmp_path / "t" / "_versions").glob("*.json"))) == 2
    assert names == {n for n in names if n.startswith("data-")} | {"_versions"}  # the plain files went with version 0


@pytest.mark.parametrize("at", ["data", "manifest", "publish", "vacuum"])
@pytest.mark.parametrize("plain", [True, False])
def test_a_writer_that_stops_between_steps(spark, tmp_path, at, plain):
    """Before it publishes, readers see the old version; after, the new one; the next writer goes on from there."""
    path = str(tmp_path / "t")
    spark.range(3).write.json(path)
    if not plain:
        rewrite(spark.range(3).select((F.col("id") + 10).alias("id")), path)
    before = ids(spark, path)
    with pytest.raises(Stopped):
        VersionedTable(spark, path, stopping(at)).rewrite(read(spark, path, "id long").withColumn("id", F.col("id") + 100))
    after = [i + 100 for i in before] if at == "vacuum" else before
    assert ids(spark, path) == after
    rewrite(read(spark, path, "id long").withColumn("id", -F.col("id")), path)
    assert ids(spark, path) == sorted(-i for i in after)
    used = {f.split("/")[0] for n in VersionedTable(spark, path).numbers() for f in VersionedTable(spark, path)._version(n).parts.values()}
    assert {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")} == used  # nothing is left of it
    assert not [p for p in (tmp_path / "t" / "_versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_readers_keep_their_version_and_second_writers_fail(spark, tmp_path):
    path = str(tmp_path / "t")
    rewrite(spark.range(4), path)
    old, table = read(spark, path, "id long"), VersionedTable(spark, path)
    base = table.current()
    rewrite(spark.range(2), path)
    assert old.count() == 4 and ids(spark, path) == [0, 1]
    with pytest.raises(Conflict):
        table.publish({"all": "data-late"}, base)
    assert ids(spark, path) == [0, 1]
    rewrite(spark.range(0), path)
    assert ids(spark, path) == []


def test_cache_rewrites_touched_buckets_only(spark, tmp_path):
    cache = PromptCache(spark, str(tmp_path / "c"), buckets=8)
    rows = lambda items: spark.createDataFrame([(p, [o] if o is not None else None, k) for k, (p, o) in enumerate(items)], "prompt string, outputs array<string>, place int")
    shown = lambda: {r.prompt: list(r.outputs) for r in cache.read().collect()}
    assert shown() == {} and cache.upsert(rows([])) == set()
    asked = spark.createDataFrame([(f"p{k}",) for k in range(40)], "prompt string")
    assert cache.lookup(asked, 1)[1].count() == 40
    cache.upsert(rows([(f"p{k}", f"a{k}") for k in range(30)] + [("p3", "later"), (None, "x")]))
    hits, misses = cache.lookup(asked, 1)
    assert hits.count() == 30 and misses.count() == 10
    assert shown()["p3"] == ["later"] and len(shown()) == 30
    before = cache.table.current()
    touched = cache.upsert(rows([("p5", "new"), ("q", "q")]))
    now = cache.table.current()
    assert len(touched) <= 2 and {b for b in now.parts if now.parts[b] != before.parts.get(b)} == {str(b) for b in touched}
    assert shown() == {f"p{k}": [f"a{k}"] for k in range(30)} | {"p3": ["later"], "p5": ["new"], "q": ["q"]}
    cache.table.vacuum(keep=1)
    assert len(shown()) == 31 and cache.lookup(asked, 2)[0].count() == 0


def line(k, text=None, error=None):
    answer = {"response": {"body": {"choices": [{"message": {"content": text}}]}}} if error is None else {"error": error}
    return json.dumps({"custom_id": f"r{k}"} | answer)


def test_polls_read_each_part_once_and_go_on_after_a_stop(spark, tmp_path):
    job, out, state = tmp_path / "job", str(tmp_path / "out"), str(tmp_path / "state")
    requests = spark.createDataFrame([(f"r{k}", f"p{k}") for k in range(7)], "custom_id string, prompt string")
    options = {"path": job.as_uri()}

    def part(name, lines, complete=True):
        (job / "parts" / name).mkdir(parents=True, exist_ok=True)
        (job / "parts" / name / "a.jsonl").write_text("\n".join(lines) + "\n\n")
        if complete:
            (job / "parts" / name / "_SUCCESS").touch()

    late = iter([lambda: part("1-output", [line(3, "c"), line(0, "a")]), lambda: part("2-output", [line(9, "half")], complete=False), lambda: None])
    with pytest.raises(TimeoutError):
        batch_jobs.collect_job(requests, out, state, wait=lambda: next(late)(), most_polls=3, **options)
    count = lambda: spark.read.schema(batch_jobs.LINES).option("recursiveFileLookup", "true").json(out).count()
    assert count() == 2  # the part without its mark is not read
    more = iter([lambda: part("2-output", [line(1, "b"), "{broken", line(5, "f")]), lambda: part("3-errors", [line(2, error="no"), line(5, error="later")]), lambda: (job / "status").write_text("completed\n")])
    done = batch_jobs.collect_job(requests, out, state, wait=lambda: next(more)(), most_polls=9, **options)
    got = {r.custom_id: (r.response, r.error) for r in done.collect()}
    assert got == {"r0": ("a", None), "r1": ("b", None), "r2": ("", "no"), "r3": ("c", None), "r4": ("", "Result missing"), "r5": ("", "later"), "r6": ("", "Result missing")}
    assert count() == 7
    assert batch_jobs.collect_job(requests, out, state, **options).count() == 7 and count() == 7


class Flaky(connectors.Connector):
    """Fails as often as the prompt says before it answers."""

    def __init__(self):
        self.asked = {}

    def respond(self, prompt):
        self.asked[prompt] = self.asked.get(prompt, 0) + 1
        if prompt == "broken":
            raise ValueError("never")
        if self.asked[prompt] <= int(prompt):
            raise ConnectionError(f"down {self.asked[prompt]}")
        return {"final_answer": f"after {self.asked[prompt]}"}


def test_failed_requests_are_asked_again(spark):
    rows = spark.createDataFrame([("0",), ("2",), ("3",), ("broken",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.final_answer, r.error) for r in connectors.generate(rows, connectors.Retrying(Flaky(), tries=3, wait=0)).collect()}
    assert got == {"0": ("after 1", None), "2": ("after 3", None), "3": (None, "ConnectionError: down 3"), "broken": (None, "ValueError: never")}
