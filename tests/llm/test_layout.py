"""Shards, mixing, chat views, revisits and the pipeline."""

import random
import time
from collections import Counter

import corpus_pipeline
import pytest
from emendata.llm import chat_views, kd_shards, pfair_mix, warc_revisits
from emendata.llm.common import text_key
from pyspark.sql import functions as F

from .conftest import words
from .test_pairs import best_similarity, expected_components, leak_words


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 400), "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = kd_shards.assign_shards(df, shards=24)
    got = kd_shards.number_slots(placed.withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))).collect()
    assert len(got) == 4000 and {r.shard for r in got} == set(range(24))
    weight = Counter()
    for r in got:
        weight[r.shard] += r.size
        assert r.size == len(r.text) + 8
    mean = sum(weight.values()) / 24
    assert max(weight.values()) < 1.03 * mean and min(weight.values()) > 0.97 * mean
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_tables(spark, documents, corpus, nothing):
    out = kd_shards.assign_shards(documents, shards=5)
    assert out.count() == len(corpus) and "in_shard" in out.columns and "shard" in out.columns
    assert kd_shards.assign_shards(nothing, shards=5).count() == 0
    same = spark.createDataFrame([(1, "a")] * 20, "doc_id long, text string")
    assert kd_shards.assign_shards(same, shards=4).count() == 20
    assert kd_shards.shards_for(same, 60) == 3


@pytest.mark.parametrize("weights, blocks", [({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 500, "b": 300, "c": 200}), ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 50, "b": 60, "c": 70}), ({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 9, "b": 9, "c": 9}), ({"a": 0.05, "b": 0.95, "c": 1e-7}, {"a": 30, "b": 100, "c": 2})])
def test_every_prefix_is_within_one_block(weights, blocks):
    order = pfair_mix.schedule(blocks, weights)
    assert sorted(order) == sorted((s, j) for s, n in blocks.items() for j in range(n))
    left, share, took, slot = dict(blocks), dict(weights), Counter(), 0
    for source, _ in order:
        slot += 1
        took[source] += 1
        left[source] -= 1
        total = sum(share.values())
        assert all(abs(took[s] - slot * w / total) < 1 + 1e-4 for s, w in share.items())
        if not left[source]:
            del share[source]
            took, slot = Counter(), 0


def test_thousands_of_sources(spark):
    """Groups keep every source within two blocks of its share until a source of its group is used up."""
    rng = random.Random(4)
    blocks = {f"s{k}": rng.choice([1, 1, 2, 5]) for k in range(5000)} | {"big": 20_000, "large": 10_000}
    weights = pfair_mix.tempered_weights(blocks)
    begin = time.monotonic()
    order = pfair_mix.schedule(blocks, weights)
    assert time.monotonic() - begin < 40
    assert len(order) == sum(blocks.values()) == len(set(order))
    took = Counter()
    for slot, (source, block) in enumerate(order[:300], 1):
        assert block == took[source]
        took[source] += 1
        assert abs(took["big"] - slot * weights["big"]) < 2.1 and abs(took["large"] - slot * weights["large"]) < 2.1
    few = {k: blocks[k] for k in list(blocks)[:40]}
    assert sorted(pfair_mix.schedule(few, weights, fan=7)) == sorted((s, j) for s, n in few.items() for j in range(n))


def test_zero_weights_come_last():
    order = [s for s, _ in pfair_mix.schedule({"a": 3, "b": 2}, {"a": 1.0})]
    assert order == ["a", "a", "a", "b", "b"]


def test_mix_places_every_row(spark, documents, corpus, nothing):
    got = pfair_mix.mix(documents, block_rows=4).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(corpus)))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus)
    assert pfair_mix.mix(nothing).count() == 0
    laid = pfair_mix.mixed(documents, block_rows=4)
    assert laid.columns == documents.columns and laid.count() == len(corpus)


def test_mix_follows_the_schedule(spark):
    """Positions from the definition: ranks within a source by hash, and the schedule's blocks one behind the other."""
    rng = random.Random(8)
    rows = [(i if i % 5 else None, f"t{rng.randrange(60)}", rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(k) for k, c in enumerate(("mix_slot", "row", "rank", "k0", "g", "b", "n", "first", "_s", "start"))})
    got = pfair_mix.mix(df, {"a": 0.5, "b": 0.3, "": 0.2}, block_rows=7, ties=("text",))
    assert got.columns == ["doc_id", "text", "source", "row", "rank", "k0", "g", "b", "n", "first", "_s", "start", "mix_block", "mix_slot", "mix_position"]
    hashed = df.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h")).collect()
    ordered: dict = {}
    for r in hashed:
        ordered.setdefault(r.source or "", []).append((r.h % 1, r.doc_id is not None, r.doc_id or 0, r.text))
    blocks = {s: -(-len(x) // 7) for s, x in ordered.items()}
    want, slots = [], {}
    for slot, (s, j) in enumerate(pfair_mix.schedule(blocks, {"a": 0.5, "b": 0.3, "": 0.2})):
        slots[s, j] = slot
        want += [(s, d if known else None, t) for _, known, d, t in sorted(ordered[s])[7 * j : 7 * j + 7]]
    rows = sorted(got.collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in rows] == list(range(300))
    assert [(r.source or "", r.doc_id, r.text) for r in rows] == want
    assert all(slots[r.source or "", r.mix_block] == r.mix_slot for r in rows)


def test_slots_keep_any_columns(spark):
    df = spark.range(50).select((F.col("id") % 3).cast("int").alias("shard"), "id", *[F.lit(9).alias(c) for c in ("slot", "row", "g", "b", "n", "first", "within", "_bucket", "_n")])
    got = kd_shards.number_slots(df, ("id",))
    assert got.columns == ["shard", "id", "row", "g", "b", "n", "first", "within", "_bucket", "_n", "slot"]
    for shard in range(3):
        assert sorted(r.slot for r in got.collect() if r.shard == shard) == list(range(17 if shard < 2 else 16))


def test_thousands_of_leaves(spark):
    rng = random.Random(7)
    points = [(rng.randrange(8, 400), *[rng.randrange(1 << 63) for _ in range(4)]) for _ in range(20_000)]
    rows = spark.createDataFrame(points, "size long, x0 long, x1 long, x2 long, x3 long").repartition(4).cache()
    begin = time.monotonic()
    nodes, depth = kd_shards.build_tree(rows, 5000, local_rows=4000)
    assert time.monotonic() - begin < 120 and depth >= 13
    leaf = F.get(kd_shards._literal([n.first for n in nodes]), kd_shards._leaf(nodes, depth))
    got = rows.groupBy(leaf.alias("shard")).agg(F.sum("size").alias("w")).collect()
    assert {n.first for n in nodes if n.axis < 0} == set(range(5000)) and len(got) > 4900
    assert max(r.w for r in got) <= sum(p[0] for p in points) / 5000 + 2 * 400


@pytest.mark.parametrize("local_rows", [None, 60])
def test_tree_splits_at_weighted_medians_along_the_widest_dimension(spark, local_rows):
    """The tree of brute force: each node is cut where its weight parts, on the dimension that is widest in it."""
    rng = random.Random(6)
    points = [(rng.randrange(8, 400), *[rng.randrange(1 << 31) * (1 << 32) // w + rng.randrange(1 << 32) for w in (1, 4, 2, 3)]) for _ in range(700)]
    rows = spark.createDataFrame(points, "size long, x0 long, x1 long, x2 long, x3 long")
    nodes, depth = kd_shards.build_tree(rows, 11, local_rows)
    total = sum(p[0] for p in points)
    spread = [(max(p[1 + k] for p in points) >> 32) - (min(p[1 + k] for p in points) >> 32) for k in range(4)]

    def check(at, inside):
        node = nodes[at]
        if node.shards == 1:
            assert abs(sum(p[0] for p in inside) - total / 11) < 2 * 400
            return 1
        widths = [((max(p[1 + k] for p in inside) >> 32) - (min(p[1 + k] for p in inside) >> 32)) / spread[k] for k in range(4)]
        assert widths[node.axis] == max(widths)
        left, right = [p for p in inside if p[1 + node.axis] <= node.split], [p for p in inside if p[1 + node.axis] > node.split]
        goal = sum(p[0] for p in inside) * (node.shards // 2) // node.shards
        assert abs(sum(p[0] for p in left) - goal) <= 400  # as near as whole rows allow
        return check(node.low, left) + check(node.high, right)

    assert check(0, points) == 11 and depth == 4

def view(rows, perspective):
    """The whole view of one dialogue and the texts that are to be learned."""
    text, learned = "", []
    for _, name, said in sorted(rows):
        head = {"system": "<|system|>", perspective: "<|assistant|>"}.get(name, f"<|user name={name}|>")
        text += f"{head}\n{said}<|end|>\n"
        if name == perspective:
            learned.append(f"{said}<|end|>")
    return text, learned


def test_chat_views(spark):
    rng = random.Random(3)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"), (1, 300, "ann", None), (2, None, None, "x"), (2, 0, "ann", "y"), (3, 0, "system", "alone"), (None, 0, "ann", "z"), (1, 1, "ann", "hi")]
    rows += [(4, None if k % 2 else rng.randrange(9), rng.choice(["ann", "bob", "system"]), f"turn {k}" * rng.randrange(3)) for k in range(1000)]
    rows += [(5, 0, "ann", "long " * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, perspective string, piece int")
    got: dict = {}
    for r in sorted(chat_views.rotate(df, turns=100).collect(), key=lambda r: r.piece):
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    want: dict = {}
    for conv in {r[0] for r in rows}:
        turns = [(-1 if t is None else t, n or "unknown", x or "") for c, t, n, x in rows if c == conv]
        want |= {(conv, p): (len(turns), *view(turns, p)) for p in {n for _, n, _ in turns} - {"system"}}
    assert set(got) == set(want)
    for key, (n, text, learned) in want.items():
        pieces = got[key]
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.n_turns for p in pieces) == n
        assert all(p.n_turns == 100 for p in pieces[:-1]) and pieces[-1].n_turns <= 100
        whole = "".join(p.text for p in pieces)
        assert whole == text
        assert [p.start for p in pieces] == [len("".join(q.text for q in pieces[:k])) for k in range(len(pieces))]
        assert [whole[s.start : s.end] for p in pieces for s in p.spans] == learned
    assert len(got[4, "ann"]) == 10
    assert chat_views.rotate(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    records = [("response", "http://a.example/x", "2024-01-01T00:00:00Z", "<urn:1>", 200, {"etag": '"1"', "content-type": "text/html"}, b"<p>\r\n\r\nhi</p>"), ("revisit", "http://a.example/x", "2024-01-02T00:00:00Z", "<urn:2>", 304, {"etag": '"1"'}, b"")]
    for packed in (True, False):
        (tmp_path / f"{packed}.warc").write_bytes(b"".join(warc_revisits.format_warc(*r, packed=packed) for r in records))
    (tmp_path / "broken.warc").write_bytes(warc_revisits.format_warc(*records[0])[:-30])
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc_revisits.read_warc(spark, str(tmp_path / "*.warc")).collect()
    for packed in ("True", "False"):
        mine = sorted((r for r in got if packed in r.file), key=lambda r: r.date)
        assert [(r.type, r.uri, r.date, r.record_id, r.status, r.headers, bytes(r.payload)) for r in mine] == records


def test_records_behind_a_broken_one_are_read():
    record = lambda k: ("response", f"http://a.example/{k}", "2024-01-01T00:00:00Z", f"<urn:{k}>", 200, {"etag": f'"{k}"'}, bytes([65 + k]) * 40)
    for packed in (True, False):
        parts = [warc_revisits.format_warc(*record(k), packed=packed) for k in range(5)]
        broken = parts[1][:90] if packed else parts[1].replace(b"Content-Length: ", b"Content-Length: x")
        cut = parts[4][:-40]
        got = list(warc_revisits.parse_warc(parts[0] + broken + parts[2] + parts[3] + cut))
        assert [r["record_id"] for r in got] == ["<urn:0>", "<urn:2>", "<urn:3>"]
        assert [r["payload"] for r in got] == [bytes([65 + k]) * 40 for k in (0, 2, 3)]


def test_revisits_with_odd_columns(spark):
    """Repeated records, extra columns whose names the join uses itself, and an empty table."""
    rows = [(1, "response", "http://a/x", 1, 200, {"etag": "1"}, b"one"), (2, "revisit", "http://a/x", 2, 304, {"etag": "1"}, None)]
    records = spark.createDataFrame(rows, "record_id long, type string, uri string, at long, status int, headers map<string,string>, payload binary").withColumns({"date": F.timestamp_seconds("at"), **{c: F.lit(5) for c in ("url", "outcome", "response_id", "old", "new", "full", "_found")}})
    assert [(r.record_id, r.url, r.outcome, r.response_id) for r in warc_revisits.resolve(records).collect()] == [(2, "a/x", "resolved", 1)]
    twice = warc_revisits.resolve(records.union(records)).collect()
    assert [(r.record_id, r.outcome, r.response_id) for r in twice] == [(2, "resolved", 1)]


def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top": "example.com/a?a=1&b=2", "https://m.example.com": "example.com", "https://example.com/?ref=q": "example.com", " example.com/A/ ": "example.com/A"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc_revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls


def test_revisits(spark):
    full, not_modified = "response", "revisit"
    rows = [
        (1, full, "http://a/x", 1, 200, {"etag": "1", "server": "s", "date": "old"}, b"one"),
        (2, full, "http://a/x", 5, 200, {"etag": "2"}, b"two"),
        (3, not_modified, "http://a/x#f", 3, 304, {"etag": "1", "date": "new", "content-length": "0"}, None),
        (4, not_modified, "http://a/x", 9, 304, {"etag": "1"}, None),
        (5, not_modified, "http://a/x", 0, 304, {}, None),
        (6, not_modified, "http://b/", 9, 304, {}, None),
        (7, full, "http://c/", 4, 500, {}, b"bad"),
        (8, not_modified, "http://c/", 9, 304, {}, None),
        (9, not_modified, None, 9, 304, {}, None),
        (10, full, "http://d/", 2, 200, {"last-modified": "m"}, b"d"),
        (11, not_modified, "http://d/", 2, 304, {"last-modified": "m"}, None),
        (12, not_modified, "http://d/", 3, 304, {}, None),
        (13, not_modified, "http://d/", None, 304, {}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, type string, uri string, at long, status int, headers map<string,string>, payload binary").withColumn("date", F.timestamp_seconds("at"))
    got = {r.record_id: r for r in warc_revisits.resolve(records).collect()}
    assert {i: (r.outcome, r.response_id) for i, r in got.items()} == {3: ("resolved", 1), 4: ("mismatch", 2), 5: ("missing", None), 6: ("missing", None), 8: ("missing", None), 9: ("missing", None), 11: ("resolved", 10), 12: ("unchecked", 10), 13: ("missing", None)}
    assert got[3].headers == {"etag": "1", "server": "s", "date": "new"} and bytes(got[3].payload) == b"one"
    assert got[4].headers is None and got[4].payload is None
    assert warc_revisits.resolve(records.limit(0)).count() == 0


def test_as_of_join_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(40), rng.random() < 0.3) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, key string, at long, full boolean")
    got = {r.id: r._found for r in warc_revisits.latest_before(df, "key", ["at", "id"], "full", partitions=9).collect()}
    for i, key, at, _ in rows:
        earlier = [(a, j) for j, k, a, f in rows if k == key and f and (a, j) < (at, i)]
        assert (tuple(got[i]) if got[i] else None) == (max(earlier) if earlier else None)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, stage, documents, corpus, nothing, data):
    """Nulls, empty, long and repeated rows, and columns whose names the stages use themselves."""
    named = documents.withColumns({"slot": F.lit(7), "row": F.lit("r"), "label": F.lit(1), "predicted": F.lit(1), "text_crc32": F.lit(0)})
    out = stage(spark, named, data)
    last = stage is corpus_pipeline.STAGES[-1][1]
    if last:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "in_shard", "bucket", "in_slot", "row", "label", "predicted", "text_crc32", "size", "shard", "slot"]
    else:
        assert out.columns == named.columns
    ids = [r[0] for r in corpus]
    kept = [r.doc_id for r in out.collect()]
    assert set(kept) <= set(ids) and None in kept
    if stage not in (corpus_pipeline.toxicity, corpus_pipeline.near_duplicates):
        assert Counter(kept) == Counter(ids)
    assert stage(spark, nothing, data).count() == 0


@pytest.mark.parametrize("shards", [1, 24])
def test_slots_follow_the_mixed_order(spark, data, monkeypatch, shards):
    monkeypatch.setattr(corpus_pipeline, "SHARDS", shards)
    docs = spark.createDataFrame([(i, f"text {i}", "rare" if i % 10 == 0 else "common") for i in range(9000)], "doc_id long, text string, source string")
    got = sorted((r.shard, r.slot, r.doc_id, r.source) for r in corpus_pipeline.sharding(spark, docs, data).collect())
    position = {r.doc_id: r.mix_position for r in pfair_mix.mix(docs, ties=(text_key(),)).collect()}
    for shard in range(shards):
        ids = [i for s, _, i, _ in got if s == shard]
        assert [k for s, k, _, _ in got if s == shard] == list(range(len(ids)))
        assert ids == sorted(ids, key=position.get)
    if shards == 1:  # weights are 3 to 1: roots of 8100 and 900
        for n in range(200, 3600, 200):
            assert abs(sum(source == "rare" for _, _, _, source in got[:n]) - n / 4) <= 2 * pfair_mix.LEAST_BLOCK_ROWS


def test_mixing_decides_the_slots(spark, data, monkeypatch, tmp_path):
    """Slots follow the files that the stage before has written, whatever order these hold."""
    monkeypatch.setattr(corpus_pipeline, "SHARDS", 3)
    docs = spark.createDataFrame([(i, f"text {i}", "rare" if i % 10 == 0 else "common", i) for i in range(5000)], "doc_id long, text string, source string, mix_position int")
    ways = {"falling": docs.repartitionByRange(7, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), "mixed": corpus_pipeline.mixing(spark, docs, data), "even": pfair_mix.mixed(docs, weights={"rare": 1.0, "common": 1.0})}
    position = {"falling": {i: -i for i in range(5000)}}
    for name, weights in (("mixed", None), ("even", {"rare": 1.0, "common": 1.0})):
        position[name] = {r.doc_id: r.mix_position for r in pfair_mix.mix(docs, weights, ties=(text_key(),)).collect()}
    for name, rows in ways.items():
        rows.write.parquet(str(tmp_path / name))
        got = sorted((r.shard, r.slot, r.doc_id) for r in corpus_pipeline.sharding(spark, spark.read.parquet(str(tmp_path / name)), data).collect())
        assert sorted(i for *_, i in got) == list(range(5000))
        for shard in range(3):
            mine = [(k, i) for s, k, i in got if s == shard]
            assert [k for k, _ in mine] == list(range(len(mine))) and mine
            assert [i for _, i in mine] == sorted((i for _, i in mine), key=position[name].get)


def test_pipeline(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and after.columns[: len(columns)] == columns
        if name in ("mixing", "sharding"):
            assert kept == ids
        else:
            assert len(kept) < len(ids)
        rows = docs.select("doc_id", "text").collect()
        if name == "near_duplicates":
            assert kept == {i for i, (_, c) in expected_components([(r.doc_id, r.text) for r in rows], 5, 80).items() if c == i}
        if name == "decontamination":
            items = [leak_words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            grams = {tuple(x[j : j + 5]) for x in items for j in range(len(x) - 4)}
            near = [(r.doc_id, ws) for r in rows if (ws := leak_words(r.text)) and any(tuple(ws[j : j + 5]) in grams for j in range(len(ws) - 4))]
            assert ids - kept == {i for i, ws in near if any(best_similarity(ws, x) >= 0.8 for x in items if x)}
        docs, ids = after, kept
    assert before > docs.count() > before // 2
    assert corpus_pipeline.run(spark, data).count() == docs.count()
    assert {"shard", "slot"} <= set(docs.columns)
    leaks = {tuple(words(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    for r in docs.select("text").collect():
        ws = words(r.text)
        assert not any(len(x) > 10 and any(tuple(ws[i : i + len(x)]) == x for i in range(len(ws) - len(x) + 1)) for x in leaks)
