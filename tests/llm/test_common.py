"""Shared helpers: joins of rows with their own aggregate, ranks of hot groups, bounded samples."""

from emendata.llm.common import bucketed_rank, hash_unit, held_out, join_back, kept_fields, materialise, packed
from pyspark.sql import functions as F


def test_join_back_equals_a_plain_join(spark):
    rows = spark.range(600).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("j"), "id")
    grouped = rows.groupBy("k", "j").agg(F.min("id").alias("least"))
    got = join_back(rows, grouped, ["k", "j"])
    want = rows.join(grouped, ["k", "j"])
    assert got.columns == ["k", "j", "id", "least"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_ranks_of_a_hot_group_are_gapless(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("g"), "id")
    rows = rows.union(rows.filter("id < 5"))  # some rows are repeated
    got = bucketed_rank(rows, F.col("g"), [F.col("id")], "rank", rows_per_bucket=37).collect()
    assert len(got) == 1005
    for g in {r.g for r in got}:
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))
    again = {(r.g, r.id, r["rank"]) for r in bucketed_rank(rows.repartition(9), F.col("g"), [F.col("id")], "rank", rows_per_bucket=37).collect()}
    assert again == {(r.g, r.id, r["rank"]) for r in got}
    assert bucketed_rank(rows.limit(0), F.col("g"), [F.col("id")], "rank").count() == 0


def test_folds_and_samples(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"))
    share = rows.select(held_out().cast("int").alias("h"), hash_unit(3, "doc_id").alias("u")).agg(F.avg("h"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert 0.2 < share[0] < 0.3 and 0.47 < share[1] < 0.53 and share[2] >= 0 and share[3] < 1
    assert not spark.createDataFrame([(None,)], "doc_id long").select(held_out().alias("h")).first().h


def test_small_helpers(spark):
    rows = spark.range(10).repartition(8)
    assert packed(rows, 10).rdd.getNumPartitions() == 1 and packed(rows, 200_000).rdd.getNumPartitions() == 4
    assert materialise(rows).count() == 10
    assert kept_fields(rows, 1, "a int, b string").simpleString() == "struct<id:bigint,a:int,b:string>"
