"""Helpers that the corpus operators share: reliable checkpoints, bounded samples, distributed ranks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows with this remainder of crc32(doc_id as text) are held out: never learned from.
FOLDS, HELD_OUT_FOLD = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where that is unset and all tasks run in this process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def materialise(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``; a temporary one is set only where that is unset. With
    ``drop_shuffles`` the shuffle files behind the checkpoint go as soon as it stands, and not only when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan made before would keep its files
    finally:
        spark.conf.set(name, before)


@contextmanager
def no_runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Plans made within have no Bloom filters of one join side for the other.

    The size of a checkpointed table is unknown to the optimizer, so that it makes filters of several megabytes
    for tables of a few rows, and sends each through the driver.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(df: DataFrame, rows: int, rows_per_partition: int = 50_000) -> DataFrame:
    """``df``, of which about ``rows`` rows are known, in no more partitions than they fill.

    Small tables that go through many joins would leave files for every pair of map and reduce tasks.
    """
    return df.coalesce(max(1, -(-rows // rows_per_partition)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def text_key(text: str = "text") -> Column:
    """128 bits of SHA-256 over a text: rows of one doc_id are told apart by it."""
    return F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16)


def join_back(rows: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns that ``grouped``, an aggregate of them by ``keys``, has for their keys.

    The aggregate is already dealt by the keys, so a plain join would keep it so, and a key that holds a third
    of all rows would be one task's work. A further condition, derived from the keys, makes Spark deal both
    sides for the join alone; adaptive execution then splits the parts of a hot key. The hint keeps the plan the
    same at every size: iterations over small tables would else broadcast each of them from the driver.
    """
    theirs = {k: f"_{k}_of" for k in keys}
    named = grouped.withColumnsRenamed(theirs)
    condition = F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(1 << 16)) == F.pmod(F.hash(*[F.col(theirs[k]) for k in keys]), F.lit(1 << 16))
    for k in keys:
        condition = condition & (F.col(k) == F.col(theirs[k]))
    return rows.join(named.hint("merge"), condition).drop(*theirs.values())


#: Files whose first places are broadcast; more are joined by a shuffle.
MOST_FILES = 1_000_000


def file_order(df: DataFrame, name: str) -> DataFrame | None:
    """``df`` with column ``name``: the place of each row in the Parquet files that ``df`` reads; None without any.

    Files follow one another by the number that Spark writes into their names, then by path; places grow within
    a file. They are gapless from 0 unless ``df`` leaves rows out. A column of that name is replaced. One row for
    each file is broadcast, up to MOST_FILES of them.
    """
    try:
        of = df.metadataColumn("_metadata")
        path, row = of.getField("file_path"), of.getField("row_index")
        files = materialise(df.groupBy(path.alias("path")).agg((F.max(row) + 1).alias("n")))
    except AnalysisException:
        return None
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(number, "path").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row"), path.alias("path"), row.alias("at"))
    return placed.join(F.broadcast(first) if files.count() <= MOST_FILES else first, "path").select("row.*", (F.col("first") + F.col("at")).alias(name))


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of a string expression, which has no function of its own."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"  # the reversed polynomial 0xEDB88320
    step = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {bit})"
    bytes_ = f"list_transform(range(strlen({value})), lambda i: ('0x' || substr(hex({value}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: {step}), 4294967295)"


def kept_fields(df: DataFrame, kept: int, more: str) -> StructType:
    """The first ``kept`` fields of ``df`` and those that the DDL string ``more`` names."""
    return StructType([*df.schema.fields[:kept], *StructType.fromDDL(more).fields])


def hash_unit(seed: int, *names: str) -> Column:
    """A number in [0, 1) that depends on the given columns and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(n) for n in names]), F.lit(1 << 30)) / float(1 << 30)


#: At most this many buckets spread the rows of a group, and a bucket is not aimed to be smaller than this.
MOST_BUCKETS, LEAST_BUCKET_ROWS = 1 << 16, 500


def bucketed_rank(df: DataFrame, group: Column, key: list[Column], rank: str, rows_per_bucket: int | None = None, along: Column | None = None) -> DataFrame:
    """``df`` with a gapless rank from 0 within ``group``, without bringing a whole group together.

    Rows are ordered by (bucket, key); the bucket is a hash of the whole key, so a group that holds most of the
    rows is spread over many buckets, and so are rows of one doc_id whose key tells them apart. Ranks within a
    bucket come from a window, and the bucket's first rank from a running sum over the bucket counts, of which
    there are at most MOST_BUCKETS for each group. ``group`` must not be null. With ``along``, gapless numbers
    from 0 over all rows, rows are ordered by it, and buckets are its ranges. A column named as ``rank`` is
    replaced; other columns keep their names, whatever these are.
    """
    total = df.count()
    size = rows_per_bucket or max(LEAST_BUCKET_ROWS, -(-total // MOST_BUCKETS))
    bucket = F.floor(along / size) if along is not None else F.pmod(F.xxhash64(*key), F.lit(max(1, -(-total // size))))
    order = [along] if along is not None else key
    kept = [c for c in df.columns if c != rank]
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), group.alias("g"), bucket.cast("int").alias("b"), *[o.alias(f"o{k}") for k, o in enumerate(order)])
    counts = placed.groupBy(F.col("g").alias("_g"), F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_g", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("g", "b").orderBy(*[f"o{k}" for k in range(len(order))])
    ranked = placed.withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(first, (F.col("g") == F.col("_g")) & (F.col("b") == F.col("_b"))).select("row.*", (F.col("first") + F.col("within")).cast("long").alias(rank))
