"""A cache of model outputs that runs read before they ask, and write batch by batch.

Entries lie in buckets by a hash of their prompt. A write reads and rewrites only the buckets that its prompts fall
into, and publishes them with the untouched ones as one version (versions.py). Of equal prompts in one write the
entry of the highest ``place`` wins, of equal places the greater outputs; a write wins over what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import cache_split
from .versions import VersionedTable

ENTRIES = "key string, prompt string, outputs array<string>"
#: Buckets of a new cache; a bucket is what a write rewrites at least.
BUCKETS = 64


class PromptCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.table, self.buckets = VersionedTable(spark, path), buckets

    def read(self) -> DataFrame:
        """(key, prompt, outputs) of all entries; none where nothing was written yet."""
        now = self.table.current()
        return self.table.read(ENTRIES, "parquet", now) if now.number else self.table.spark.createDataFrame([], ENTRIES)

    def lookup(self, prompts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """(hits, misses) of prompts (column prompt): a prompt hits when the cache holds n outputs for it."""
        return cache_split(prompts, self.read(), n)

    def upsert(self, rows: DataFrame) -> set[int]:
        """Writes (prompt, outputs, place), and returns the buckets that were rewritten; other columns are ignored."""
        keyed = rows.filter(F.col("prompt").isNotNull()).select(F.sha2("prompt", 256).alias("key"), "prompt", "outputs", "place")
        new = keyed.groupBy("key").agg(F.max_by(F.struct("prompt", "outputs"), F.struct("place", "outputs")).alias("e")).select("key", "e.*")
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        touched = sorted(r["b"] for r in new.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return set()
        before = self.table.current()
        there = [f"{self.table.path}/{before.parts[str(b)]}" for b in touched if str(b) in before.parts]
        merged = new
        if there:
            old = self.table.spark.read.schema(ENTRIES).parquet(*there)
            merged = old.join(new.select("key"), "key", "left_anti").unionByName(new)
        folder = self.table.data_folder()
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.table.path}/{folder}")
        self.table.publish(before.parts | {str(b): f"{folder}/bucket={b}" for b in touched}, before)
        return set(touched)
