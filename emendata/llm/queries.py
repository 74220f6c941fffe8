"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_views, decontaminate, kd_shards, llr_quality, merkle, minhash, pfair_mix, pii_crf, ppm_language, spelling, substring, warc_revisits, zstd_toxicity
from .common import held_out, table, text_key


SHARDS = 24


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.assign_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    slots = kd_shards.number_slots(placed.select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "shard"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identify(table(spark, sf_dir, "documents"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", text_key().alias("text_key")), ties=("text_key",)).drop("text_key")


def op4_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_views.rotate(table(spark, sf_dir, "conversations"))
    return views.select("conv_id", "perspective", "piece", "n_turns", "start", "text", chat_views.mask_text().alias("mask"))


def op5_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = llr_quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.select("doc_id", *llr_quality.BASE_COLUMNS, "base_failed", "kept", "llr")


def op6_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "first_word", "n_words", "similarity")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_revisits.records_of_pages(table(spark, sf_dir, "pages"))
    return warc_revisits.digest(warc_revisits.resolve(records))


def op10_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = zstd_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), spoiled=31)
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = merkle.leaf_of(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered)
    proved = merkle.manifest(documents, claim=claim)
    siblings = F.array_join(F.flatten(F.transform("proof", lambda p: p["siblings"])), "")
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are those of the base spans; spans and n_added tell what the field adds."""
    found = pii_crf.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii_crf.KINDS]
    n_added = F.size(F.filter("spans", lambda s: s["added"])).cast("long")
    return found.select("doc_id", *counts, F.sha2(pii_crf.spans_text(base), 256).alias("base_sha256"), pii_crf.spans_text(F.col("spans")).alias("spans"), n_added.alias("n_added"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_ppm_language": op2_ppm_language,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_chat_views": op4_chat_views,
    "op5_llr_quality": op5_llr_quality,
    "op6_doubling": op6_doubling,
    "op7_minhash": op7_minhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_zstd_toxicity": op10_zstd_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_semicrf_pii": op13_semicrf_pii,
}
#: The other methods cannot be put in SQL over these tables; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_chat_views": chat_views.ORACLE,
    "op6_doubling": substring.ORACLE,
    "op7_minhash": minhash.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_warc_revisits": warc_revisits.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
