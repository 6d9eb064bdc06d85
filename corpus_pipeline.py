"""The corpus pipeline: quality, near-dedup, decontamination, mixing and sharding of `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; run() writes each result as Parquet in the shared folder and reads it again for the next.
All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, small, table
from ledgerloom.llm.decontam import contained_items
from ledgerloom.llm.minhash import drop_near_duplicates
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.quality import resample_quality
from ledgerloom.llm.ring import shard_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (5): documents that the resampling doesn't draw go."""
    return resample_quality(docs, table(spark, sf_dir, "labels")).filter("quality_kept").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (2): one document of each class of near copies stays, that of the smallest id."""
    return drop_near_duplicates(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): documents that hold a benchmark item go."""
    leaks = contained_items(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(small(leaks), F.col("doc_id") == F.col("_leak_id"), "left_anti")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (6): each document as often as the mix takes words of it.

    A document taken q whole times and a part of it again is there q times, and once more if the mix
    took at least half of it again; one of which less than half is taken goes. So up to 3 rows of an
    id; documents without words go, as the mix takes nothing of them. Rows that share an id (or have
    none) are each there as often as the one of them that is taken most.
    """
    mixed = mix_sources(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    taken = mixed.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max(times).alias("_mix_times")).filter("_mix_times > 0")
    again = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("_mix_id")))
    return again.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding (10): the shard and slot of each document of the mix."""
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_to_weights),
    ("shard", shard),
]

#: The first stage's model can't be written as SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of sf_dir; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        scratch = Scratch(spark)
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            before.clear()
        before = scratch
    return docs
