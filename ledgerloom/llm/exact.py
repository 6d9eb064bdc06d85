"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, Scratch, durable, join_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    # In an all-ASCII text lower() touches A-Z alone, and is much faster than translate().
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest: Column | None = None) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, digest).

    Rounds: rows are grouped by byte length; of lengths that occur twice, by a hash of length and the
    first `prefix` characters; of those, by SHA-256 of the whole folded text. Only survivors of two
    rounds have their content hashed whole, unless the caller gives `digest`, an expression that it
    needs for every row anyway: then the third round uses that and `docs` is read once.
    Groups are counted with map-side combine, and rows meet their group's count by join_counted, so a
    group that holds a third of all rows is never gathered. The row with the largest id stays.

    Null text equals empty text. Repeated ids: each such row is returned; `kept` holds for all rows
    of the kept id. A null id is kept only if its group has no other id (keep_id null). Empty input
    gives an empty result. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.xxhash64(F.octet_length(text), ascii_fold(F.substring(text_col, 1, prefix)))
    named = docs.select(F.col(id_col).alias("id"), F.octet_length(text).alias("n"), head.alias("head"), (digest if digest is not None else F.lit(None).cast("string")).alias("digest"))
    rows = scratch.save(named)
    total = rows.count()
    lengths = scratch.save(rows.groupBy("n").agg(F.count("*").alias("same_n")))
    first = scratch.save(join_counted(rows, lengths, "n", "same_n", total))
    heads = scratch.save(first.filter("same_n > 1").groupBy("head").agg(F.count("*").alias("same_head")))
    second = join_counted(first.filter("same_n > 1"), heads, "head", "same_head", total)
    twice = heads.filter("same_head > 1").select("head")
    if digest is not None:
        survivors = second.filter("same_head > 1").select("id", "digest")
    else:
        whole = F.sha2(ascii_fold(F.col("text")).cast("binary"), 256).alias("digest")
        read = docs.select(F.col(id_col).alias("id"), head.alias("head"), F.col(text_col).alias("text"))
        if twice.count() <= BROADCAST_ROWS:
            survivors = read.join(F.broadcast(twice), "head", "left_semi").select("id", whole)
        else:  # narrow rows are shuffled, not texts
            survivors = read.select("id", "head", whole).join(twice, "head", "left_semi").select("id", "digest")
    survivors = scratch.save(survivors)
    groups = scratch.save(survivors.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("size")))
    grouped = join_counted(survivors, groups, "digest", "size", total).select("id", "keep", "size", "digest")
    settled = first.filter("same_n = 1").select("id", "digest").union(second.filter("same_head = 1").select("id", "digest"))
    alone = settled.select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), "digest")
    out = durable(grouped.union(alone).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), "digest"
    ))
    scratch.clear()
    return out


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.sha2(ascii_fold(F.col("text")).cast("binary"), 256)
    return exact_dedup(docs, digest=digest).withColumnRenamed("digest", "text_sha256")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
