"""What is kept as files and texts: learned patterns (S16), JSON columns (S17), reports of changed categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType, _parse_datatype_string

from ledgerloom.functions.text import categorize

PATTERNS = "type string, pattern string, count long, frequency double, significance string"


def export_patterns(patterns: DataFrame, path: str) -> None:
    """Learned patterns as JSON lines, one a pattern, replacing what is there."""
    patterns.select("type", "pattern", F.col("count").cast("long"), F.col("frequency").cast("double"), "significance").write.mode("overwrite").json(path)


def import_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of JSON lines under a fixed schema; lines that are no JSON or lack a type or pattern are left out."""
    return spark.read.schema(PATTERNS).option("mode", "DROPMALFORMED").json(path).filter("type is not null and pattern is not null")


def decode_json(text: Column, schema: str | DataType) -> Column:
    """A JSON text under a schema: what is null, invalid or of another kind is an empty value, a map without entries or a struct of nulls."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    read = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    if isinstance(kind, MapType):
        return F.coalesce(read, F.create_map().cast(kind))
    if isinstance(kind, StructType):
        return F.coalesce(read, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind]))
    return F.coalesce(read, F.array().cast(kind))


def encode_json(value: Column) -> Column:
    """A struct, map or array as JSON text; null as an empty object."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


@dataclass
class CategoryChanges:
    """S18's report: one row of totals, (old, new) counts, at most 50 examples, and the rows that change with their new category."""

    summary: DataFrame
    transitions: DataFrame
    examples: DataFrame
    changes: DataFrame

    def save(self, path: str) -> None:
        """Append to the report under path what the run found."""
        for name in ("summary", "transitions", "examples"):
            getattr(self, name).write.mode("append").json(f"{path}/{name}")


def category_changes(tx: DataFrame, predicted: Column | None = None, bank: str | None = None, start: str | None = None, end: str | None = None, category: str | None = None, only_outros: bool = False, limit: int = 1000, most: int = 10_000) -> CategoryChanges:
    """What the rules (or `predicted`) would call the newest rows that pass the filters, against what they are called.

    The limit is the report's own, between 1 and `most`. A null category counts as `NULL`, a blank description as
    `outros`. Nothing is written: apply_changes does that, so a dry run is one without it.
    """
    rows = tx
    for wanted, cond in ((bank, F.col("bank_name") == bank), (start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") <= F.lit(end).cast("date")), (category, F.col("category") == category)):
        rows = rows.filter(cond) if wanted else rows
    if only_outros:
        rows = rows.filter((F.col("category") == "outros") | F.col("category").isNull())
    rows = rows.orderBy(F.desc("date"), "id").limit(max(1, min(limit, most)))
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    new = F.when(blank, "outros").otherwise(predicted if predicted is not None else categorize(F.col("description")))
    judged = rows.withColumns({"old": F.coalesce("category", F.lit("NULL")), "new": F.coalesce(new, F.lit("outros"))})
    changed = F.col("old") != F.col("new")
    news = F.array_sort(F.collect_set(F.when(changed & (F.col("new") != "outros"), F.col("new"))))  # as many as categories
    summary = judged.agg(F.count("*").alias("total"), F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged"), news.alias("new_categories"))
    transitions = judged.groupBy("old", "new").agg(F.count("*").alias("n"))
    examples = judged.filter(changed).orderBy(F.desc("date"), "id").limit(50).select("id", "date", "amount", "bank_name", "description", "old", "new")
    return CategoryChanges(summary, transitions, examples, judged.filter(changed).select("id", "new"))


def apply_changes(tx: DataFrame, report: CategoryChanges) -> DataFrame:
    """S18 without dry run: tx with the new categories of the report's rows, which are at most its limit."""
    new = report.changes.select(F.col("id").alias("_id"), F.col("new").alias("_new"))
    return tx.join(F.broadcast(new), F.col("id") == F.col("_id"), "left").withColumn("category", F.coalesce("_new", "category")).drop("_id", "_new")
