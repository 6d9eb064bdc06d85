"""Lookups, duplicates, deletions and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_rows(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that equal a stored row on the keys (nulls equal nothing)."""
    return new.join(stored.select(*keys), keys, "left_semi")


def unknown_rows(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(stored.select(*keys), keys, "left_anti")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, the count and the smallest and largest id."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def row_key() -> list[Column]:
    """Date, amount, folded description."""
    return [F.col("date"), F.col("amount"), F.lower(F.trim("description"))]


def batch_duplicates(df: DataFrame) -> DataFrame:
    """Second and later rows of a key in id order. A first row per key is found by map-side combine and joined back, so a key of many rows isn't sorted in one task."""
    keyed = df.select("id", *[c.alias(f"k{i}") for i, c in enumerate(row_key())])
    first = keyed.groupBy("k0", "k1", "k2").agg(F.min("id").alias("first_id"))
    same = reduce(lambda a, b: a & b, [keyed[f"k{i}"].eqNullSafe(first[f"k{i}"]) for i in range(3)])
    return keyed.join(first, same).filter("id > first_id").select("id", "first_id")


def reconciled_flag(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """is_reconciled where a confirmed record names the row."""
    done = records.filter("status = 'confirmed'").select(F.col(key).alias("id"), F.lit(True).alias("hit")).distinct()
    return rows.join(done, "id", "left").withColumn("is_reconciled", F.coalesce("hit", F.lit(False))).drop("hit")


def unmatched_entries(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger rows with no pending or confirmed record."""
    taken = records.filter(F.col("status").isin("pending", "confirmed")).select(F.col("company_entry_id").alias("id"))
    return entries.join(taken, "id", "left_anti")


def enrich_records(records: DataFrame, tx: DataFrame, entries: DataFrame) -> DataFrame:
    """Each record with its bank and ledger row."""
    b = tx.select(F.col("id").alias("bank_transaction_id"), F.col("amount").alias("bank_amount"), F.col("date").alias("bank_date"), F.col("description").alias("bank_description"))
    e = entries.select(F.col("id").alias("company_entry_id"), F.col("amount").alias("entry_amount"), F.col("date").alias("entry_date"), F.col("description").alias("entry_description"))
    return records.join(b, "bank_transaction_id", "left").join(e, "company_entry_id", "left")


def duplicate_match_join(records: DataFrame, tx: DataFrame, days: int = 7) -> DataFrame:
    """Per record, how many other open records of another bank and another ledger row have the same signed amount within `days`, and how near the nearest is.

    Counted, not paired: of all records of an amount and day, those of the same bank row and those of the same entry are taken off
    again, and those of both, taken off twice, are put back. A record asks for 2 * days + 1 days, however many records share them.
    """
    live = records.filter(F.col("status").isin("pending", "confirmed")).select("id", F.col("bank_transaction_id").alias("bt"), F.col("company_entry_id").alias("ce"))
    rows = live.join(tx.select(F.col("id").alias("bt"), "amount", "date"), "bt")
    count = lambda name, *keys: rows.groupBy(*keys).agg(F.count("*").alias(name))
    asking = count("both", "amount", "date", "bt", "ce").join(count("same_bt", "bt"), "bt")
    asking = asking.withColumn("away", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("day", F.date_add("date", F.col("away")))
    met = asking.join(count("there", "amount", F.col("date").alias("day")), ["amount", "day"]).join(count("same_ce", "amount", F.col("date").alias("day"), "ce"), ["amount", "day", "ce"], "left")
    own = F.when(F.col("away") == 0, F.col("both") - F.col("same_bt")).otherwise(0)
    others = met.withColumn("n", F.col("there") - F.coalesce("same_ce", F.lit(0)) + own).filter("n > 0")
    found = others.groupBy("bt", "ce").agg(F.sum("n").alias("n"), F.min(F.abs("away")).alias("nearest_days"))
    return live.join(found, ["bt", "ce"]).select("id", "n", "nearest_days")


def similar_anomalies(records: DataFrame, as_of: str, k: int = 5, days: int = 90) -> DataFrame:
    """For each anomaly the k newest others of its type detected within `days` before as_of, ties by larger id.

    Those are among the k + 1 newest of the type: so many are kept of each, ranked with the group limit
    before the shuffle, and every anomaly meets them. Types are few, so that side is small whatever the number of anomalies.
    """
    rows = records.filter("is_anomaly")
    recent = rows.filter(F.col("anomaly_detected_at") >= F.expr(f"timestamp'{as_of}' - interval {days} days"))
    newest = Window.partitionBy("anomaly_type").orderBy(F.col("anomaly_detected_at").desc(), F.col("id").desc())
    top = recent.select("id", "anomaly_type", "anomaly_detected_at", F.row_number().over(newest).alias("place")).filter(F.col("place") <= k + 1)
    lists = top.groupBy("anomaly_type").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("other_id")))).alias("all_"))  # k + 1 at most
    met = rows.select("id", "anomaly_type").join(lists, "anomaly_type")
    mine = met.select("id", F.slice(F.filter("all_", lambda x: x["other_id"] != F.col("id")), 1, k).alias("others"))
    return mine.select("id", F.posexplode("others").alias("pos", "o")).select("id", F.col("o.other_id").alias("other_id"), (F.col("pos") + 1).alias("rank"))


def except_ids(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not in `gone`."""
    return rows.join(gone.select("id"), "id", "left_anti")


def guarded_delete(requested: DataFrame, records: DataFrame) -> DataFrame:
    """Requested ledger ids, whether they may go, and how many records hold them."""
    linked = records.groupBy(F.col("company_entry_id").alias("id")).agg(F.count("*").alias("linked"))
    return requested.join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(0)).alias("linked"), F.col("linked").isNull().alias("deletable"))


def cascade_delete(tx: DataFrame, records: DataFrame, ids: DataFrame) -> DataFrame:
    """How many bank rows and records are left and gone."""
    left, kept = tx.join(ids, "id", "left_anti"), records.join(ids.withColumnRenamed("id", "bank_transaction_id"), "bank_transaction_id", "left_anti")
    return left.agg(F.count("*").alias("tx_left")).crossJoin(kept.agg(F.count("*").alias("records_left")))


def apply_patches(base: DataFrame, patches: DataFrame, columns: list[str], valid: dict[str, list[str]]) -> DataFrame:
    """the latest patch per id; only given, valid values replace; text is trimmed."""
    latest = patches.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("p"))
    out = base.join(latest, "id", "left")
    for c in columns:
        new = F.trim(F.col(f"p.{c}"))
        if c in valid:
            new = F.when(new.isin(valid[c]), new)
        out = out.withColumn(c, F.coalesce(new, F.col(c)))
    return out.drop("p")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Bag union, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def add_missing_columns(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Absent columns with a default of a type."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in df.columns})
