"""Window operators (W6-W8) and event windows as batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_balance(tx: DataFrame) -> DataFrame:
    """Cumulative amount per account by date, then id.

    Sums per account and day run over days, which are few, and each row adds its day's part to what stood before: so an account
    that holds a third of all rows is ordered a day at a time. Rows without date come first.
    """
    daily = tx.groupBy("account_id", "date").agg(F.sum("amount").alias("day_sum"))
    before = F.sum("day_sum").over(Window.partitionBy("account_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    opening = daily.select(F.col("account_id").alias("_account"), F.col("date").alias("_date"), before.alias("opening"))
    inside = F.sum("amount").over(Window.partitionBy("account_id", "date").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = tx.select("id", "account_id", "date", inside.alias("inside"))
    met = rows.join(opening, F.col("account_id").eqNullSafe(F.col("_account")) & F.col("date").eqNullSafe(F.col("_date")))
    zero = F.lit(0).cast("decimal(18,2)")
    return met.select("id", "account_id", (F.coalesce("opening", zero) + F.coalesce("inside", zero)).cast("double").alias("balance"))


def rate_limit_flags(events: DataFrame, most: int = 100, minutes: int = 60) -> DataFrame:
    """Requests of the key in the trailing window, this one included; limited beyond `most`, blocked from twice as many.

    Rows stand in their time bucket, as long as the window, and help in the next one: so a task holds two windows of a user, not
    all that the user ever sent. Rows without time count none.
    """
    span = minutes * 60_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", "user_id", at.alias("at")).withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.floor(F.col("at") / span) + F.col("later"))
    n = F.count("*").over(Window.partitionBy("user_id", "bucket").orderBy("at").rangeBetween(-span, 0))
    counted = rows.withColumn("n", n).filter("later = 0").withColumn("n", F.when(F.col("at").isNotNull(), F.col("n")).otherwise(0))
    return counted.select("event_id", "n", (F.col("n") <= most).alias("allowed"), (F.col("n") >= 2 * most).alias("blocked"))


def frequency_spikes(tx: DataFrame, times: float = 1.5) -> DataFrame:
    """Days whose count is over `times` the exact median of days."""
    days = tx.groupBy("date").agg(F.count("*").alias("n"))
    median = days.agg(F.percentile("n", 0.5).alias("median"))
    return days.crossJoin(F.broadcast(median)).filter(F.col("n") > times * F.col("median")).select(F.col("date").cast("string").alias("date"), "n", "median", (F.weekday("date") >= 5).alias("weekend"))


def last_n(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows, ties by larger id; Spark keeps n a task."""
    return rows.orderBy(F.col(by).desc(), F.col("id").desc()).limit(n)


def top_n_groups(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n values with the most rows, ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(n)


def tumbling_metrics(events: DataFrame) -> DataFrame:
    """Counts and values per minute and type."""
    g = events.groupBy(F.window("ts", "60 seconds").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return g.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "value")


def sliding_rate(events: DataFrame, most: int) -> DataFrame:
    """T4: keys and hours, sliding by 5 minutes, with at least `most` requests."""
    g = events.groupBy(F.window("ts", "60 minutes", "5 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.filter(F.col("n") >= most).select(F.col("w.start").cast("string").alias("start"), "user_id", "n")


def session_activity(events: DataFrame) -> DataFrame:
    """T5: sessions of a user that end after 30 minutes without an event."""
    g = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("string").alias("start"), "n")
