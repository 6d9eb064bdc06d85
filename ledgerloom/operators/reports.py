"""Summaries and reports (A1-A30): each takes DataFrames and returns one; times of reference are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import friendly_label


def money(c: Column) -> Column:
    """A decimal sum as double, exact up to the last step."""
    return F.coalesce(c, F.lit(0)).cast("double")


def total(cond: Column | None = None, value: str = "amount") -> Column:
    return money(F.sum(F.col(value) if cond is None else F.when(cond, F.col(value))))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def overview(tx: DataFrame) -> DataFrame:
    """A1: count, income, expenses, net."""
    return tx.agg(F.count("*").alias("n"), total(F.col("amount") > 0).alias("income"), F.abs(total(F.col("amount") < 0)).alias("expenses"), total().alias("net"))


def by_category(tx: DataFrame) -> DataFrame:
    """A2: count and sum per category with its friendly label."""
    return tx.groupBy("category").agg(F.count("*").alias("n"), total().alias("total")).withColumn("label", friendly_label(F.col("category")))


def by_bank(tx: DataFrame) -> DataFrame:
    return tx.groupBy("bank_name").agg(F.count("*").alias("n"))


def ledger_summary(entries: DataFrame, start: str, end: str) -> DataFrame:
    """A3: income, expenses and net of a date window, per category."""
    if start > end:
        raise ValueError("start is after end")
    kept = entries.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return kept.groupBy("category").agg(F.count("*").alias("n"), total(F.col("transaction_type") == "income").alias("income"), F.abs(total(F.col("transaction_type") == "expense")).alias("expenses"), total().alias("net"))


def insight_summary(tx: DataFrame) -> DataFrame:
    """A4: A1 with the mean absolute value and the extremes."""
    return tx.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("amount").cast("double"))), 6).alias("mean_abs"), F.min("amount").cast("double").alias("largest_expense"), F.max("amount").cast("double").alias("largest_income"))


def category_share(tx: DataFrame) -> DataFrame:
    """A5: per category, expenses and their share of all, to one decimal."""
    g = tx.groupBy("category").agg(F.count("*").alias("n"), F.abs(total(F.col("amount") < 0)).alias("expenses"))
    whole = g.agg(F.sum("expenses").alias("whole"))
    return g.crossJoin(F.broadcast(whole)).select("category", "n", "expenses", F.round(F.when(F.col("whole") > 0, 100 * F.col("expenses") / F.col("whole")).otherwise(0.0), 1).alias("share"))


def weekday_spending(tx: DataFrame) -> DataFrame:
    """Expenses per weekday, Monday 0, zero filled."""
    days = tx.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    spent = tx.groupBy(F.weekday("date").alias("weekday")).agg(F.abs(total(F.col("amount") < 0)).alias("spent"))
    return days.join(spent, "weekday", "left").select("weekday", F.coalesce("spent", F.lit(0.0)).alias("spent"))


def peak_day(tx: DataFrame) -> DataFrame:
    """The day of month with the largest expenses; ties to the smaller day."""
    g = tx.filter("amount < 0").groupBy(F.dayofmonth("date").alias("day")).agg(F.sum("amount").alias("s"))
    return g.agg(F.max(F.struct((-F.col("s")).alias("s"), (-F.col("day")).alias("d"))).alias("m")).select((-F.col("m.d")).alias("day"), F.col("m.s").cast("double").alias("spent"))


#: Reasons why a row is unusual.
REASONS = ("Valor muito acima do padrão histórico", "Valor acima do normal", "Horário incomum (madrugada/noite)", "Transação em fim de semana pouco comum", "Padrão incomum detectado pelo modelo")


def anomaly_insights(tx: DataFrame) -> DataFrame:
    """Flagged rows (is_anomaly) with their reasons: absolute amounts over 2 or 1.5 population deviations above the mean of all rows,
    hours before 6 or after 22, weekends where under a fifth of all rows are on one; `total` flagged rows and their `share` in percent."""
    size, weekend = F.abs(F.col("amount").cast("double")), F.weekday("date") >= 5
    stats = tx.agg(
        F.avg(size).alias("mu"), F.stddev_pop(size).alias("sd"), F.avg(F.when(weekend, 1.0).otherwise(0.0)).alias("weekends"), F.count(F.when(F.col("is_anomaly"), 1)).alias("total"),
        F.round(F.try_divide(100 * F.count(F.when(F.col("is_anomaly"), 1)), F.count("*")), 1).alias("share"),
    )
    over, hour = size - F.col("mu"), F.hour("ts")
    found = F.array_compact(F.array(
        F.when((F.col("sd") > 0) & (over > 2 * F.col("sd")), REASONS[0]).when((F.col("sd") > 0) & (over > 1.5 * F.col("sd")), REASONS[1]),
        F.when((hour < 6) | (hour > 22), REASONS[2]), F.when(weekend & (F.col("weekends") < 0.2), REASONS[3]),
    ))
    rows = tx.filter("is_anomaly").crossJoin(F.broadcast(stats)).withColumn("found", found)
    return rows.select("id", F.when(F.size("found") == 0, REASONS[4]).otherwise(F.array_join("found", " • ")).alias("reason"), "total", "share")


def insight_recommendations(tx: DataFrame) -> DataFrame:
    """One row: the category of the largest expenses with their sum, how many flagged rows, and the net flow where it is negative."""
    spent = tx.groupBy("category").agg(F.abs(total(F.col("amount") < 0)).alias("spent"))
    top = spent.agg(F.max(F.struct("spent", "category")).alias("x")).select(F.when(F.col("x.spent") > 0, F.col("x.category")).alias("top_category"), F.when(F.col("x.spent") > 0, F.round("x.spent", 2)).alias("top_spent"))
    rest = tx.agg(F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"), total().alias("net")).select("anomalies", F.when(F.col("net") < 0, F.col("net")).alias("negative_net"))
    return top.crossJoin(F.broadcast(rest))


def recon_report(records: DataFrame) -> DataFrame:
    """A10: counts per status, confirmation rate, mean score of confirmed (null scores count as 0)."""
    confirmed = F.col("status") == "confirmed"
    return records.agg(F.count("*").alias("n"), count_if(F.col("status") == "pending").alias("pending"), count_if(confirmed).alias("confirmed"), count_if(F.col("status") == "rejected").alias("rejected"),
                       F.sum(F.when(confirmed, F.coalesce("match_score", F.lit(0.0)))).alias("s")).select("n", "pending", "confirmed", "rejected", F.round(F.try_divide("confirmed", "n"), 4).alias("rate"), F.round(F.try_divide("s", "confirmed"), 4).alias("mean_score"))


def reconciled_value(records: DataFrame, tx: DataFrame) -> DataFrame:
    """Absolute, credit, debit and net amounts over confirmed records."""
    rows = records.filter("status = 'confirmed'").select("bank_transaction_id").join(tx, F.col("bank_transaction_id") == F.col("id"))
    return rows.agg(money(F.sum(F.abs("amount"))).alias("absolute"), total(F.col("amount") > 0).alias("credits"), F.abs(total(F.col("amount") < 0)).alias("debits"), total().alias("net"))


def recent_activity(records: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Confirmed and rejected records created in the last days before as_of."""
    recent = F.col("created_at") >= F.expr(f"timestamp'{as_of}' - interval {days} days")
    return records.agg(count_if(recent & (F.col("status") == "confirmed")).alias("confirmed"), count_if(recent & (F.col("status") == "rejected")).alias("rejected"))


def anomaly_stats(records: DataFrame, as_of: str) -> DataFrame:
    """In one pass of grouping sets, all anomalies, those of a type and those of a severity: total, resolved, pending, the resolution rate,
    their share of all records, and what was detected and resolved in the 7 days before as_of."""
    flagged = F.col("is_anomaly")
    lately = lambda c: count_if(flagged & (F.col(c) >= F.expr(f"timestamp'{as_of}' - interval 7 days")))
    sets = records.groupingSets([[], ["anomaly_type"], ["anomaly_severity"]], "anomaly_type", "anomaly_severity")
    g = sets.agg(
        F.grouping_id().alias("_set"), F.count("*").alias("records"), count_if(flagged).alias("n"), count_if(flagged & F.col("anomaly_action").isNotNull()).alias("resolved"), lately("anomaly_detected_at").alias("detected_7d"), lately("anomaly_reviewed_at").alias("resolved_7d"),
    )
    g = g.filter((F.col("_set") == 3) | F.coalesce("anomaly_type", "anomaly_severity").isNotNull())
    return g.select(
        "anomaly_type", "anomaly_severity", "n", "resolved", (F.col("n") - F.col("resolved")).alias("pending"), F.round(F.try_divide("resolved", "n"), 4).alias("resolution_rate"),
        F.when(F.col("_set") == 3, F.round(F.try_divide("n", "records"), 4)).alias("anomaly_rate"), "detected_7d", "resolved_7d", (F.col("detected_7d") - F.col("resolved_7d")).alias("net_7d"),
    )


def similar_resolutions(similar: DataFrame, records: DataFrame) -> DataFrame:
    """Per anomaly how its similar ones (id, other_id) were resolved; open ones count as pending."""
    actions = records.select(F.col("id").alias("other_id"), F.coalesce("anomaly_action", F.lit("pending")).alias("action"))
    return similar.join(actions, "other_id").groupBy("id", "action").agg(F.count("*").alias("n"))


def feedback_learning(feedback: DataFrame) -> DataFrame:
    """Per user of feedback (user_id, kind, confidence, original, adjusted): how many, of confirmations, mean confidence (none rated: 0) and mean change of the score."""
    rated = F.when(F.col("confidence") != 0, F.col("confidence"))
    return feedback.groupBy("user_id").agg(
        F.count("*").alias("n"), count_if(F.col("kind") == "confirm").alias("confirmed"), F.round(F.coalesce(F.avg(rated), F.lit(0.0)), 4).alias("mean_confidence"), F.round(F.avg(F.col("adjusted") - F.col("original")), 4).alias("mean_change"),
    )


def workflow_analytics(log: DataFrame) -> DataFrame:
    """Per template of workflows (workflow, template, state, started, ended): how many, completed, escalated, rejected and their shares, mean seconds to completion."""
    done = F.col("state") == "completed"
    share = lambda state: F.round(count_if(F.col("state") == state) / F.count("*"), 4)
    return log.groupBy("template").agg(
        F.count("*").alias("n"), count_if(done).alias("completed"), share("escalated").alias("escalation_rate"), share("rejected").alias("rejection_rate"),
        F.round(F.avg(F.when(done, F.unix_timestamp("ended") - F.unix_timestamp("started"))), 2).alias("mean_seconds"),
    )


def compliance_report(log: DataFrame, start: str, end: str) -> DataFrame:
    """Events of a period in all, by type and by user, with how many are critical, high and violations, in one pass of grouping sets."""
    rows = log.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    g = rows.groupingSets([[], ["event_type"], ["user_id"]], "event_type", "user_id").agg(
        F.count("*").alias("n"), count_if(F.col("severity") == "critical").alias("critical"), count_if(F.col("severity") == "high").alias("high"), count_if(F.col("violation")).alias("violations"),
    )
    return g.select("event_type", "user_id", "n", "critical", "high", "violations")


def escalation_stats(events: DataFrame) -> DataFrame:
    """Escalations in all, by level and by trigger."""
    g = events.groupingSets([[], ["level"], ["trigger"]], "level", "trigger").agg(F.count("*").alias("n"), F.count_distinct("id").alias("items"))
    return g.select("level", "trigger", "n", "items")


def anomaly_stats_by_reviewer(records: DataFrame) -> DataFrame:
    """Per reviewer, counts by action and mean hours to resolve."""
    hours = (F.unix_timestamp("anomaly_reviewed_at") - F.unix_timestamp("anomaly_detected_at")) / 3600
    return records.filter("anomaly_reviewed_by is not null").groupBy("anomaly_reviewed_by").agg(F.count("*").alias("handled"), count_if(F.col("anomaly_action") == "confirmed").alias("confirmed"), count_if(F.col("anomaly_action") == "dismissed").alias("dismissed"), F.round(F.avg(hours), 4).alias("mean_hours"))


def anomaly_trend(records: DataFrame) -> DataFrame:
    """Anomalies detected per day."""
    return records.filter("is_anomaly").groupBy(F.to_date("anomaly_detected_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


def reviewer_performance(records: DataFrame) -> DataFrame:
    """Handled, confirmation and dismissal rate per reviewer."""
    g = records.filter("anomaly_reviewed_by is not null").groupBy("anomaly_reviewed_by").agg(F.count("*").alias("handled"), count_if(F.col("anomaly_action") == "confirmed").alias("c"), count_if(F.col("anomaly_action") == "dismissed").alias("d"))
    return g.select("anomaly_reviewed_by", "handled", F.round(F.col("c") / F.col("handled"), 4).alias("confirmation_rate"), F.round(F.col("d") / F.col("handled"), 4).alias("dismissal_rate"))


def category_transitions(tx: DataFrame, old: Column, new: Column, k: int = 50) -> DataFrame:
    """(old, new) category counts, the top k."""
    return tx.groupBy(old.alias("old"), new.alias("new")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "old", "new").limit(k)


def monthly_series(tx: DataFrame) -> DataFrame:
    """Income and expense per month over a gap-free range of months."""
    rows = tx.groupBy(F.trunc("date", "month").alias("m")).agg(total(F.col("amount") > 0).alias("income"), F.abs(total(F.col("amount") < 0)).alias("expense"))
    months = rows.agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return months.join(rows, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("income", F.lit(0.0)).alias("income"), F.coalesce("expense", F.lit(0.0)).alias("expense"))


def monthly_statement(tx: DataFrame) -> DataFrame:
    """Per month and category, income, expenses and net."""
    return tx.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "category").agg(total(F.col("amount") > 0).alias("income"), F.abs(total(F.col("amount") < 0)).alias("expenses"), total().alias("net"))


def retention_counts(tables: dict[str, tuple[DataFrame, str]], as_of: str, days: int) -> DataFrame:
    """Rows older than `days` before as_of, per table."""
    out = None
    for name, (df, column) in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), count_if(F.col(column) < F.expr(f"timestamp'{as_of}' - interval {days} days")).alias("old"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and missing values per column, from one aggregation turned to long form."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"{c}_known") for c in columns])
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n"), (F.col("n") - F.col(f"{c}_known")).alias("missing")) for c in columns]))
    return one.select(items.alias("x")).select("x.*")


def forecast_trend(series: DataFrame, periods: int) -> DataFrame:
    """Least-squares lines of income and expense over the month index, `periods` months on, never below 0, and their net; a series that doesn't vary keeps its last value."""
    if not 1 <= periods <= 24:
        raise ValueError("periods must be 1 to 24")
    first = series.agg(F.min("month").alias("a"))
    at = series.crossJoin(F.broadcast(first)).withColumn("i", F.months_between(F.to_date(F.concat("month", F.lit("-01"))), F.to_date(F.concat("a", F.lit("-01")))))
    fits = [x for c in ("income", "expense") for x in (F.regr_slope(c, "i").alias(f"{c}_k"), F.regr_intercept(c, "i").alias(f"{c}_b"), F.stddev(c).alias(f"{c}_s"), F.max_by(c, "i").alias(f"{c}_l"))]
    fit = at.agg(F.max("i").alias("last"), F.first("a").alias("a"), *fits)
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))

    def value(c: str) -> Column:
        line = F.col(f"{c}_b") + F.col(f"{c}_k") * (F.col("last") + F.col("step"))
        return F.greatest(F.lit(0.0), F.when(F.coalesce(F.col(f"{c}_s"), F.lit(0.0)) <= 1e-8, F.col(f"{c}_l")).otherwise(line))

    month = F.date_format(F.add_months(F.to_date(F.concat("a", F.lit("-01"))), (F.col("last") + F.col("step")).cast("int")), "yyyy-MM")
    return ahead.select(month.alias("month"), F.round(value("income"), 4).alias("income"), F.round(value("expense"), 4).alias("expense"), F.round(value("income") - value("expense"), 4).alias("net"))


def forecast_transactions(tx: DataFrame, periods: int, least: int = 30) -> DataFrame:
    """L7 from transactions: a forecast needs `least` rows; ValueError under that."""
    if (found := tx.limit(least).count()) < least:
        raise ValueError(f"a forecast needs {least} rows, there are {found}")
    return forecast_trend(monthly_series(tx), periods)


def quantiles(rows: DataFrame, column: str, shares: list[float], digits: int = 2) -> list[float]:
    """Exact quantiles with linear interpolation of a decimal column: counts per value, ranges of values counted first, so that
    only the values of the few ranges that hold a wanted rank are ordered, and no task holds all of them."""
    values = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    low, high, total = values.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if not total:
        return []
    bins = 4096
    width = max(float(high - low) / bins, 10.0**-digits)
    at = F.floor((F.col("v") - F.lit(low)).cast("double") / width).cast("long")
    counts = sorted((r["b"], r["n"]) for r in values.groupBy(at.alias("b")).agg(F.sum("n").alias("n")).collect())  # bins + 1 at most
    ranks = sorted({r for q in shares for r in (int(q * (total - 1)), min(int(q * (total - 1)) + 1, total - 1))})
    wanted, before = {}, 0
    for b, n in counts:
        if any(before <= r < before + n for r in ranks):
            wanted[b] = before
        before += n
    w = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = values.withColumn("b", at).filter(F.col("b").isin(list(wanted))).withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    starts = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    rank = F.element_at(starts, F.col("b")) + F.col("below")
    hit = near.withColumn("rank", rank).filter(" or ".join(f"(rank <= {r} and {r} < rank + n)" for r in ranks)).select("rank", "n", F.col("v").cast("double").alias("v")).collect()
    value = lambda r: next(x["v"] for x in hit if x["rank"] <= r < x["rank"] + x["n"])
    out = []
    for q in shares:
        p = q * (total - 1)
        a, b = value(int(p)), value(min(int(p) + 1, total - 1))
        out.append(a + (b - a) * (p - int(p)))
    return out


def trim_history(tx: DataFrame) -> DataFrame:
    """Rows with date and amount, amounts within the exact 1st and 99th percentiles."""
    rows = tx.filter("date is not null and amount is not null")
    cut = quantiles(rows, "amount", [0.01, 0.99])
    return rows.filter(F.col("amount").cast("double").between(*map(F.lit, cut))) if cut else rows
