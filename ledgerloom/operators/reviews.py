"""Hints for reviewers of anomalies (D15) and the history of reviewers by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By severity, actions with confidence and reason, minutes and points of complexity; types that are complex.
ACTIONS = {
    "critical": [("escalate", 0.9, "Critical severity requires escalation"), ("confirm", 0.8, "Critical anomaly should be confirmed")],
    "high": [("confirm", 0.7, "High severity anomaly likely real"), ("request_info", 0.6, "May need additional information")],
    "low": [("dismiss", 0.6, "Low severity anomaly may be false positive"), ("confirm", 0.4, "Still worth confirming")],
}
TIMES = {"low": ("5-10 minutes", 10), "medium": ("15-30 minutes", 30), "high": ("30-60 minutes", 60), "critical": ("1-2 hours", 120)}
POINTS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
COMPLEX = ["amount_mismatch", "compliance_risk", "unusual_pattern"]


def reviewer_history(feedback: DataFrame) -> DataFrame:
    """Per (user_id, anomaly_type) of feedback (user_id, kind, anomaly_type, rating): how many of the type, and of all types how many, the share
    confirmed and the mean rating, where no rating counts as 0. Only confirmations and dismissals count."""
    rows = feedback.filter(F.col("kind").isin("confirm", "dismiss"))
    whole = rows.groupBy("user_id").agg(F.count("*").alias("total_handled"), F.avg((F.col("kind") == "confirm").cast("double")).alias("confirmation_rate"), F.avg(F.coalesce("rating", F.lit(0)).cast("double")).alias("mean_rating"))
    return rows.groupBy("user_id", "anomaly_type").agg(F.count("*").alias("type_handled")).join(whole, "user_id")


def review_suggestions(asked: DataFrame, similar: DataFrame, history: DataFrame) -> DataFrame:
    """Anomalies (id, anomaly_type, severity, user_id) with hints, actions by confidence, complexity and the time to expect.

    similar (id, action) holds the actions on the anomaly's similar ones, null where none was taken; they are summed per anomaly. history is
    a row per user (user_id, total_handled, confirmation_rate); an unknown user has handled none. Times are minutes: hours of the
    fixed text are turned into minutes before experience shortens or lengthens them.
    """
    done = lambda *names: F.count_if(F.col("action").isin(*names))
    near = similar.groupBy("id").agg(F.count("*").alias("_similar"), done("confirm", "confirmed").alias("_confirmed"), F.count_distinct("action").alias("_varied"))
    users = history.select(F.col("user_id"), F.col("total_handled").alias("_handled"), F.col("confirmation_rate").alias("_rate")).dropDuplicates(["user_id"])
    rows = asked.join(near, "id", "left").join(users, "user_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_similar", "_confirmed", "_varied", "_handled")}).withColumn("_rate", F.coalesce("_rate", F.lit(0.0)))
    severity, handled, rate = F.col("severity"), F.col("_handled"), F.col("_rate")
    share = F.col("_confirmed") / F.col("_similar")
    hints = F.array_compact(F.array(
        F.when((handled > 5) & (rate > 0.8), "Based on your history, you tend to confirm this type of anomaly").when((handled > 5) & (rate < 0.2), "Based on your history, you tend to dismiss this type of anomaly"),
        F.when(F.col("_similar") > 0, F.when(share > 0.7, "Similar anomalies were usually confirmed").when(share < 0.3, "Similar anomalies were usually dismissed")),
        F.when(severity.isin("critical", "high"), "Consider escalating this anomaly due to high severity").when(severity == "low", "This low-severity anomaly may be safe to dismiss"),
    ))

    def action(name: str, trust: float, reason: str) -> Column:
        lift = {"confirm": (handled > 3) & (rate > 0.7), "dismiss": (handled > 3) & (rate < 0.3)}.get(name, F.lit(False))
        return F.struct(F.round(-F.least(F.lit(1.0), F.lit(trust) + F.when(lift, 0.2).otherwise(0.0)), 6).alias("order"), F.lit(name).alias("action"), F.lit(reason).alias("reason"))

    listed = F.coalesce(*[F.when(severity == s, F.array(*[action(*a) for a in actions])) for s, actions in ACTIONS.items()], F.array().cast("array<struct<order: double, action: string, reason: string>>"))
    ranked = F.transform(F.array_sort(listed), lambda x: F.struct(x["action"].alias("action"), (-x["order"]).alias("confidence"), x["reason"].alias("reason")))
    of = lambda table, place, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[place] if place is not None else v)]), severity), F.lit(other))
    minutes = of(TIMES, 1, 30)
    about = lambda times, who: F.concat(F.lit("~"), F.floor(minutes * times + 1e-9).cast("string"), F.lit(f" minutes ({who} user)"))
    points = of(POINTS, None, 2) + F.col("anomaly_type").isin(COMPLEX).cast("int") + (F.col("_varied") > 2).cast("int")
    return rows.withColumns({
        "suggestions": hints, "actions": ranked, "similar_count": F.col("_similar"), "complexity": F.when(points <= 2, "simple").when(points <= 4, "moderate").otherwise("complex"),
        "estimated_time": F.when(handled > 10, about(0.7, "experienced")).when(handled < 3, about(1.5, "new")).otherwise(of(TIMES, 0, "30 minutes")),
    }).drop("_similar", "_confirmed", "_varied", "_handled", "_rate")
