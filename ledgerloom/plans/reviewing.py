"""Queries of reviews, permissions, escalation and file types, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import joins, reports, reviews, windows, workflow
from ledgerloom.plans import adapters
from ledgerloom.plans.registry import AS_OF, LOG, ROLES, SQL, Views, _log, reg
from ledgerloom.plans.rules import _ESC, _OPENED, _open, case, quoted, with_views
from ledgerloom.sources import ledger

# Reviews
_feedback = lambda v: v.table("events").select(F.col("user_id") % 40, case(F.col("event_id") % 4, "confirm", "dismiss", "confirm", "adjust").alias("kind"), adapters.pick(adapters.TYPES, F.col("event_id") % 5).alias("anomaly_type"), F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 6).alias("rating")).toDF("user_id", "kind", "anomaly_type", "rating")
_FEEDBACK = f"""fb AS (SELECT user_id % 40 AS user_id, ['confirm', 'dismiss', 'confirm', 'adjust'][CAST(event_id % 4 + 1 AS INT)] AS kind, {adapters._list(adapters.TYPES)}[CAST(event_id % 5 + 1 AS INT)] AS anomaly_type, event_id % 6 AS rating FROM events),
  hist AS (SELECT user_id, count(*) AS total_handled, avg((kind = 'confirm')::INT) AS confirmation_rate, avg(rating) AS mean_rating FROM fb WHERE kind <> 'adjust' GROUP BY 1)"""
reg("A19_reviewer_history_by_type", lambda v: reviews.reviewer_history(_feedback(v)).withColumns({c: F.round(c, 6) for c in ("confirmation_rate", "mean_rating")}),
    f"WITH {_FEEDBACK} SELECT user_id, anomaly_type, count(*) AS type_handled, any_value(total_handled) AS total_handled, round(any_value(confirmation_rate), 6) AS confirmation_rate, round(any_value(mean_rating), 6) AS mean_rating FROM fb JOIN hist USING (user_id) WHERE kind <> 'adjust' GROUP BY 1, 2")


def _suggested(v: Views) -> DataFrame:
    """Each anomaly asked about by a user, of whom some are new, some lean to one side."""
    records, similar = v.recon(), joins.similar_anomalies(v.recon(), AS_OF, 5)
    acts = similar.join(records.select(F.col("id").alias("other_id"), F.when(F.col("id") % 4 == 0, "escalated").when(F.col("id") % 6 == 0, "dismissed").when(F.col("id") % 10 > 0, "confirmed").alias("action")), "other_id")
    users = v.table("events").select((F.col("user_id") % 40).alias("user_id")).distinct().filter("user_id > 2").select("user_id", F.when(F.col("user_id") < 10, 2).otherwise(F.col("user_id") % 13).alias("total_handled"), (F.col("user_id") % 11 / 10).alias("confirmation_rate"))
    asked = records.filter("is_anomaly").select("id", "anomaly_type", F.when(F.col("id") % 9 > 0, F.col("anomaly_severity")).alias("severity"), (F.col("id") % 40).alias("user_id"))
    found = reviews.review_suggestions(asked, acts, users)
    shown = F.array_join(F.transform("actions", lambda a: F.concat(a["action"], F.lit("="), F.round(a["confidence"] * 10).cast("int").cast("string"))), ",")
    return found.select("id", F.array_join("suggestions", "|").alias("suggestions"), shown.alias("actions"), "complexity", "estimated_time", F.col("similar_count").alias("n_similar"))


reg("D15_review_suggestions", _suggested)
_lift = lambda name, trust: f"CASE WHEN h > 3 AND rate {'> 0.7' if name == 'confirm' else '< 0.3'} THEN least(10, {trust} + 2) ELSE {trust} END" if name in ("confirm", "dismiss") else f"{trust}"
_pair = lambda a, b: f"CASE WHEN {_lift(a[0], round(a[1] * 10))} > {_lift(b[0], round(b[1] * 10))} OR ({_lift(a[0], round(a[1] * 10))} = {_lift(b[0], round(b[1] * 10))} AND '{a[0]}' < '{b[0]}') THEN '{a[0]}=' || {_lift(a[0], round(a[1] * 10))} || ',{b[0]}=' || {_lift(b[0], round(b[1] * 10))} ELSE '{b[0]}=' || {_lift(b[0], round(b[1] * 10))} || ',{a[0]}=' || {_lift(a[0], round(a[1] * 10))} END"
with_views("D15_review_suggestions", f""", sim AS (SELECT a.id, b.id AS other_id FROM recon a JOIN recon b ON a.is_anomaly AND b.is_anomaly AND a.anomaly_type = b.anomaly_type AND a.id <> b.id AND b.anomaly_detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.anomaly_detected_at DESC, b.id DESC) <= 5),
  act AS (SELECT id, CASE WHEN other_id % 4 = 0 THEN 'escalated' WHEN other_id % 6 = 0 THEN 'dismissed' WHEN other_id % 10 > 0 THEN 'confirmed' END AS action FROM sim), near AS (SELECT id, count(*) AS k, count(*) FILTER (action = 'confirmed') AS c, count(DISTINCT action) AS varied FROM act GROUP BY 1),
  us AS (SELECT DISTINCT user_id % 40 AS uid FROM events WHERE user_id % 40 > 2),
  x AS (SELECT r.id, anomaly_type AS t, CASE WHEN r.id % 9 > 0 THEN anomaly_severity END AS s, coalesce(k, 0) AS k, coalesce(c, 0) AS c, coalesce(varied, 0) AS varied, coalesce(CASE WHEN uid < 10 THEN 2 ELSE uid % 13 END, 0) AS h, coalesce((uid % 11) / 10, 0.0) AS rate FROM recon r LEFT JOIN near ON near.id = r.id LEFT JOIN us ON uid = r.id % 40 WHERE is_anomaly)
  SELECT id, concat_ws('|', CASE WHEN h > 5 AND rate > 0.8 THEN 'Based on your history, you tend to confirm this type of anomaly' WHEN h > 5 AND rate < 0.2 THEN 'Based on your history, you tend to dismiss this type of anomaly' END,
      CASE WHEN k > 0 AND c / k > 0.7 THEN 'Similar anomalies were usually confirmed' WHEN k > 0 AND c / k < 0.3 THEN 'Similar anomalies were usually dismissed' END, CASE WHEN s IN ('critical', 'high') THEN 'Consider escalating this anomaly due to high severity' WHEN s = 'low' THEN 'This low-severity anomaly may be safe to dismiss' END) AS suggestions,
    coalesce(CASE s {' '.join(f"WHEN '{s}' THEN {_pair(*a)}" for s, a in reviews.ACTIONS.items())} END, '') AS actions,
    CASE WHEN p <= 2 THEN 'simple' WHEN p <= 4 THEN 'moderate' ELSE 'complex' END AS complexity,
    CASE WHEN h > 10 THEN '~' || CAST(floor(m * 0.7) AS INT) || ' minutes (experienced user)' WHEN h < 3 THEN '~' || CAST(floor(m * 1.5) AS INT) || ' minutes (new user)' ELSE CASE s {' '.join(f"WHEN '{s}' THEN '{a}'" for s, (a, _) in reviews.TIMES.items())} ELSE '30 minutes' END END AS estimated_time, k AS n_similar
  FROM (SELECT *, CASE s {' '.join(f"WHEN '{s}' THEN {m}" for s, (_, m) in reviews.TIMES.items())} ELSE 30 END AS m, CASE s {' '.join(f"WHEN '{s}' THEN {n}" for s, n in reviews.POINTS.items())} ELSE 2 END + (t IN ({quoted(reviews.COMPLEX)}))::INT + (varied > 2)::INT AS p FROM x)""")

# Permissions
_NEEDED = sorted({p for ps in workflow.PERMISSIONS.values() for p in ps})
_asks = lambda v: v.bank().select("id", adapters.pick([*ROLES, "guest"], F.col("id") % 6).alias("role"), adapters.pick(_NEEDED, F.floor(F.col("id") / 6) % len(_NEEDED)).alias("permission"), case(F.col("id") % 10, *workflow.RESOURCES, None, None).alias("resource"), (F.col("amount") * 500).alias("amount"))
_MAY = "(VALUES " + ", ".join(f"('{r}', '{p}')" for r, ps in workflow.PERMISSIONS.items() for p in ps) + ") may(mr, mp)"
_REACH = "(VALUES " + ", ".join(f"('{r}', '{x}', '{a}')" for r, xs in workflow.ACCESS.items() for x, a in xs.items()) + ") reach(rr, rx, access)"
_LIMITED = "CASE role WHEN 'operator' THEN 5000 WHEN 'reviewer' THEN 25000 WHEN 'approver' THEN 100000 WHEN 'auditor' THEN 0 END"
_DENIED = f"CASE WHEN mp IS NULL THEN 'no permission' WHEN resource IS NOT NULL AND access IS NULL THEN 'no access' WHEN resource IS NOT NULL AND abs(amount) > {_LIMITED} THEN 'amount over limit' END"
reg("J19_permissions", lambda v: workflow.authorize_actions(_asks(v)).select("id", "is_allowed", "access", "deny_reason"))
SQL["J19_permissions"] = adapters.VIEWS + f"""SELECT id, {_DENIED} IS NULL AS is_allowed, coalesce(access, 'none') AS access, {_DENIED} AS deny_reason FROM (SELECT id, {adapters._list([*ROLES, 'guest'])}[CAST(id % 6 + 1 AS INT)] AS role, {adapters._list(_NEEDED)}[CAST((id // 6) % {len(_NEEDED)} + 1 AS INT)] AS permission,
    [{quoted(workflow.RESOURCES)}, NULL, NULL][CAST(id % 10 + 1 AS INT)] AS resource, amount * 500 AS amount FROM bank_tx) LEFT JOIN {_MAY} ON mr = role AND mp = permission LEFT JOIN {_REACH} ON rr = role AND rx = resource"""
reg("J19_workflow_actions", lambda v: workflow.authorize_workflow(_log(v)).select("id", "permission", "is_allowed", "deny_reason"))
SQL["J19_workflow_actions"] = adapters.VIEWS + f"""SELECT id, permission, {_DENIED} IS NULL AS is_allowed, {_DENIED} AS deny_reason FROM (SELECT id, role, amount, 'reconciliation' AS resource, CASE action {' '.join(f"WHEN '{a}' THEN '{p}'" for a, p in workflow.ACTION_PERMISSIONS.items())} END AS permission FROM {LOG})
    LEFT JOIN {_MAY} ON mr = role AND mp = permission LEFT JOIN {_REACH} ON rr = role AND rx = resource"""

# Escalation
_flagged = lambda v: _open(v).withColumns({"compliance_issue": F.when(F.col("id") % 3 > 0, F.col("id") % 40 == 1), "rejections": F.when(F.col("id") % 5 > 0, F.col("id") % 6), "level": F.col("id") % 3})
reg("J17_all_rules", lambda v: workflow.escalate(_flagged(v), AS_OF).select("id", "rule", "from_level", "level", "severity"))
_ALL = "coalesce((trigger = 'timeout' AND hours >= h) OR (trigger = 'threshold_exceeded' AND abs(amount) >= a) OR (trigger = 'risk_threshold' AND match_score <= m)"
SQL["J17_all_rules"] = adapters.VIEWS + f"""SELECT id, rule, id % 3 AS from_level, level, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity FROM {_OPENED} o JOIN {_ESC} ON (e.st IS NULL OR e.st = o.state) AND {_ALL}
    OR (trigger = 'compliance_violation' AND id % 3 > 0 AND id % 40 = 1) OR (trigger = 'rejection_threshold' AND id % 5 > 0 AND id % 6 >= 3), false)"""
reg("J17_strict_reference", lambda v: workflow.escalate(_flagged(v), AS_OF, strict_reference=True).groupBy("rule").agg(F.count("*").alias("n")))
SQL["J17_strict_reference"] = adapters.VIEWS + f"SELECT rule, count(*) AS n FROM {_OPENED} o JOIN {_ESC} ON rule <> 'critical_value_transaction' AND {_ALL}, false) GROUP BY 1"

# Files and series
_bank_file = lambda v: v.bank().select(F.col("date").cast("string").alias("Data"), "description", F.col("amount").cast("string").alias("Valor"), F.lit("10").alias("Saldo"))
_company_file = lambda v: v.ledger().select(F.col("date").cast("string").alias("Data"), F.abs("amount").cast("string").alias("Valor"), F.col("category").alias("Categoria"), F.col("department").alias("Departamento"))
_other_file = lambda v: v.ledger().select(F.col("description").alias("Texto"), F.abs("amount").alias("Valor"))


def _classified(v: Views) -> DataFrame:
    named = [ledger.classify_file(df).withColumn("file", F.lit(name)) for name, df in (("bank", _bank_file(v)), ("company", _company_file(v)), ("other", _other_file(v)))]
    return named[0].union(named[1]).union(named[2])


reg("A31_file_classifier", _classified)
SQL["A31_file_classifier"] = adapters.VIEWS + """SELECT 'bank' AS file, 3 + (max(amount) > 0 AND min(amount) < 0)::INT AS bank_score, 0 AS company_score, 'Bank Statement' AS file_type FROM bank_tx UNION ALL SELECT 'company', 0, 4, 'Company Financial Data' FROM ledger HAVING count(*) > 0
    UNION ALL SELECT 'other', 0, 0, 'Unknown' FROM ledger HAVING count(*) > 0"""
reg("W8_busy_days", lambda v: windows.frequency_spikes(v.bank(), 1.1), SQL["W8_frequency_spikes"].replace("1.5 * median", "1.1 * median"))
SQL["W8_busy_days"] = SQL["W8_frequency_spikes"].replace("1.5 * median", "1.1 * median")
reg("L7_forecast_transactions", lambda v: reports.forecast_transactions(v.bank(), 6))
SQL["L7_forecast_transactions"] = SQL["L7_forecast_trend"]

# Categories that the sign changes, over the same rows as X22
SQL["A24_category_transitions"] = adapters.VIEWS + f"""SELECT b.category AS old, x.adjusted AS new, count(*) AS n FROM bank_tx b JOIN ({SQL['X22_category_by_sign'].removeprefix(adapters.VIEWS)}) x USING (id) GROUP BY 1, 2 ORDER BY n DESC, old, new LIMIT 50"""
