"""Workflow, escalation, permissions, audit and retention rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (state, action, next state, roles).
TRANSITIONS = [
    ("draft", "submit_for_review", "pending_review", "operator,reviewer"), ("pending_review", "approve_review", "pending_approval", "reviewer,approver"),
    ("pending_review", "request_changes", "draft", "reviewer"), ("pending_review", "reject_review", "rejected", "reviewer,approver"),
    ("pending_approval", "approve_final", "approved", "approver"), ("pending_approval", "escalate", "escalated", "approver"),
    ("pending_approval", "reject_final", "rejected", "approver"), ("approved", "reconcile", "reconciled", "operator,reviewer"),
    ("reconciled", "complete", "completed", "admin"), ("pending_review", "put_on_hold", "on_hold", "reviewer,approver"),
    ("pending_approval", "put_on_hold", "on_hold", "approver"), ("on_hold", "resume", "pending_review", "reviewer,approver"),
    ("draft", "cancel", "cancelled", "operator,reviewer"), ("pending_review", "cancel", "cancelled", "reviewer,approver"),
]
#: Minutes that a state may last, and amount limits of roles (null: none).
STATE_LIMITS = {"pending_review": 1440, "pending_approval": 2880, "escalated": 7200, "on_hold": 10080}
#: States that end by themselves as `escalated`, and after how many minutes.
AUTO_LIMITS = {"pending_review": 1440, "pending_approval": 2880}
ROLE_LIMITS = {"operator": 5000.0, "reviewer": 25000.0, "approver": 100000.0, "admin": None, "auditor": 0.0}
#: Legacy states, who hears of a new state and by what template, and states of high priority.
LEGACY = {"pending": "pending_review", "confirmed": "reconciled"}
NOTICES = [
    ("pending_review", "reviewer", "pending_review_notification"), ("pending_approval", "approver", "pending_approval_notification"), ("escalated", "admin", "escalation_notification"),
    ("rejected", "operator", "rejection_notification"), ("approved", "operator", "approval_notification"),
]
#: Fixed values: (rule, trigger, state, hours, least amount, largest score, level, role).
ESCALATIONS = [
    ("timeout_review", "timeout", "pending_review", 24.0, None, None, 1, "reviewer"), ("timeout_approval", "timeout", "pending_approval", 48.0, None, None, 2, "approver"),
    ("timeout_escalated", "timeout", "escalated", 8.0, None, None, 3, "admin"), ("high_value_transaction", "threshold_exceeded", None, None, 100_000.0, None, 2, "approver"),
    ("critical_value_transaction", "threshold_exceeded", None, None, 500_000.0, None, 3, "admin"), ("high_risk_match", "risk_threshold", None, None, None, 0.3, 2, "approver"),
    ("very_high_risk_match", "risk_threshold", None, None, None, 0.1, 3, "admin"),
    ("compliance_violation", "compliance_violation", None, None, None, None, 3, "admin"), ("multiple_rejections", "rejection_threshold", None, None, None, None, 2, "approver"),
]
#: Rules that one run may have.
MOST_RULES = 1_000
#: Rejections that make `multiple_rejections`.
REJECTIONS = 3
#: What each role may do, and its access to each resource; an administrator may do all.
VIEWING = ["view_transactions", "view_reconciliation", "view_workflow_history", "view_financial_data", "view_reports", "export_data"]
EDITING = ["create_transactions", "edit_transactions", "create_reconciliation", "edit_reconciliation"]
REVIEWING = ["approve_reconciliation", "reject_reconciliation", "manage_workflow", "edit_financial_data"]
ADMINISTRATION = ["delete_transactions", "delete_reconciliation", "configure_system"]
PERMISSIONS = {
    "operator": [*VIEWING, *EDITING],
    "reviewer": [*VIEWING, *EDITING, *REVIEWING],
    "approver": [*VIEWING, *EDITING, *REVIEWING, "escalate_reconciliation", "manage_users", "view_audit_logs", "approve_financial_data"],
    "admin": [*VIEWING, *EDITING, *REVIEWING, "escalate_reconciliation", "manage_users", "view_audit_logs", "approve_financial_data", *ADMINISTRATION],
    "auditor": [*VIEWING, "view_audit_logs"],
}
RESOURCES = ["transactions", "reconciliation", "workflow", "users", "audit_logs", "reports", "financial_data", "system_config"]
ACCESS = {
    "operator": {"transactions": "write", "reconciliation": "write", "financial_data": "read", "reports": "read"},
    "reviewer": {"transactions": "write", "reconciliation": "execute", "workflow": "write", "financial_data": "write", "reports": "read"},
    "approver": {"transactions": "execute", "reconciliation": "execute", "workflow": "execute", "users": "read", "audit_logs": "read", "financial_data": "execute", "reports": "read"},
    "admin": dict.fromkeys(RESOURCES, "admin"),
    "auditor": dict.fromkeys(["transactions", "reconciliation", "workflow", "audit_logs", "financial_data", "reports"], "read"),
}
#: The permission that a workflow action needs.
ACTION_PERMISSIONS = {
    "create": "create_reconciliation", "submit_for_review": "edit_reconciliation", "request_changes": "edit_reconciliation", "approve_review": "approve_reconciliation", "reject_review": "reject_reconciliation",
    "submit_for_approval": "edit_reconciliation", "approve_final": "approve_reconciliation", "reject_final": "reject_reconciliation", "escalate": "escalate_reconciliation", "cancel": "edit_reconciliation",
    "put_on_hold": "manage_workflow", "resume": "manage_workflow", "reconcile": "edit_reconciliation", "complete": "manage_workflow",
}
LEVELS = {1: "low", 2: "medium", 3: "high", 4: "critical", 5: "urgent"}
#: Days that events of a class are kept.
RETENTION = {"user": 365, "reconciliation": 2555, "workflow": 2555, "system": 90, "security": 2555, "compliance": 2555}
SENSITIVE = "password|token|secret|key|credential|ssn|tax_id|bank_account|credit_card"


def transition_table(df: DataFrame) -> DataFrame:
    """The fixed rules as rows; a few dozen, so broadcast."""
    rows = [(s, a, n, r) for s, a, n, roles in TRANSITIONS for r in roles.split(",")]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "state string, action string, next_state string, role string"))


def transition_lookup(log: DataFrame) -> DataFrame:
    """Next state of each (state, action, role), `invalid` without a rule."""
    return log.join(transition_table(log), ["state", "action", "role"], "left").withColumn("next_state", F.coalesce("next_state", F.lit("invalid")))


def authorize(log: DataFrame) -> DataFrame:
    """Whether a role may handle the amount, and why not."""
    limits = F.broadcast(log.sparkSession.createDataFrame(list(ROLE_LIMITS.items()), "role string, limit double"))
    rows = log.join(limits, "role", "left")
    over = F.col("limit").isNotNull() & (F.abs(F.col("amount").cast("double")) > F.col("limit"))
    return rows.withColumn("is_allowed", ~over).withColumn("deny_reason", F.when(over, "amount over limit")).drop("limit")


def authorize_actions(log: DataFrame) -> DataFrame:
    """Rows (role, permission, resource, amount) with is_allowed, access and deny_reason: the role must have the permission, some access to
    the resource if one is named, and then the amount, if any, within its limit. Unknown roles may do nothing.

    The tables of roles are fixed and small, so they are broadcast; the log is not shuffled.
    """
    spark = log.sparkSession
    may = F.broadcast(spark.createDataFrame([(r, p, True) for r, ps in PERMISSIONS.items() for p in ps], "role string, permission string, _may boolean"))
    reach = F.broadcast(spark.createDataFrame([(r, x, a) for r, xs in ACCESS.items() for x, a in xs.items()], "role string, resource string, access string"))
    limits = F.broadcast(spark.createDataFrame(list(ROLE_LIMITS.items()), "role string, _limit double"))
    rows = log.join(may, ["role", "permission"], "left").join(reach, ["role", "resource"], "left").join(limits, "role", "left")
    named = F.col("resource").isNotNull()
    over = named & (F.abs(F.col("amount").cast("double")) > F.col("_limit"))
    reason = F.when(F.col("_may").isNull(), "no permission").when(named & F.col("access").isNull(), "no access").when(F.coalesce(over, F.lit(False)), "amount over limit")
    return rows.withColumns({"deny_reason": reason, "is_allowed": reason.isNull(), "access": F.coalesce("access", F.lit("none"))}).drop("_may", "_limit")


def authorize_workflow(log: DataFrame) -> DataFrame:
    """Rows (role, action, amount): the action's own permission, on reconciliations; an unknown action is refused."""
    needed = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_PERMISSIONS.items() for x in kv]), F.col("action"))
    return authorize_actions(log.withColumns({"permission": needed, "resource": F.lit("reconciliation")}))


def role_access_summary(log: DataFrame) -> DataFrame:
    """Allowed and denied actions and amounts per role."""
    return authorize(log).groupBy("role", "is_allowed").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


def timed_out(rows: DataFrame, as_of: str) -> DataFrame:
    """Rows in a state longer than its limit at as_of."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in STATE_LIMITS.items() for x in kv]), F.col("state"))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("since")) / 60
    return rows.withColumn("age_minutes", F.floor(age)).filter(F.col("age_minutes") > limit)


def mask_sensitive(m: Column) -> Column:
    """Values under sensitive keys become up to eight stars, numbers 0; in a map of texts a number is what reads as one."""
    number = lambda v: v.try_cast("double").isNotNull()
    hidden = lambda v: F.when(number(v), "0").otherwise(F.repeat(F.lit("*"), F.least(F.length(v), F.lit(8))))
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike(SENSITIVE), hidden(v)).otherwise(v))


def changed_fields(old: Column, new: Column) -> Column:
    """Sorted keys whose values differ; empty unless both maps have entries."""
    keys = F.array_sort(F.filter(F.array_union(F.map_keys(old), F.map_keys(new)), lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k))))
    return F.when((F.size(old) > 0) & (F.size(new) > 0), keys).otherwise(F.array().cast("array<string>"))


def event_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON text of the fields, sorted by name; a null field is left out, which no other value is written as."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def replay_workflow(log: DataFrame, start: str = "draft") -> DataFrame:
    """G1: of each record's events (record, seq, action, role), applied in order: the last state, how many applied and how many were invalid.

    An event without a rule for the state leaves it as it is. The fold is over one record's own log.
    """
    rules = F.create_map(*[F.lit(x) for s, a, n, roles in TRANSITIONS for r in roles.split(",") for x in (f"{s}|{a}|{r}", n)])
    logs = log.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "role"))).alias("events"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("invalid"))

    def step(acc: Column, x: Column) -> Column:
        new = F.element_at(rules, F.concat_ws("|", acc["state"], x["action"], x["role"]))
        return F.struct(F.coalesce(new, acc["state"]).alias("state"), (acc["applied"] + new.isNotNull().cast("int")).alias("applied"), (acc["invalid"] + new.isNull().cast("int")).alias("invalid"))

    return logs.select("record", F.aggregate("events", zero, step).alias("x")).select("record", "x.state", "x.applied", "x.invalid")


def replay_timed(log: DataFrame, as_of: Column, start: str = "draft") -> DataFrame:
    """G1 with time: of each record's events (record, seq, action, role, ts), the state at as_of, since when, and how many moves
    were made (applied), refused (invalid) and due to time (timed).

    A state of AUTO_LIMITS that lasts longer than its minutes becomes `escalated` at that moment, before a later
    event is looked at. Events are ordered by (ts, seq); the fold is over one record's own log.
    """
    rules = F.create_map(*[F.lit(x) for s, a, n, roles in TRANSITIONS for r in roles.split(",") for x in (f"{s}|{a}|{r}", n)])
    limits = F.create_map(*[F.lit(x) for s, m in AUTO_LIMITS.items() for x in (s, m * 60_000_000)])
    events = F.struct(F.unix_micros("ts").alias("at"), "seq", "action", "role")
    logs = log.groupBy("record").agg(F.array_sort(F.collect_list(events)).alias("events"))
    fields = lambda state, since, applied, invalid, timed: F.struct(state.alias("state"), since.alias("since"), applied.alias("applied"), invalid.alias("invalid"), timed.alias("timed"))

    def until(acc: Column, now: Column) -> Column:
        due = acc["since"] + F.element_at(limits, acc["state"])
        late = F.coalesce(due < now, F.lit(False))
        return fields(F.when(late, "escalated").otherwise(acc["state"]), F.when(late, due).otherwise(acc["since"]), acc["applied"], acc["invalid"], acc["timed"] + late.cast("int"))

    def step(acc: Column, x: Column) -> Column:
        def move(now: Column) -> Column:
            new = F.element_at(rules, F.concat_ws("|", now["state"], x["action"], x["role"]))
            return fields(F.coalesce(new, now["state"]), F.when(new.isNotNull(), x["at"]).otherwise(now["since"]), now["applied"] + new.isNotNull().cast("int"), now["invalid"] + new.isNull().cast("int"), now["timed"])

        return F.element_at(F.transform(F.array(until(acc, x["at"])), move), 1)

    zero = fields(F.lit(start), F.col("events")[0]["at"], F.lit(0), F.lit(0), F.lit(0))
    done = logs.select("record", F.aggregate("events", zero, step, lambda acc: until(acc, F.unix_micros(as_of))).alias("x"))
    return done.select("record", "x.state", F.timestamp_micros("x.since").alias("since"), "x.applied", "x.invalid", "x.timed")


def legacy_state(status: Column) -> Column:
    """G1: the workflow state that a record's old status stands for."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv]), status), status)


def available_actions(rows: DataFrame) -> DataFrame:
    """Rows (state, role, ...) with the sorted actions that the role may take."""
    rules = transition_table(rows).groupBy("state", "role").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    return rows.join(F.broadcast(rules), ["state", "role"], "left").withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))


def transition_conditions(justification: Column, amount: Column, attachments: Column) -> dict[str, Column]:
    """Whether each condition of a transition holds."""
    return {"has_justification": F.coalesce(justification != "", F.lit(False)), "high_value": ~F.coalesce(F.abs(amount) > 10_000, F.lit(False)), "requires_attachment": F.coalesce(attachments > 0, F.lit(False))}


def notifications(moves: DataFrame) -> DataFrame:
    """For each move (record, action, next_state) who is told, by which template, how urgently; none for other states."""
    rules = F.broadcast(moves.sparkSession.createDataFrame(NOTICES, "next_state string, recipient_role string, template string"))
    return moves.join(rules, "next_state").withColumn("priority", F.when(F.col("next_state").isin("escalated", "rejected"), "high").otherwise("normal"))


def workflow_history(log: DataFrame) -> DataFrame:
    """Each record's valid moves, newest first by `place`, with the state before and after."""
    w = Window.partitionBy("record").orderBy(F.col("seq").desc())
    moves = transition_lookup(log).filter("next_state <> 'invalid'")
    return moves.withColumn("place", F.row_number().over(w))


def escalation_rules(df: DataFrame, custom: DataFrame | None = None, inactive: tuple[str, ...] = ()) -> DataFrame:
    """J17's rules as rows, those of `custom` among them (U2), less the inactive ones."""
    schema = "rule string, trigger string, when_state string, hours double, least_amount double, largest_score double, level int, target_role string"
    rules = df.sparkSession.createDataFrame(ESCALATIONS, schema)
    rules = rules if custom is None else rules.unionByName(custom)
    return rules.filter(~F.col("rule").isin(*inactive)) if inactive else rules


def escalate(items: DataFrame, as_of: str, rules: DataFrame | None = None, strict_reference: bool = False) -> DataFrame:
    """Each open item (id, state, since, amount, match_score) and each rule that it meets, with from_level, level, severity and reason.

    Columns compliance_issue and rejections make the last two rules, level the item's own before (0 where there is none). A
    rule's declared state must hold too. With strict_reference rules are read as the reference runs them: timeouts in
    any state, the critical value, compliance and rejections never. Rules are a dozen rows, and each item is held against an
    array of them, so no item meets another and nothing is shuffled.
    """
    rules = escalation_rules(items) if rules is None else rules
    held = rules.limit(MOST_RULES + 1).collect()
    if len(held) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("since")) / 3600
    amount = F.abs(F.col("amount").cast("double"))
    at = lambda cond: F.coalesce(cond, F.lit(False))
    hit = (
        at((F.col("trigger") == "timeout") & (hours >= F.col("hours"))) | at((F.col("trigger") == "threshold_exceeded") & (amount >= F.col("least_amount")))
        | at((F.col("trigger") == "risk_threshold") & (F.col("match_score") <= F.col("largest_score")))
    )
    if strict_reference:
        hit = hit & (F.col("rule") != "critical_value_transaction")
    else:
        has = lambda c, of: of(F.col(c)) if c in items.columns else F.lit(False)
        hit = hit | at((F.col("trigger") == "compliance_violation") & has("compliance_issue", lambda x: x)) | at((F.col("trigger") == "rejection_threshold") & has("rejections", lambda x: x >= REJECTIONS))
        hit = hit & (F.col("when_state").isNull() | (F.col("when_state") == F.col("state")))
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    reason = (
        F.when(F.col("trigger") == "timeout", F.format_string("Item has been pending for %.1f hours", hours)).when(F.col("trigger") == "threshold_exceeded", F.format_string("Transaction amount %.2f exceeds threshold", amount))
        .when(F.col("trigger") == "compliance_violation", "Compliance violation detected").when(F.col("trigger") == "rejection_threshold", "Multiple rejections detected")
        .otherwise(F.format_string("Low match score %.2f indicates high risk", F.col("match_score").cast("double")))
    )
    was = F.coalesce(F.col("level"), F.lit(0)) if "level" in items.columns else F.lit(0)
    listed = F.array(*[F.struct(*[F.lit(r[c]).cast(rules.schema[c].dataType).alias(c) for c in rules.columns]) for r in held])
    if not held:
        listed = F.array().cast(f"array<struct<{', '.join(f'{c}: {t}' for c, t in rules.dtypes)}>>")
    met = items.withColumn("from_level", was).drop("level").withColumn("_rule", F.explode(listed)).select("*", "_rule.*").filter(hit)
    return met.select("id", "rule", "trigger", "from_level", "level", F.element_at(level, F.col("level")).alias("severity"), "target_role", reason.alias("reason"))


def compliance_rules(log: DataFrame, as_of: str) -> DataFrame:
    """G8 over an audit log (record, action, user_id, amount, ts): per record whether creator and approver differ below the amount limit,
    whether large amounts have two approvals, and whether what is unapproved is younger than 48 hours."""
    approvers = F.collect_set(F.when(F.col("action") == "approve", F.col("user_id")))
    creators = F.collect_set(F.when(F.col("action") == "create", F.col("user_id")))
    g = log.groupBy("record").agg(approvers.alias("approvers"), creators.alias("creators"), F.max(F.abs(F.col("amount").cast("double"))).alias("amount"), F.min("ts").alias("first_ts"))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("first_ts")) / 3600
    return g.select(
        "record", (F.size(F.array_intersect("approvers", "creators")) == 0).alias("separated"), (~(F.col("amount") > 50_000) | (F.size("approvers") >= 2)).alias("two_approvals"), ((F.size("approvers") > 0) | (age < 48)).alias("in_time"),
    )


def audit_rows(events: DataFrame) -> DataFrame:
    """Events (event_type, user_id, resource_type, resource_id, action, ts, old_values, new_values as maps) that have the required
    fields, with masked values, the changed fields and the hash of the masked event."""
    rows = events.filter("event_type is not null and user_id is not null and resource_type is not null and resource_id is not null and action is not null")
    rows = rows.withColumns({"changed": changed_fields(F.col("old_values"), F.col("new_values")), "old_values": mask_sensitive(F.col("old_values")), "new_values": mask_sensitive(F.col("new_values"))})
    fields = ("event_type", "user_id", "resource_type", "resource_id", "action", "ts", "old_values", "new_values")
    return rows.withColumn("event_hash", event_hash(**{f: F.col(f) for f in fields}))


def audit_query(log: DataFrame, user=None, kind=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Events of a user, type and time, newest first."""
    rows = log
    for column, value in (("user_id", user), ("event_type", kind)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp")) if start else rows
    rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp")) if end else rows
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit) if limit else rows


def retained(log: DataFrame, as_of: str) -> DataFrame:
    """Events (class, ts) not older than their class allows; unknown classes are kept."""
    days = F.element_at(F.create_map(*[F.lit(x) for kv in RETENTION.items() for x in kv]), F.col("class"))
    return log.filter(days.isNull() | (F.datediff(F.lit(as_of).cast("timestamp"), "ts") <= days))


def overdue_steps(steps: DataFrame, as_of: str) -> DataFrame:
    """Open steps (workflow, step, started, minutes, done) longer open than their minutes, counted from the workflow's start."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("started")) / 60
    return steps.filter(~F.col("done") & (age > F.col("minutes"))).withColumn("late_minutes", F.floor(age - F.col("minutes")))


def workflow_report(steps: DataFrame) -> DataFrame:
    """Per workflow the steps, those done, the open ones by name, and whether all required ones are done."""
    return steps.groupBy("workflow").agg(
        F.count("*").alias("steps"), F.count(F.when(F.col("done"), 1)).alias("done"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("done"), F.col("step")))), ",").alias("open"), F.bool_and(F.col("done") | ~F.col("required")).alias("complete"),
    )
