"""Queries of the streams, over the events files as a stream, with the same result as SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import workflow
from ledgerloom.plans import adapters
from ledgerloom.plans.registry import _RULES, AS_OF, SQL, Views, reg
from ledgerloom.streaming import jobs
from ledgerloom.streaming.workflow import stateful_workflow

ACTIONS = ["submit_for_review", "approve_review", "approve_final", "reconcile", "complete", "cancel"]
ROLES = ["operator", "reviewer", "approver", "operator", "admin", "reviewer"]


def timed_log(e: DataFrame) -> DataFrame:
    """Six events a record, an hour to 81 hours apart, some with the wrong action or role."""
    i, record, seq = F.col("event_id"), F.floor(F.col("event_id") / 6), F.col("event_id") % 6
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(record % 20, seq * (record % 5 * 20 + 1))
    return e.select(record.alias("record"), seq.alias("seq"), adapters.pick(ACTIONS, (seq + F.when(record % 4 == 1, 1).otherwise(0)) % 6).alias("action"), adapters.pick(ROLES, (seq + F.when(record % 4 == 2, 1).otherwise(0)) % 6).alias("role"), ts.alias("ts"))


_LOG = f"""l AS (SELECT event_id // 6 AS record, event_id % 6 AS seq, {adapters._list(ACTIONS)}[CAST((event_id % 6 + CASE WHEN (event_id // 6) % 4 = 1 THEN 1 ELSE 0 END) % 6 + 1 AS INT)] AS action,
    {adapters._list(ROLES)}[CAST((event_id % 6 + CASE WHEN (event_id // 6) % 4 = 2 THEN 1 ELSE 0 END) % 6 + 1 AS INT)] AS role, TIMESTAMP '2024-01-01' + to_days(CAST((event_id // 6) % 20 AS INTEGER)) + to_hours((event_id % 6) * ((event_id // 6) % 5 * 20 + 1)) AS ts FROM events)"""


def timed_sql(as_of: str) -> str:
    """The replay as recursion over the events of a record, which are numbered from 0."""
    due = lambda s, t: f"CASE {s} " + " ".join(f"WHEN '{k}' THEN {t} + INTERVAL {m} MINUTE" for k, m in workflow.AUTO_LIMITS.items()) + " END"
    return f"""WITH RECURSIVE {_LOG}, t AS (SELECT * FROM {_RULES}), walk AS (
      SELECT record, -1 AS seq, 'draft' AS state, min(ts) AS since, 0 AS applied, 0 AS invalid, 0 AS timed FROM l GROUP BY 1 UNION ALL
      SELECT w.record, w.seq + 1, coalesce(t.next_state, w.state), CASE WHEN t.next_state IS NOT NULL THEN w.ts ELSE w.since END, w.applied + (w.action IS NOT NULL AND t.next_state IS NOT NULL)::INT, w.invalid + (w.action IS NOT NULL AND t.next_state IS NULL)::INT, w.timed
      FROM (SELECT record, seq, CASE WHEN due < ts THEN 'escalated' ELSE state END AS state, CASE WHEN due < ts THEN due ELSE since END AS since, applied, invalid, timed + coalesce(due < ts, false)::INT AS timed, action, role, ts
        FROM (SELECT walk.*, l.action, l.role, l.ts, {due('walk.state', 'walk.since')} AS due FROM walk LEFT JOIN l ON l.record = walk.record AND l.seq = walk.seq + 1)) w
      LEFT JOIN t ON t.state = w.state AND t.action = w.action AND t.role = w.role WHERE w.seq < 5)
    SELECT record, CASE WHEN due < z THEN 'escalated' ELSE state END AS state, CAST(CASE WHEN due < z THEN due ELSE since END AS VARCHAR) AS since, applied, invalid, timed + coalesce(due < z, false)::INT AS timed
    FROM (SELECT *, {due('state', 'since')} AS due, {as_of} AS z FROM walk WHERE seq = 5)"""


_shown = lambda df: df.withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))
reg("G1_timed_transitions", lambda v: _shown(workflow.replay_timed(timed_log(v.table("events")), F.lit(AS_OF).cast("timestamp"))))
reg("T6_stateful_workflow", lambda v: _shown(stateful_workflow(timed_log(jobs.events_stream(v.spark, v.dir)), v.scratch())))
SQL["G1_timed_transitions"] = timed_sql(f"TIMESTAMP '{AS_OF}'")
SQL["T6_stateful_workflow"] = timed_sql("(SELECT max(ts) - INTERVAL 1 HOUR FROM l)")


def _ingested(v: Views) -> DataFrame:
    uploads = adapters.bank_rows(jobs.events_stream(v.spark, v.dir))
    found = jobs.stream_ingest(uploads, v.ledger(), v.scratch())
    return found.groupBy("rank").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_CLEAN = """CASE WHEN description = '' THEN 'Transação sem descrição' ELSE regexp_replace(trim(regexp_replace(description, '\\s+', ' ', 'g')), '^(TED|DOC|PIX|TRANSF|SAQUE|DEPOSITO|COMPRA)\\b(\\s*[-:]\\s*)?', '', 'i') END"""
_M20 = SQL["M20_find_matches"].replace("FROM bank_tx WHERE", f"FROM (SELECT * REPLACE ({_CLEAN} AS description) FROM bank_tx) WHERE")
reg("T1_stream_ingest", _ingested)
SQL["T1_stream_ingest"] = f"SELECT rank, count(*) AS n, round(sum(score), 4) AS total FROM ({_M20}) GROUP BY 1"


def _alive(v: Views) -> DataFrame:
    events = jobs.events_stream(v.spark, v.dir).withColumn("expires_at", F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.make_dt_interval(F.col("event_id") % 30)))
    fresh, counts = jobs.late_and_expired(events, v.scratch(), AS_OF)
    return fresh.groupBy("event_type").agg(F.count("*").alias("n")).withColumns({"expired": F.lit(counts["expired"]).cast("long"), "late": F.lit(counts["late"]).cast("long")})


reg("T7_late_and_expired", _alive, f"""WITH e AS (SELECT *, coalesce(CASE WHEN event_id % 3 > 0 THEN ts + to_days(CAST(event_id % 30 AS INTEGER)) END <= TIMESTAMP '{AS_OF}', false) AS expired FROM events)
    SELECT event_type, count(*) AS n, (SELECT count(*) FROM e WHERE expired) AS expired, 0::BIGINT AS late FROM e WHERE NOT expired GROUP BY 1""")


def _routed(v: Views) -> DataFrame:
    """Each type's rows to a table of its own; `signup` has no handler."""
    path, kinds = v.scratch(), ["click", "purchase", "error", "view"]
    jobs.Router({k: jobs.routed_copy(f"{path}/{k}") for k in kinds}, path).run(jobs.events_stream(v.spark, v.dir))
    schema = v.table("events").schema
    read = [v.spark.read.schema(schema).parquet(f"{path}/{k}/batch=*").select("event_id", F.lit(k).alias("routed_to")) for k in kinds if jobs._made(v.spark, f"{path}/{k}")]
    out = read[0] if read else v.spark.createDataFrame([], "event_id long, routed_to string")
    for more in read[1:]:
        out = out.union(more)
    return out


reg("T8_route_events", _routed, "SELECT event_id, event_type AS routed_to FROM events WHERE event_type IN ('click', 'purchase', 'error', 'view')")


def _retried(v: Views) -> DataFrame:
    """Rows of `purchase` fail as often as their id says; all of `error` fail always."""
    def broken(rows: DataFrame, batch_id: int) -> DataFrame:
        raise RuntimeError("down")

    dead, attempts = jobs.Router({"purchase": lambda rows, batch_id: rows.filter(F.col("retry_count") < F.col("event_id") % 5), "error": broken}, v.scratch()).run(jobs.events_stream(v.spark, v.dir))
    letters = dead.groupBy("event_type").agg(F.count("*").alias("dead"), F.max("retry_count").alias("retries"), F.max("error").alias("error"))
    tried = attempts.groupBy("event_type").agg(F.count("*").alias("attempts"), F.sum("given").alias("given"))
    return tried.join(letters, "event_type", "left")


reg("T9_retry_dead_letter", _retried, """SELECT event_type, 3::BIGINT AS attempts, CASE event_type WHEN 'error' THEN 3 * count(*) ELSE count(*) + count(*) FILTER (event_id % 5 >= 1) + count(*) FILTER (event_id % 5 >= 2) END::BIGINT AS given,
    CASE event_type WHEN 'error' THEN count(*) ELSE count(*) FILTER (event_id % 5 >= 3) END AS dead, 3 AS retries, CASE event_type WHEN 'error' THEN 'RuntimeError: down' ELSE 'rows failed' END AS error FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
