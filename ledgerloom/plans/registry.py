"""Queries over the given tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import coerce as C
from ledgerloom.functions import text as T
from ledgerloom.operators import joins, matching, quality, reports, windows, workflow
from ledgerloom.plans import adapters
from ledgerloom.plans.adapters import FOLD, VIEWS
from ledgerloom.sources import ofx
from ledgerloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The time of reference of the reports: reports never ask the clock.
AS_OF = "2024-01-31 00:00:00"


class Views:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def scratch(self) -> str:
        """A fresh folder in the shared one that spark.checkpoint.dir names; local only where that is unset, as in tests."""
        return f"{self.spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid.uuid4().hex}"

    def bank(self) -> DataFrame:
        return adapters.bank_tx(self.spark, self.dir)

    def ledger(self) -> DataFrame:
        return adapters.ledger(self.spark, self.dir)

    def recon(self) -> DataFrame:
        return adapters.recon(self.spark, self.dir)


def reg(name: str, build: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    if sql is not None:
        SQL[name] = (VIEWS + sql) if "bank_tx" in sql or "ledger" in sql or "recon" in sql else sql


def money(expr: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS DOUBLE)"


POS, NEG = money("sum(CASE WHEN amount > 0 THEN amount END)"), "abs(" + money("sum(CASE WHEN amount < 0 THEN amount END)") + ")"
NET = money("sum(amount)")
LABEL = """CASE lower(category) WHEN 'folha_pagamento' THEN 'Folha de Pagamento' WHEN 'tarifas_bancarias' THEN 'Tarifas Bancarias' WHEN 'assinaturas_saas' THEN 'Assinaturas SaaS' WHEN 'ti' THEN 'TI'
 ELSE array_to_string(list_transform(string_split(translate(category, '_-', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"""

# Reports
reg("A1_overview", lambda v: reports.overview(v.bank()), f"SELECT count(*) AS n, {POS} AS income, {NEG} AS expenses, {NET} AS net FROM bank_tx")
reg("A2_by_bank", lambda v: reports.by_bank(v.bank()), "SELECT bank_name, count(*) AS n FROM bank_tx GROUP BY 1")
reg("A2_by_category", lambda v: reports.by_category(v.bank()), f"SELECT category, count(*) AS n, {NET} AS total, {LABEL.replace('Juros/multa', 'Juros/Multa')} AS label FROM bank_tx GROUP BY 1")
reg("A3_ledger_summary", lambda v: reports.ledger_summary(v.ledger(), "2024-02-01", "2024-12-31"),
    f"""SELECT category, count(*) AS n, {money("sum(CASE WHEN transaction_type = 'income' THEN amount END)")} AS income, abs({money("sum(CASE WHEN transaction_type = 'expense' THEN amount END)")}) AS expenses, {NET} AS net
    FROM ledger WHERE date BETWEEN DATE '2024-02-01' AND DATE '2024-12-31' GROUP BY 1""")
reg("A4_insight_summary", lambda v: reports.insight_summary(v.bank()), "SELECT count(*) AS n, round(avg(abs(CAST(amount AS DOUBLE))), 6) AS mean_abs, CAST(min(amount) AS DOUBLE) AS largest_expense, CAST(max(amount) AS DOUBLE) AS largest_income FROM bank_tx")
reg("A5_category_share", lambda v: reports.category_share(v.bank()), f"SELECT category, n, expenses, round(100 * expenses / sum(expenses) OVER (), 1) AS share FROM (SELECT category, count(*) AS n, {NEG} AS expenses FROM bank_tx GROUP BY 1)")
reg("A6_weekday_spending", lambda v: reports.weekday_spending(v.bank()), f"SELECT CAST(d AS INTEGER) AS weekday, coalesce(spent, 0.0) AS spent FROM range(7) r(d) LEFT JOIN (SELECT isodow(date) - 1 AS w, {NEG} AS spent FROM bank_tx GROUP BY 1) ON w = d")
reg("A7_peak_day", lambda v: reports.peak_day(v.bank()), "SELECT CAST(day(date) AS INTEGER) AS day, CAST(-sum(amount) AS DOUBLE) AS spent FROM bank_tx WHERE amount < 0 GROUP BY 1 ORDER BY sum(amount), 1 LIMIT 1")
reg("A10_recon_report", lambda v: reports.recon_report(v.recon()), """SELECT n, pending, confirmed, rejected, round(confirmed / n, 4) AS rate, round(s / confirmed, 4) AS mean_score FROM (SELECT count(*) AS n, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected, sum(match_score) FILTER (status = 'confirmed') AS s FROM recon)""")
reg("A11_reconciled_value", lambda v: reports.reconciled_value(v.recon(), v.bank()), f"SELECT {money('sum(abs(amount))')} AS absolute, {POS} AS credits, {NEG} AS debits, {NET} AS net FROM recon r JOIN bank_tx b ON r.bank_transaction_id = b.id WHERE status = 'confirmed'")
reg("A12_recent_activity", lambda v: reports.recent_activity(v.recon(), AS_OF), f"SELECT count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected FROM recon WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
reg("A14_anomaly_stats_by_reviewer", lambda v: reports.anomaly_stats_by_reviewer(v.recon()), """SELECT anomaly_reviewed_by, count(*) AS handled, count(*) FILTER (anomaly_action = 'confirmed') AS confirmed, count(*) FILTER (anomaly_action = 'dismissed') AS dismissed,
    round(avg((epoch(anomaly_reviewed_at) - epoch(anomaly_detected_at)) / 3600), 4) AS mean_hours FROM recon WHERE anomaly_reviewed_by IS NOT NULL GROUP BY 1""")
reg("A15_anomaly_trend", lambda v: reports.anomaly_trend(v.recon()), "SELECT CAST(CAST(anomaly_detected_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM recon WHERE is_anomaly GROUP BY 1")
reg("A16_reviewer_performance", lambda v: reports.reviewer_performance(v.recon()), "SELECT anomaly_reviewed_by, count(*) AS handled, round(count(*) FILTER (anomaly_action = 'confirmed') / count(*), 4) AS confirmation_rate, round(count(*) FILTER (anomaly_action = 'dismissed') / count(*), 4) AS dismissal_rate FROM recon WHERE anomaly_reviewed_by IS NOT NULL GROUP BY 1")
reg("A23_retention_counts", lambda v: reports.retention_counts({"bank_tx": (v.bank(), "ts"), "recon": (v.recon(), "created_at")}, AS_OF, 20),
    f"SELECT 'bank_tx' AS table_name, count(*) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS old, count(*) AS n FROM bank_tx UNION ALL SELECT 'recon', count(*) FILTER (created_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY), count(*) FROM recon")
reg("A24_category_transitions", lambda v: reports.category_transitions(v.bank().withColumn("new", T.category_by_sign(F.col("amount"), F.col("category"), F.col("description"))), F.col("category"), F.col("new")))
reg("A25_column_profile", lambda v: reports.column_profile(v.recon(), ["status", "anomaly_type", "anomaly_action"]), "SELECT unnest(['status','anomaly_type','anomaly_action']) AS column_name, n, unnest([n - a, n - b, n - c]) AS missing FROM (SELECT count(*) AS n, count(status) AS a, count(anomaly_type) AS b, count(anomaly_action) AS c FROM recon)")
MONTHS = f"""SELECT strftime(m, '%Y-%m') AS month, coalesce(income, 0.0) AS income, coalesce(expense, 0.0) AS expense FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(date)) FROM bank_tx), (SELECT date_trunc('month', max(date)) FROM bank_tx), INTERVAL 1 MONTH)) AS m)
    LEFT JOIN (SELECT date_trunc('month', date) AS m2, {POS} AS income, {NEG} AS expense FROM bank_tx GROUP BY 1) ON m = m2"""
reg("A26_monthly_series", lambda v: reports.monthly_series(v.bank()), MONTHS)
reg("A27_monthly_statement", lambda v: reports.monthly_statement(v.bank()), f"SELECT strftime(date, '%Y-%m') AS month, category, {POS} AS income, {NEG} AS expenses, {NET} AS net FROM bank_tx GROUP BY 1, 2")
reg("L8_trim_history", lambda v: reports.trim_history(v.bank()).select("id"), "SELECT id FROM bank_tx, (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.01) AS a, quantile_cont(CAST(amount AS DOUBLE), 0.99) AS b FROM bank_tx) WHERE CAST(amount AS DOUBLE) BETWEEN a AND b")

# Joins and sets
reg("J4_known_transaction", lambda v: joins.known_rows(v.bank(), v.bank().filter("id % 5 = 0"), ["account_id", "date", "amount", "description"]).select("id"),
    "SELECT id FROM bank_tx b WHERE EXISTS (SELECT 1 FROM bank_tx s WHERE s.id % 5 = 0 AND s.account_id = b.account_id AND s.date = b.date AND s.amount = b.amount AND s.description = b.description)")
reg("J5_known_ledger_entry", lambda v: joins.known_rows(v.ledger(), v.ledger().filter("id % 2 = 0"), ["date", "amount", "description"]).select("id"),
    "SELECT id FROM ledger b WHERE EXISTS (SELECT 1 FROM ledger s WHERE s.id % 2 = 0 AND s.date = b.date AND s.amount = b.amount AND s.description = b.description)")
reg("J7_duplicate_groups", lambda v: joins.duplicate_groups(v.bank(), ["date", "description", "transaction_type"]).withColumn("date", F.col("date").cast("string")),
    "SELECT CAST(date AS VARCHAR) AS date, description, transaction_type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM bank_tx GROUP BY date, description, transaction_type HAVING count(*) > 1")
reg("J8_reconciled_flag", lambda v: joins.reconciled_flag(v.bank(), v.recon(), "bank_transaction_id").select("id", "is_reconciled"), "SELECT id, EXISTS (SELECT 1 FROM recon r WHERE r.bank_transaction_id = b.id AND status = 'confirmed') AS is_reconciled FROM bank_tx b")
reg("J9_unmatched_entries", lambda v: joins.unmatched_entries(v.ledger(), v.recon()).select("id", "description"), "SELECT id, description FROM ledger WHERE id NOT IN (SELECT company_entry_id FROM recon WHERE status IN ('pending', 'confirmed'))")
reg("J10_enrich_records", lambda v: joins.enrich_records(v.recon(), v.bank(), v.ledger()).select("id", F.col("bank_amount").cast("double").alias("bank_amount"), F.col("entry_amount").cast("double").alias("entry_amount"), "bank_description", "entry_description"),
    "SELECT r.id, CAST(b.amount AS DOUBLE) AS bank_amount, CAST(e.amount AS DOUBLE) AS entry_amount, b.description AS bank_description, e.description AS entry_description FROM recon r LEFT JOIN bank_tx b ON b.id = bank_transaction_id LEFT JOIN ledger e ON e.id = company_entry_id")
reg("J11_duplicate_match_join", lambda v: joins.duplicate_match_join(v.recon(), v.bank()), """, o AS (SELECT r.id, bank_transaction_id AS bt, company_entry_id AS ce, amount, date FROM recon r JOIN bank_tx b ON b.id = r.bank_transaction_id WHERE status IN ('pending','confirmed'))
    SELECT a.id, count(*) AS n, CAST(min(abs(a.date - b.date)) AS INTEGER) AS nearest_days FROM o a JOIN o b ON a.amount = b.amount AND abs(a.date - b.date) <= 7 AND a.bt <> b.bt AND a.ce <> b.ce GROUP BY 1""")
SQL["J11_duplicate_match_join"] = VIEWS.rstrip() + SQL["J11_duplicate_match_join"][len(VIEWS):]
reg("J15_cascade_delete", lambda v: joins.cascade_delete(v.bank(), v.recon(), v.bank().filter("amount < -50").select("id")), "SELECT (SELECT count(*) FROM bank_tx WHERE NOT amount < -50) AS tx_left, (SELECT count(*) FROM recon WHERE bank_transaction_id NOT IN (SELECT id FROM bank_tx WHERE amount < -50)) AS records_left")
reg("E1_union_by_name", lambda v: joins.union_by_name([v.bank().select("id", "description", "bank_name"), v.ledger().select("id", "description", "cost_center")]), "SELECT id, description, bank_name, NULL AS cost_center FROM bank_tx UNION ALL SELECT id, description, NULL, cost_center FROM ledger")
reg("F14_apply_patches", lambda v: joins.apply_patches(v.ledger().select("id", "department", "transaction_type"), v.recon().select(F.col("company_entry_id").alias("id"), F.col("id").alias("seq"), F.concat(F.lit(" N"), (F.col("id") % 3).cast("string")).alias("department"), F.when(F.col("id") % 4 == 0, "income").otherwise("bad").alias("transaction_type")), ["department", "transaction_type"], {"transaction_type": ["income", "expense"]}),
    "SELECT l.id, coalesce('N' || p.seq % 3, department) AS department, CASE WHEN p.seq % 4 = 0 THEN 'income' ELSE transaction_type END AS transaction_type FROM ledger l LEFT JOIN (SELECT company_entry_id AS id, max(id) AS seq FROM recon GROUP BY 1) p ON p.id = l.id")
reg("S15_add_missing_columns", lambda v: joins.add_missing_columns(v.bank().select("id", "amount"), {"amount": ("string", "x"), "justificativa": ("string", "")}).select("id", "justificativa"), "SELECT id, '' AS justificativa FROM bank_tx")

# Search, validation, scans
reg("F1_search_transactions", lambda v: quality.search_transactions(v.bank(), kind="debit", start="2024-02-01", end="2024-10-31", text="boleto").select("id", "description"), "SELECT id, description FROM bank_tx WHERE transaction_type = 'debit' AND date BETWEEN DATE '2024-02-01' AND DATE '2024-10-31' AND (contains(lower(description), 'boleto') OR contains(lower(category), 'boleto'))")
reg("F4_paginate", lambda v: quality.paginate(v.bank(), 3, 50).select("id"), "SELECT id FROM bank_tx ORDER BY date DESC, id LIMIT 50 OFFSET 100")
reg("F5_matchable_rows", lambda v: matching.matchable(v.bank()).select("id"), "SELECT id FROM bank_tx WHERE abs(amount) >= 0.01 AND trim(description) <> ''")
reg("F11_split_incomplete", lambda v: quality.import_status(v.bank(), v.bank().filter("id % 5 = 0")).groupBy("status").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN trim(description) = '' THEN 'incomplete' WHEN EXISTS (SELECT 1 FROM bank_tx s WHERE s.id % 5 = 0 AND s.date = b.date AND s.amount = b.amount AND s.description = b.description) THEN 'duplicate' ELSE 'imported' END AS status, count(*) AS n FROM bank_tx b GROUP BY 1")
reg("F18_sanitize_text", lambda v: v.table("pages").select("page_id", F.md5(quality.sanitize_text(F.col("html"))).alias("clean")), """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS clean FROM pages""")
# Text and coercion
reg("X1_fold_text", lambda v: v.bank().select("id", T.fold_text(F.col("description")).alias("folded")), f"SELECT id, {FOLD.format('description')} AS folded FROM bank_tx")
NOISE_SQL = "[" + ", ".join(f"'{w}'" for w in T.NOISE) + "]"
STANDARD = f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace({FOLD.format('description')}, '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) BETWEEN 2 AND 50 AND NOT list_contains({NOISE_SQL}, w)), ' ')"
reg("X3_normalize_standard", lambda v: v.bank().select("id", T.normalize_standard(F.col("description")).alias("norm")), f"SELECT id, {STANDARD} AS norm FROM bank_tx")
reg("X6_extract_entities", lambda v: v.bank().select("id", *[F.array_join(T.entity_list(F.col("description"), k), "|").alias(k) for k in T.ENTITIES]),
    "SELECT id, " + ", ".join(f"array_to_string(list_sort(list_distinct(regexp_extract_all({FOLD.format('description')}, '{p}'))), '|') AS {k}" for k, p in T.ENTITIES.items()) + " FROM bank_tx")
AMOUNTS = "SELECT id, CASE id % 4 WHEN 0 THEN 'R$ ' || replace(CAST(amount AS VARCHAR), '.', ',') WHEN 1 THEN CAST(amount AS VARCHAR) WHEN 2 THEN '1.' || replace(CAST(abs(amount) AS VARCHAR), '.', ',') ELSE '(' || CAST(abs(amount) AS VARCHAR) || ')' END AS t FROM bank_tx"


def _amount_texts(v: Views) -> DataFrame:
    a = F.col("amount").cast("string")
    plain = F.abs("amount").cast("string")
    i = F.col("id") % 4
    return v.bank().select("id", F.when(i == 0, F.concat(F.lit("R$ "), F.translate(a, ".", ","))).when(i == 1, a).when(i == 2, F.concat(F.lit("1."), F.translate(plain, ".", ","))).otherwise(F.concat(F.lit("("), plain, F.lit(")"))).alias("t"))


reg("X9_parse_amount_text", lambda v: _amount_texts(v).select("id", C.parse_amount_text(F.col("t")).alias("value")), f"SELECT id, CASE WHEN id % 4 = 2 THEN CAST(replace(replace(t, '.', ''), ',', '.') AS DOUBLE) ELSE CAST(regexp_replace(replace(t, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE) END AS value FROM ({AMOUNTS})")
reg("X11_coerce_amount", lambda v: _amount_texts(v).select("id", C.coerce_amount(F.col("t")).alias("value")), f"SELECT id, CASE WHEN id % 4 = 2 THEN CAST(replace(replace(t, '.', ''), ',', '.') AS DOUBLE) WHEN id % 4 = 3 THEN -CAST(regexp_replace(t, '[()]', '', 'g') AS DOUBLE) ELSE CAST(replace(replace(t, 'R$ ', ''), ',', '.') AS DOUBLE) END AS value FROM ({AMOUNTS})")
reg("X19_categorize", lambda v: v.bank().groupBy("description", "category").agg(F.count("*").alias("n")), "SELECT description, category, count(*) AS n FROM bank_tx GROUP BY 1, 2")
_over = " ".join("WHEN " + " OR ".join(f"contains(f, '{w}')" for w in words.split("|")) + f" THEN '{k}'" for k, words in T.OVERRIDES.items())
reg("X20_rule_override", lambda v: v.bank().select("id", T.rule_override(F.col("description")).alias("rule")), f"SELECT id, CASE {_over} END AS rule FROM (SELECT id, {FOLD.format('description')} AS f FROM bank_tx)")
_in, _ex = (", ".join(f"'{x}'" for x in xs) for xs in (T.INCOME, T.EXPENSE))
reg("X22_category_by_sign", lambda v: v.bank().select("id", T.category_by_sign(F.col("amount"), F.col("category"), F.col("description")).alias("adjusted")), f"""SELECT id, CASE WHEN amount < 0 AND lower(category) IN ({_in}) THEN CASE WHEN back IN ({_in}) THEN 'outros' ELSE back END
    WHEN amount > 0 AND lower(category) IN ({_ex}) THEN CASE WHEN lower(back) IN ({_ex}) THEN 'receitas' ELSE back END ELSE category END AS adjusted FROM (SELECT id, amount, category, coalesce(CASE {_over} END, category) AS back FROM (SELECT *, {FOLD.format('description')} AS f FROM bank_tx))""")
reg("X25_default_category", lambda v: v.bank().select("id", T.default_category(F.when(F.col("id") % 3 == 0, F.lit(" NaN ")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "category"))).alias("c")), "SELECT id, CASE WHEN id % 3 < 2 THEN 'Nao categorizado' ELSE category END AS c FROM bank_tx")
reg("X29_changed_fields", lambda v: v.table("events").select("event_id", F.array_join(workflow.changed_fields(F.create_map(F.lit("a"), (F.col("event_id") % 2).cast("string"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), F.lit("0"), F.lit("c"), F.lit("y"))), ",").alias("changed")), "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'a,b,c' ELSE 'b,c' END AS changed FROM events")
reg("M18_simple_similarity", lambda v: v.bank().select("id", F.round(T.simple_similarity(F.col("description"), adapters.pick(adapters.LEDGER_TEXTS, F.col("id") % 12)), 6).alias("s")), f"""SELECT id, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE round(0.6 * len(list_intersect(wx, wy)) / greatest(len(wx), len(wy)), 6) END AS s
    FROM (SELECT id, x, y, list_distinct(string_split(x, ' ')) AS wx, list_distinct(string_split(y, ' ')) AS wy FROM (SELECT id, lower(trim(description)) AS x, lower({adapters._list(adapters.LEDGER_TEXTS)}[CAST(id % 12 + 1 AS INT)]) AS y FROM bank_tx))""")

# Windows
reg("W3_batch_duplicates", lambda v: joins.batch_duplicates(v.bank()), "SELECT * FROM (SELECT id, min(id) OVER (PARTITION BY date, amount, lower(trim(description))) AS first_id FROM bank_tx) WHERE id > first_id")
reg("W6_rate_limit_flags", lambda v: windows.rate_limit_flags(v.table("events"), 2, 600), "SELECT event_id, n, n <= 2 AS allowed, n >= 4 AS blocked FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS n FROM events)")
reg("W7_running_balance", lambda v: windows.running_balance(v.bank()), "SELECT id, account_id, CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY date, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM bank_tx")
reg("W8_frequency_spikes", lambda v: windows.frequency_spikes(v.bank()), "SELECT CAST(date AS VARCHAR) AS date, n, median, isodow(date) >= 6 AS weekend FROM (SELECT date, count(*) AS n FROM bank_tx GROUP BY 1), (SELECT quantile_cont(n, 0.5) AS median FROM (SELECT count(*) AS n FROM bank_tx GROUP BY date)) WHERE n > 1.5 * median")
reg("T3_tumbling_metrics", lambda v: windows.tumbling_metrics(v.table("events")), "SELECT CAST(date_trunc('minute', ts) AS VARCHAR) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
reg("T4_sliding_rate", lambda v: windows.sliding_rate(v.table("events"), 2), "SELECT CAST(time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(5 * k AS BIGINT)) AS VARCHAR) AS start, user_id, count(*) AS n FROM events, range(12) r(k) GROUP BY 1, 2 HAVING count(*) >= 2")
reg("T5_session_activity", lambda v: windows.session_activity(v.table("events")), "SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")

# Matching
_times = lambda xs, t: f"len(list_filter({xs}, lambda z: z = {t}))"
_grams = lambda n: f"list_concat(string_split({n}, ' '), list_transform(range(1, len(string_split({n}, ' '))), lambda i: string_split({n}, ' ')[i] || ' ' || string_split({n}, ' ')[i + 1]))"
_norm2 = lambda own, other: f"list_sum(list_transform(list_distinct({own}), lambda t: {_times(own, 't')} * {_times(own, 't')} * CASE WHEN list_contains({other}, t) THEN 1.0::DOUBLE ELSE pow(1 + ln(1.5), 2) END))"
#: M4 of every two texts that meet.
_SEMANTIC = f"""tp AS (SELECT bn, en, coalesce(list_sum(list_transform(list_intersect(ta, tb), lambda t: {_times('ta', 't')} * {_times('tb', 't')})), 0)::DOUBLE AS dot, {_norm2('ta', 'tb')} AS na, {_norm2('tb', 'ta')} AS nb
  FROM (SELECT bn, en, {_grams('bn')} AS ta, {_grams('en')} AS tb FROM (SELECT DISTINCT bn, en FROM p))),
"""
PREP = f"""SELECT *, string_split(norm, ' ') AS words, {', '.join(f"list_sort(list_distinct(regexp_extract_all({FOLD.format('description')}, '{p}'))) AS {k}" for k, p in T.ENTITIES.items())} FROM (SELECT *, {STANDARD} AS norm FROM {{}} WHERE abs(amount) >= 0.01 AND trim(description) <> '')"""
_jac = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) END"
_any = lambda k: f"(len(b.{k}) > 0 OR len(e.{k}) > 0)"
_KINDS = ("company", "payment_method", "tax")
_ENT = f"coalesce(({' + '.join(f'CASE WHEN {_any(k)} THEN {_jac(f'b.{k}', f'e.{k}')} ELSE 0 END' for k in _KINDS)}) / nullif({' + '.join(f'CAST({_any(k)} AS INT)' for k in _KINDS)}, 0), 0.0)"
_PAIRS = f""", b AS ({PREP.format('bank_tx')}), e AS ({PREP.format('ledger')}), p AS (SELECT b.id AS b_id, e.id AS e_id, abs(abs(b.amount) - abs(e.amount)) AS diff, abs(b.date - e.date) AS days, e.date - b.date AS signed, abs(b.amount) AS ba, abs(e.amount) AS ea, b.description AS bd, e.description AS ed, b.category AS bc, b.norm AS bn, e.norm AS en,
  {_jac('list_distinct(b.words)', 'list_distinct(e.words)')} AS jac, {_ENT} AS ent, CASE WHEN {' + '.join(f'len(list_distinct(b.{k} || e.{k}))' for k in T.ENTITIES)} > 0 THEN ({' + '.join(f'len(list_intersect(b.{k}, e.{k}))' for k in T.ENTITIES)}) / ({' + '.join(f'len(list_distinct(b.{k} || e.{k}))' for k in T.ENTITIES)}) ELSE 0 END AS bonus,
  contains(e.description, b.transaction_id) AS ref FROM b JOIN e ON abs(b.amount) = abs(e.amount) OR b.date = e.date OR (abs(b.date - e.date) <= 3 AND abs(abs(b.amount) - abs(e.amount)) <= 0.02 * abs(b.amount))),
{_SEMANTIC}s AS (SELECT *, CASE WHEN bn <> '' AND en <> '' AND bn <> en AND dot > 0 AND dot / (sqrt(na) * sqrt(nb)) >= 0.7 THEN greatest(plain, dot / (sqrt(na) * sqrt(nb))) ELSE plain END AS sim FROM
  (SELECT *, CASE WHEN bn = '' OR en = '' THEN 0.0::DOUBLE WHEN bn = en THEN 1.0 WHEN contains(bn, en) OR contains(en, bn) THEN 0.95 ELSE least(1.0, 0.7::DOUBLE * jac + 0.3::DOUBLE * ent) END AS plain FROM p) JOIN tp USING (bn, en)),
f AS (SELECT b_id, e_id, diff, days, ba, ea, least(1.0, CASE WHEN diff < 0.01 THEN 0.35 WHEN diff <= 0.02 * ba THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN days = 0 THEN 0.25 WHEN days <= 3 THEN 0.1 ELSE 0 END::DOUBLE + 0.3 * sim + 0.1 * bonus + CASE WHEN ref THEN 0.05 ELSE 0 END::DOUBLE) AS base,
  ((CASE WHEN length(bd) > 5 THEN 0.3 ELSE 0 END + CASE WHEN ba > 0.01 THEN 0.3 ELSE 0 END + 0.4)::DOUBLE + (CASE WHEN length(ed) > 5 THEN 0.3 ELSE 0 END + CASE WHEN ea > 0.01 THEN 0.3 ELSE 0 END + 0.4)::DOUBLE) / 2 AS q, CAST(diff AS DOUBLE) / CAST((ba + ea) / 2 AS DOUBLE) AS share, signed FROM s),
g AS (SELECT b_id, e_id, diff, days, ba, ea, round(0.7 * least(0.95, base) + 0.3 * (0.3 * q + 0.25 * (1.0::DOUBLE - CASE WHEN share > 0.5 THEN 0.4 WHEN share > 0.2 THEN 0.2 WHEN share > 0.1 THEN 0.1 ELSE 0 END - CASE WHEN days > 30 THEN 0.3 WHEN days > 14 THEN 0.2 WHEN days > 7 THEN 0.1 ELSE 0 END)
  + 0.2 * (1.0::DOUBLE - CASE WHEN signed < -7 THEN 0.3 WHEN signed < 0 THEN 0.1 ELSE 0 END - CASE WHEN signed > 30 THEN 0.2 WHEN signed > 14 THEN 0.1 ELSE 0 END)), 6) AS score FROM f)
"""
_RANKED = "SELECT b_id, e_id, CAST(row_number() OVER (PARTITION BY b_id ORDER BY score DESC, e_id) AS INTEGER) AS rank, score, diff, days, ba, ea FROM g WHERE score >= 0.65 QUALIFY rank <= 3"
reg("J1_match_candidates", lambda v: matching.pair_scores(v.bank(), v.ledger()).select("b_id", "e_id", "score"))
SQL["J1_match_candidates"] = VIEWS.rstrip() + _PAIRS + "SELECT b_id, e_id, score FROM g WHERE score >= 0.65"
reg("W2_top_k_per_key", lambda v: matching.best_pairs(v.bank(), v.ledger(), 3).select("b_id", "e_id", "rank", "score"))
SQL["W2_top_k_per_key"] = VIEWS.rstrip() + _PAIRS + f"SELECT b_id, e_id, rank, score FROM ({_RANKED})"
reg("M20_find_matches", lambda v: matching.find_matches(v.bank(), v.ledger()))
SQL["M20_find_matches"] = VIEWS.rstrip() + _PAIRS + f"SELECT b_id, e_id, rank, score, CASE WHEN score >= 0.9 THEN 'auto' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.6 THEN 'review' ELSE 'weak' END AS recommendation FROM ({_RANKED}) WHERE days <= 30 AND diff <= 0.02 * greatest(ba, ea)"
reg("flagship_match_report", lambda v: matching.find_matches(v.bank(), v.ledger()).groupBy("recommendation").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score")))
SQL["flagship_match_report"] = VIEWS.rstrip() + _PAIRS + f"SELECT CASE WHEN score >= 0.9 THEN 'auto' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.6 THEN 'review' ELSE 'weak' END AS recommendation, count(*) AS n, round(avg(score), 4) AS mean_score FROM ({_RANKED}) WHERE days <= 30 AND diff <= 0.02 * greatest(ba, ea) GROUP BY 1"


# Workflow and permissions
STATES, ROLES, ACTIONS = ["draft", "pending_review", "pending_approval", "approved", "on_hold"], ["operator", "reviewer", "approver", "admin", "auditor"], ["submit_for_review", "approve_review", "reject_review", "escalate", "put_on_hold", "resume", "cancel"]


def _log(v: Views) -> DataFrame:
    i = F.col("id")
    return v.bank().select("id", "amount", F.col("ts").alias("since"), adapters.pick(STATES, i % 5).alias("state"), adapters.pick(ROLES, F.floor(i / 5) % 5).alias("role"), adapters.pick(ACTIONS, i % 7).alias("action"))


LOG = f"(SELECT id, amount, ts AS since, {adapters._list(STATES)}[CAST(id % 5 + 1 AS INT)] AS state, {adapters._list(ROLES)}[CAST((id // 5) % 5 + 1 AS INT)] AS role, {adapters._list(ACTIONS)}[CAST(id % 7 + 1 AS INT)] AS action FROM bank_tx)"
_RULES = "(VALUES " + ", ".join(f"('{s}','{a}','{n}','{r}')" for s, a, n, rs in workflow.TRANSITIONS for r in rs.split(",")) + ") t(state, action, next_state, role)"
reg("J16_transition_lookup", lambda v: workflow.transition_lookup(_log(v)).select("id", "next_state"), f"SELECT l.id, coalesce(t.next_state, 'invalid') AS next_state FROM {LOG} l LEFT JOIN {_RULES} ON l.state = t.state AND l.action = t.action AND l.role = t.role")
_LIMIT = "CASE role WHEN 'operator' THEN 5000 WHEN 'reviewer' THEN 25000 WHEN 'approver' THEN 100000 WHEN 'auditor' THEN 0 END"
reg("J19_authorize_actions", lambda v: workflow.authorize(_log(v)).select("id", "is_allowed", "deny_reason"), f"SELECT id, NOT coalesce(abs(amount) > {_LIMIT}, false) AS is_allowed, CASE WHEN abs(amount) > {_LIMIT} THEN 'amount over limit' END AS deny_reason FROM {LOG}")
reg("A28_role_access_summary", lambda v: workflow.role_access_summary(_log(v)), f"SELECT role, NOT coalesce(abs(amount) > {_LIMIT}, false) AS is_allowed, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM {LOG} GROUP BY 1, 2")
reg("G6_timed_out", lambda v: workflow.timed_out(_log(v), AS_OF).select("id", "state", F.col("age_minutes").cast("long").alias("age_minutes")), f"SELECT id, state, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(since))) / 60) AS BIGINT) AS age_minutes FROM {LOG} WHERE floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(since))) / 60) > CASE state WHEN 'pending_review' THEN 1440 WHEN 'pending_approval' THEN 2880 WHEN 'on_hold' THEN 10080 END")

# Sources and streams
reg("S1_ofx_source", lambda v: ofx.statement_rows(ofx.statement_texts(v.bank().filter("description <> ''"))).select("account_id", "transaction_id", F.col("timestamp").cast("date").cast("string").alias("date"), F.col("amount").cast("double").alias("amount"), "description", "transaction_type"),
    "SELECT account_id, transaction_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, regexp_replace(trim(description), '^(TED|DOC|PIX|TRANSF|SAQUE|DEPOSITO|COMPRA)\\b(\\s*[-:]\\s*)?', '', 'i') AS description, transaction_type FROM bank_tx WHERE description <> ''")
reg("S7_statement_summary", lambda v: ofx.statement_summary(ofx.statement_rows(ofx.statement_texts(v.bank()))),
    f"SELECT account_id || '/' || strftime(date, '%Y%m') AS path, count(*) AS n, {POS} AS credits, abs({money('sum(CASE WHEN amount <= 0 THEN amount END)')}) AS debits, {NET} AS balance FROM bank_tx GROUP BY 1")
reg("S6_account_header", lambda v: ofx.account_header(ofx.statement_texts(v.bank())).select("path", "account_id", "bank_id", F.col("balance").cast("double").alias("balance")), f"SELECT account_id || '/' || strftime(date, '%Y%m') AS path, account_id, '104' AS bank_id, {NET} AS balance FROM bank_tx GROUP BY ALL")
reg("S12_skip_seen_files", lambda v: ofx.skip_seen_files(ofx.statement_texts(v.bank()), ofx.statement_texts(v.bank().filter("account_id like '%1'")).select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))).select("path"),
    "SELECT DISTINCT account_id || '/' || strftime(date, '%Y%m') AS path FROM bank_tx WHERE account_id NOT LIKE '%1'")
reg("T2_stream_dedup", lambda v: jobs.run_once(jobs.stream_dedup(jobs.events_stream(v.spark, v.dir).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")), ["event_id"]).select("event_id"), v.scratch()), "SELECT event_id FROM events")
_marks = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{bank}'" for bank, marks in ofx.BANK_MARKS.items())
reg("S5_identify_bank", lambda v: v.table("documents").select("doc_id", ofx.identify_bank(F.col("text")).alias("bank")), f"SELECT doc_id, CASE {_marks} ELSE 'unknown' END AS bank FROM documents")
# More scalar functions and lookups
reg("X2_normalize_strict", lambda v: v.bank().select("id", T.normalize_strict(F.concat(F.lit("  "), "description")).alias("n")), f"SELECT id, trim({FOLD.format('description')}) AS n FROM bank_tx")
_aggressive = f"list_filter(string_split(trim(regexp_replace(regexp_replace({FOLD.format('description')}, '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND NOT list_contains({NOISE_SQL}, w))"
reg("X4_normalize_aggressive", lambda v: v.bank().select("id", T.normalize_aggressive(F.col("description")).alias("n")), f"SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS n FROM (SELECT id, {_aggressive} AS w FROM bank_tx)")
reg("X10_parse_date_text", lambda v: v.bank().select("id", C.parse_date_text(F.when(F.col("id") % 2 == 0, F.concat(F.lit("em "), F.date_format("date", "dd.MM.yyyy"), F.lit(" pago"))).otherwise(F.concat(F.lit("vence 99/99/2024 ou "), F.col("date").cast("string")))).cast("string").alias("d")), "SELECT id, CAST(date AS VARCHAR) AS d FROM bank_tx")
reg("X13_coerce_description", lambda v: v.table("documents").select("doc_id", F.md5(C.coerce_description(F.col("text"))).alias("d")), "SELECT doc_id, md5(substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 500)) AS d FROM documents")
reg("X16_type_by_sign", lambda v: v.bank().select("id", C.bank_type(F.col("amount")).alias("bank_type"), C.ledger_type(F.col("amount")).alias("ledger_type")), "SELECT id, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS bank_type, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS ledger_type FROM bank_tx")
reg("X21_canonical_category", lambda v: v.bank().select("id", T.canonical_category(F.when(F.col("id") % 2 == 0, F.lit("MULTA")).otherwise(F.col("category"))).alias("c")), "SELECT id, CASE WHEN id % 2 = 0 THEN 'Juros/Multa' ELSE category END AS c FROM bank_tx")
reg("J2_valid_match_filter", lambda v: matching.pair_scores(v.bank(), v.ledger(), fits=True).select("b_id", "e_id"))
SQL["J2_valid_match_filter"] = VIEWS.rstrip() + _PAIRS + "SELECT b_id, e_id FROM g WHERE score >= 0.65 AND days <= 30 AND diff <= 0.02 * greatest(ba, ea)"

from ledgerloom.plans import learned, learned_matches, more, reviewing, rules, streams  # noqa: E402, F401  their queries register themselves
