"""More queries over the given tables with their oracle SQL: rules, decisions, learned context, workflow, audit and ledgers.

Adapters vary the derived rows by their ids so that each rule has more than one outcome; the SQL states the rule over the same rows.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import coerce as C
from ledgerloom.functions import text as T
from ledgerloom.operators import anomaly, context, decisions, joins, matching, quality, reports, windows, workflow
from ledgerloom.plans import adapters
from ledgerloom.plans.adapters import FOLD, VIEWS
from ledgerloom.plans.registry import _PAIRS, _RULES, AS_OF, LOG, MONTHS, NEG, SQL, STANDARD, Views, _log, money, reg
from ledgerloom.sources import ledger


def case(at: Column, *values) -> Column:
    """Text by a number: the value at that place, null for None."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def with_views(name: str, sql: str) -> None:
    """SQL that goes on with the views' list of WITH."""
    SQL[name] = VIEWS.rstrip() + sql


# Anomalies of matches
def _pairs(v: Views) -> DataFrame:
    b = v.bank().select(F.col("id").alias("bank_transaction_id"), F.col("amount").alias("ba"), F.col("date").alias("bank_date"), F.col("category").alias("bc"), F.col("transaction_type").alias("bank_type"), F.col("description").alias("bank_description"))
    e = v.ledger().select(F.col("id").alias("company_entry_id"), F.col("amount").alias("ea"), F.col("date").alias("ed"), F.col("category").alias("ec"), F.col("transaction_type").alias("et"), F.col("description").alias("entry_description"))
    i = F.col("id")
    times = F.element_at(F.array(F.lit(1), F.lit(100), F.lit(40)), (i % 3 + 1).cast("int"))
    rows = v.recon().select("id", "bank_transaction_id", "company_entry_id", "match_score").join(b, "bank_transaction_id").join(e, "company_entry_id")
    return rows.select(
        "id", "match_score", "bank_date", "bank_type", "bank_description", "entry_description", (F.col("ba") * times).cast("decimal(18,2)").alias("bank_amount"),
        F.when(i % 10 == 4, F.lit(3000).cast("decimal(18,2)")).when(i % 4 == 0, (F.col("ea") * times * 2).cast("decimal(18,2)")).otherwise((F.col("ea") * times).cast("decimal(18,2)")).alias("entry_amount"),
        F.when(i % 6 == 0, F.date_add("ed", (i % 5 * 30).cast("int"))).otherwise(F.col("ed")).alias("entry_date"),
        F.when(i % 7 == 0, "Alimentacao").when(i % 7 == 1, F.lit(None)).otherwise(F.col("bc")).alias("bank_category"),
        F.when(i % 7 == 0, "TRANSPORTE").when(i % 7 == 2, "lazer").otherwise(F.col("ec")).alias("entry_category"),
        F.when(i % 8 == 2, "income").otherwise(F.col("et")).alias("entry_type"),
    )


_RATIOS = "(VALUES " + ", ".join(f"('{b}', '{e}', {SequenceMatcher(None, b.lower().strip(), e.lower().strip()).ratio()}::DOUBLE)" for b in sorted(set(adapters.BANK_TEXTS)) for e in sorted(set(adapters.LEDGER_TEXTS))) + ") q(qb, qe, ratio)"
_ENRICHED = """(SELECT r.id, r.match_score, b.date AS d, b.transaction_type AS bt, b.description AS bd, e.description AS ed, CAST(b.amount * m AS DOUBLE) AS a,
  CAST(CASE WHEN r.id % 10 = 4 THEN 3000 WHEN r.id % 4 = 0 THEN e.amount * m * 2 ELSE e.amount * m END AS DOUBLE) AS c, CASE WHEN r.id % 6 = 0 THEN e.date + CAST(r.id % 5 * 30 AS INT) ELSE e.date END AS f,
  lower(CASE WHEN r.id % 7 = 0 THEN 'Alimentacao' WHEN r.id % 7 = 1 THEN 'outros' ELSE b.category END) AS bc, lower(CASE WHEN r.id % 7 = 0 THEN 'TRANSPORTE' WHEN r.id % 7 = 2 THEN 'lazer' ELSE e.category END) AS ec,
  CASE WHEN r.id % 8 = 2 THEN 'income' ELSE e.transaction_type END AS et
  FROM (SELECT *, [1, 100, 40][CAST(id % 3 + 1 AS INT)] AS m FROM recon) r JOIN bank_tx b ON b.id = r.bank_transaction_id JOIN ledger e ON e.id = r.company_entry_id)"""
_CONFLICT = " OR ".join(f"(bc = '{a}' AND ec = '{b}') OR (bc = '{b}' AND ec = '{a}')" for a, b in anomaly.CONFLICTS)
_GENERIC = quoted(anomaly.GENERIC)
_RISK = """(CASE WHEN abs(c) > 10000 THEN 0.3::DOUBLE WHEN abs(c) > 5000 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN (bt <> 'credit' AND et = 'income') OR (bt <> 'debit' AND et = 'expense') THEN 0.4::DOUBLE ELSE 0 END
  + CASE WHEN isodow(d) >= 6 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN abs(c) > 1000 AND abs(c) % 1000 = 0 THEN 0.1::DOUBLE ELSE 0 END)"""
_FACTS = f"""(SELECT *, abs(abs(a) - abs(c)) / greatest(abs(a), abs(c)) AS p, abs(d - f) AS k, {_RISK} AS risk, len(list_intersect(string_split(lower(bd), ' '), string_split(lower(ed), ' '))) AS common
  FROM {_ENRICHED} JOIN {_RATIOS} ON qb = bd AND qe = ed)"""
#: severity and score of each item, as SQL over _FACTS.
_SEVERITY = {
    "D1": "CASE WHEN a = 0 OR c = 0 THEN 'critical' WHEN p > 0.5 THEN 'critical' WHEN p > 0.2 THEN 'high' WHEN p > 0.05 THEN 'medium' WHEN p > 0.01 THEN 'low' END",
    "D2": "CASE WHEN k > 90 THEN 'critical' WHEN k > 30 THEN 'high' WHEN k > 7 THEN 'medium' WHEN k > 3 THEN 'low' END",
    "D3": "CASE WHEN bd = '' OR ed = '' THEN 'medium' WHEN ratio < 0.1 AND common = 0 THEN 'high' WHEN ratio < 0.3 AND common <= 1 THEN 'medium' WHEN ratio < 0.5 THEN 'low' END",
    "D4": f"CASE WHEN {_CONFLICT} THEN 'medium' WHEN bc <> ec AND (bc IN ({_GENERIC}) OR ec IN ({_GENERIC})) THEN 'low' END",
    "D5": "CASE WHEN risk > 0.5 THEN 'high' WHEN risk > 0.3 THEN 'medium' WHEN risk > 0 THEN 'low' END",
}
_SCORE = {
    "D1": "CASE WHEN a = 0 OR c = 0 THEN 0.9::DOUBLE WHEN p > 0.5 THEN least(0.95, p * 1.5) WHEN p > 0.2 THEN least(0.8, p * 2) WHEN p > 0.05 THEN least(0.6, p * 5) WHEN p > 0.01 THEN least(0.3, p * 10) END",
    "D2": "CASE WHEN k > 90 THEN least(0.95, k / 365) WHEN k > 30 THEN least(0.8, k / 120) WHEN k > 7 THEN least(0.6, k / 60) WHEN k > 3 THEN least(0.3, k / 30) END",
    "D3": "CASE WHEN bd = '' OR ed = '' THEN 0.6::DOUBLE WHEN ratio < 0.1 AND common = 0 THEN 0.8 WHEN ratio < 0.3 AND common <= 1 THEN 0.6 WHEN ratio < 0.5 THEN 0.3 END",
    "D4": f"CASE WHEN {_CONFLICT} THEN 0.5::DOUBLE WHEN bc <> ec AND (bc IN ({_GENERIC}) OR ec IN ({_GENERIC})) THEN 0.3 END",
    "D5": "CASE WHEN risk > 0 THEN least(risk, 0.9) END",
}
c_ = F.col
_ITEMS = {
    "D1_amount_mismatch": lambda: anomaly.amount_mismatch(c_("bank_amount"), c_("entry_amount")), "D2_date_discrepancy": lambda: anomaly.date_discrepancy(c_("bank_date"), c_("entry_date")),
    "D3_description_mismatch": lambda: anomaly.description_mismatch(c_("bank_description"), c_("entry_description")), "D4_category_conflict": lambda: anomaly.category_conflict(c_("bank_category"), c_("entry_category")),
    "D5_risk_pattern": lambda: anomaly.risk_pattern(c_("entry_amount"), c_("bank_type"), c_("entry_type"), c_("bank_date")),
}
for _name, _item in _ITEMS.items():
    reg(_name, lambda v, item=_item: _pairs(v).select("id", item().alias("i")).select("id", F.col("i.severity").alias("severity"), F.round("i.score", 6).alias("score")),
        f"SELECT id, {_SEVERITY[_name[:2]]} AS severity, round({_SCORE[_name[:2]]}, 6) AS score FROM {_FACTS}")
_DUPES = ", o AS (SELECT r.id, bank_transaction_id AS bt, company_entry_id AS ce, amount, date FROM recon r JOIN bank_tx b ON b.id = r.bank_transaction_id WHERE status IN ('pending','confirmed')), u AS (SELECT DISTINCT a.id AS uid FROM o a JOIN o b ON a.amount = b.amount AND abs(a.date - b.date) <= 7 AND a.bt <> b.bt AND a.ce <> b.ce)\n"
_W = lambda s: f"CASE {s} WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 END"
_TYPES = {"D1": "amount_mismatch", "D2": "date_discrepancy", "D3": "description_mismatch", "D4": "category_conflict", "D5": "unusual_pattern", "D6": "duplicate_match"}
_ALL = f"(SELECT id, match_score, {', '.join(f'{_SEVERITY[k]} AS v{k}, {_SCORE[k]} AS s{k}' for k in _SEVERITY)}, CASE WHEN uid IS NOT NULL THEN 'medium' END AS vD6, CASE WHEN uid IS NOT NULL THEN 0.6::DOUBLE END AS sD6 FROM {_FACTS} LEFT JOIN u ON uid = id)"
_LONG = f"(SELECT id, match_score, unnest([{', '.join(f'v{k}' for k in _TYPES)}]) AS v, unnest([{', '.join(f's{k}' for k in _TYPES)}]) AS s, unnest([{quoted(_TYPES.values())}]) AS kind FROM {_ALL})"
_TOTALS = f"""(SELECT id, any_value(match_score) AS m, CAST(count(v) AS INTEGER) AS n, coalesce(round(sum(s * {_W('v')}), 6), 0.0) AS t, arg_max(kind, ({_W('v')}, s, kind)) FILTER (v IS NOT NULL) AS primary_type, coalesce(bool_or(kind IN ('amount_mismatch', 'duplicate_match')) FILTER (v IS NOT NULL), false) AS must,
  list_sort(list_distinct(list(CASE {' '.join(f"WHEN v IS NOT NULL AND kind = '{k}' THEN '{w}'" for k, w in anomaly.ADVICE.items())} WHEN v IN ('critical', 'high') AND kind = 'amount_mismatch' THEN '{anomaly.AMOUNT_ADVICE[0]}' WHEN v IS NOT NULL AND kind = 'amount_mismatch' THEN '{anomaly.AMOUNT_ADVICE[1]}' END))) AS said FROM {_LONG} GROUP BY id)"""
_JUDGED = f"(SELECT *, CASE WHEN t >= 0.95 OR n >= 3 THEN 'critical' WHEN t >= 0.8 THEN 'high' WHEN t >= 0.6 THEN 'medium' ELSE 'low' END AS severity FROM {_TOTALS})"


def _analyzed(v: Views) -> DataFrame:
    return anomaly.analyze(_pairs(v), v.recon(), v.bank())


reg("D6_duplicate_match", lambda v: _analyzed(v).select("id", F.exists("anomalies", lambda x: x["type"] == "duplicate_match").alias("is_duplicate")))
with_views("D6_duplicate_match", _DUPES + f"SELECT id, uid IS NOT NULL AS is_duplicate FROM {_ENRICHED} LEFT JOIN u ON uid = id")
reg("D7_analyze_match", lambda v: _analyzed(v).select("id", "n_anomalies", F.round("total", 4).alias("total"), "primary_type"))
with_views("D7_analyze_match", _DUPES + f"SELECT id, n AS n_anomalies, round(least(t, 1.0), 4) AS total, primary_type FROM {_JUDGED}")
reg("D8_overall_severity", lambda v: _analyzed(v).select("id", "severity", "confidence", "review", F.round(F.col("priority") + 1e-9, 4).alias("priority")))
with_views("D8_overall_severity", _DUPES + f"""SELECT id, severity, CASE WHEN n = 0 OR (m > 0.8 AND t > 0.6) THEN 'high' WHEN m > 0.6 AND t > 0.3 THEN 'medium' ELSE 'low' END AS confidence, severity IN ('critical', 'high') OR n >= 2 OR must AS review,
  round(least(10.0, t * CASE severity WHEN 'critical' THEN 3.0::DOUBLE WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.5 ELSE 1.0 END * (1 + 0.2::DOUBLE * n)) + 1e-9::DOUBLE, 4) AS priority FROM {_JUDGED}""")
reg("D12_recommendations", lambda v: _analyzed(v).select("id", F.array_join("advice", "|").alias("advice")))
with_views("D12_recommendations", _DUPES + f"SELECT id, array_to_string(list_sort(list_filter(said || [CASE severity WHEN 'critical' THEN '{anomaly.SEVERITY_ADVICE['critical']}' WHEN 'high' THEN '{anomaly.SEVERITY_ADVICE['high']}' END], lambda x: x IS NOT NULL)), '|') AS advice FROM {_JUDGED}")

# Lookups and decisions
reg("J3_existing_pair_lookup", lambda v: decisions.existing_pairs(v.recon().select("bank_transaction_id", (F.col("company_entry_id") + F.when(F.col("id") % 5 == 0, 3).otherwise(0)).alias("company_entry_id")), v.recon()),
    "SELECT a.bank_transaction_id, a.company_entry_id + CASE WHEN a.id % 5 = 0 THEN 3 ELSE 0 END AS company_entry_id, (SELECT min(id) FROM recon b WHERE b.bank_transaction_id = a.bank_transaction_id AND b.company_entry_id = a.company_entry_id + CASE WHEN a.id % 5 = 0 THEN 3 ELSE 0 END) AS record_id FROM recon a")
reg("J6_fetch_duplicates", lambda v: decisions.fetch_duplicates(v.bank().filter("transaction_type = 'debit'"), v.bank(), ["date", "description"]).select("id"), "SELECT id FROM bank_tx l WHERE EXISTS (SELECT 1 FROM bank_tx s WHERE s.transaction_type = 'debit' AND s.date = l.date AND s.description = l.description)")
reg("J12_similar_anomalies", lambda v: joins.similar_anomalies(v.recon(), AS_OF), f"SELECT a.id, b.id AS other_id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.anomaly_detected_at DESC, b.id DESC) AS INTEGER) AS rank FROM recon a JOIN recon b ON a.is_anomaly AND b.is_anomaly AND a.anomaly_type = b.anomaly_type AND a.id <> b.id AND b.anomaly_detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY QUALIFY rank <= 5")
_SIMILAR = f"(SELECT a.id, b.id AS other_id FROM recon a JOIN recon b ON a.is_anomaly AND b.is_anomaly AND a.anomaly_type = b.anomaly_type AND a.id <> b.id AND b.anomaly_detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.anomaly_detected_at DESC, b.id DESC) <= 10)"
_resolved = lambda v: v.recon().filter("anomaly_action is not null").select("id", case(F.floor(F.col("id") / 14) % 2, "confirm", "dismiss").alias("action"))
reg("J13_propagate_resolution", lambda v: decisions.propagate_resolution(v.recon(), joins.similar_anomalies(v.recon(), AS_OF, 10), _resolved(v)),
    f"SELECT o.id, arg_min(action, s.id) AS action, min(s.id) AS from_id FROM (SELECT *, ['confirm', 'dismiss'][CAST((id // 14) % 2 + 1 AS INT)] AS action FROM recon WHERE anomaly_action IS NOT NULL) s JOIN {_SIMILAR} x ON x.id = s.id JOIN recon o ON o.id = x.other_id WHERE o.anomaly_action IS NULL AND ((action = 'confirm' AND o.anomaly_score > 0.8) OR (action = 'dismiss' AND o.anomaly_score < 0.4)) GROUP BY 1")
reg("A17_similar_resolutions", lambda v: reports.similar_resolutions(joins.similar_anomalies(v.recon(), AS_OF, 10), v.recon()), f"SELECT x.id, coalesce(r.anomaly_action, 'pending') AS action, count(*) AS n FROM {_SIMILAR} x JOIN recon r ON r.id = x.other_id GROUP BY 1, 2")
reg("J14_guarded_delete", lambda v: joins.guarded_delete(v.ledger().select("id"), v.recon()), "SELECT id, coalesce(n, 0) AS linked, n IS NULL AS deletable FROM ledger LEFT JOIN (SELECT company_entry_id, count(*) AS n FROM recon GROUP BY 1) ON id = company_entry_id")
reg("E2_except_ids", lambda v: joins.except_ids(v.ledger().select("id"), v.recon().select(F.col("company_entry_id").alias("id"))), "SELECT id FROM ledger WHERE id NOT IN (SELECT company_entry_id FROM recon)")
_OPEN = "SELECT bank_transaction_id AS b_id, company_entry_id AS e_id FROM recon WHERE status IN ('pending', 'confirmed')"
reg("M21_suggest_matches", lambda v: decisions.suggest_matches(v.bank(), v.ledger(), v.recon()).select("b_id", "e_id", "rank", "score"))
with_views("M21_suggest_matches", _PAIRS + f"SELECT b_id, e_id, CAST(row_number() OVER (PARTITION BY b_id ORDER BY score DESC, e_id) AS INTEGER) AS rank, score FROM g WHERE score >= 0.65 AND (b_id, e_id) NOT IN ({_OPEN}) QUALIFY rank <= 5")
reg("M23_create_records", lambda v: decisions.create_records(matching.best_pairs(v.bank(), v.ledger(), 3), v.recon()))
with_views("M23_create_records", _PAIRS + "SELECT b_id AS bank_transaction_id, e_id AS company_entry_id, score AS match_score, 'pending' AS status FROM (SELECT b_id, e_id, score FROM g WHERE score >= 0.65 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY score DESC, e_id) <= 3) WHERE (b_id, e_id) NOT IN (SELECT bank_transaction_id, company_entry_id FROM recon)")
_wish = lambda v: v.recon().select("bank_transaction_id", (F.col("company_entry_id") + F.when(F.col("id") % 5 == 0, 3).when(F.col("id") % 5 == 1, 1).otherwise(0)).alias("company_entry_id"), (F.col("id") % 23 / 20).alias("confidence"))
reg("M24_manual_match", lambda v: decisions.manual_match(_wish(v), v.bank(), v.ledger(), v.recon()),
    """SELECT w.bank_transaction_id, w.company_entry_id, w.confidence, r.id AS record_id, CASE WHEN confidence > 1 THEN 'confidence out of range' WHEN e.id IS NULL THEN 'no such entry' WHEN r.id IS NOT NULL THEN 'existing' ELSE 'created' END AS outcome
    FROM (SELECT bank_transaction_id, company_entry_id + CASE id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS company_entry_id, (id % 23) / 20 AS confidence FROM recon) w LEFT JOIN ledger e ON e.id = w.company_entry_id LEFT JOIN recon r ON r.bank_transaction_id = w.bank_transaction_id AND r.company_entry_id = w.company_entry_id""")
_acts = lambda v: v.recon().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), (F.col("id") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).alias("id")).withColumn("action", case((F.col("id") + F.col("seq")) % 3, "confirm", "reject", "confirm"))
_ACTS = "(SELECT id + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS id, seq, ['confirm', 'reject', 'confirm'][CAST((id + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END + seq) % 3 + 1 AS INT)] AS action FROM recon, range(2) t(seq))"
_DECIDED = f"""(SELECT id, seq, action, st, CASE WHEN st IS NULL THEN 'not found' WHEN st = want THEN 'unchanged' WHEN st <> 'pending' THEN 'conflict' ELSE 'done' END AS outcome, CASE WHEN st = 'pending' THEN want ELSE st END AS new_status FROM (
  SELECT d.*, CASE action WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END AS want, CASE WHEN seq = 0 OR r.status IS NULL OR r.status <> 'pending' THEN r.status ELSE CASE ['confirm', 'reject', 'confirm'][CAST(d.id % 3 + 1 AS INT)] WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END END AS st FROM {_ACTS} d LEFT JOIN recon r ON r.id = d.id))"""
reg("M25_apply_decisions", lambda v: decisions.apply_decisions(v.recon(), _acts(v)), f"SELECT id, CAST(seq AS INTEGER) AS seq, action, outcome, new_status FROM {_DECIDED}")
reg("M25_decision_summary", lambda v: decisions.decision_summary(decisions.apply_decisions(v.recon(), _acts(v))), f"SELECT count(*) AS n, count(*) FILTER (outcome IN ('done', 'unchanged')) AS succeeded, count(*) FILTER (outcome NOT IN ('done', 'unchanged')) AS failed, round(count(*) FILTER (outcome IN ('done', 'unchanged')) / count(*), 4) AS success_rate FROM {_DECIDED}")
reg("M26_adjust_scores", lambda v: decisions.adjust_scores(v.recon(), v.recon().select((F.col("id") + F.when(F.col("id") % 9 == 0, 1).otherwise(0)).alias("id"), (F.col("id") % 13 / 10).alias("new_score"))),
    "SELECT c.id, r.match_score AS old_score, new_score, CASE WHEN new_score > 1 THEN 'score out of range' WHEN r.id IS NULL THEN 'not found' WHEN status <> 'pending' THEN 'closed' ELSE 'adjusted' END AS outcome FROM (SELECT id + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS id, (id % 13) / 10 AS new_score FROM recon) c LEFT JOIN recon r ON r.id = c.id")
_SHORT = ["confirm", "dismiss", "escalate", "request_info", "nothing", "mark_for_training"]
reg("D14_flag_and_resolve", lambda v: decisions.flag_and_resolve(v.recon(), v.recon().filter("id % 3 > 0").select("id", case(F.floor(F.col("id") / 7) % 6, *_SHORT).alias("action"), (F.col("id") % 4).alias("reviewer"), F.lit(1).alias("seq"))),
    f"""SELECT id, anomaly_type, CASE WHEN a = 'escalate' THEN 'critical' ELSE anomaly_severity END AS severity, CASE a WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss' THEN 'dismissed' WHEN 'escalate' THEN 'escalated' WHEN 'request_info' THEN a WHEN 'mark_for_training' THEN a ELSE 'pending_review' END AS action,
    CASE WHEN a <> 'nothing' THEN id % 4 END AS reviewer FROM (SELECT *, CASE WHEN id % 3 > 0 THEN {adapters._list(_SHORT)}[CAST((id // 7) % 6 + 1 AS INT)] END AS a FROM recon WHERE is_anomaly)""")

# Learned context
_SUPPLIER = "coalesce(nullif(regexp_extract({f}, '" + T.ENTITIES["company"].replace("(?:", "(", 1) + "', 1), ''), nullif(regexp_extract({d}, '(?i)((\\S+\\s+){{0,3}}(LTDA|S\\.A|ME|EPP))(\\s|$)', 1), ''))"
_SUPPLIER_SQL = lambda d: _SUPPLIER.format(f=FOLD.format(d), d=d)
reg("C8_supplier_name", lambda v: v.bank().select("id", T.supplier_name(F.col("description")).alias("supplier")), f"SELECT id, {_SUPPLIER_SQL('description')} AS supplier FROM bank_tx")
_AMOUNTS = "CASE WHEN abs({0}) = abs({1}) THEN 'exact' WHEN abs(abs({0}) - abs({1})) / greatest(abs({0}), abs({1})) < 0.05 THEN 'close' ELSE 'variable' END"
_DATES = "CASE WHEN abs({0} - {1}) = 0 THEN 'same_day' WHEN abs({0} - {1}) <= 3 THEN 'few_days' WHEN abs({0} - {1}) <= 7 THEN 'week' ELSE 'extended' END"
_NORM = lambda d: STANDARD.replace("description", d)
_MINED = f""", mined AS (SELECT unnest(['description', 'amount', 'date', 'time', 'supplier']) AS type, unnest([CASE WHEN nb <> '' AND ne <> '' THEN nb || '||' || ne END, {_AMOUNTS.format('ba', 'ea')}, {_DATES.format('bd', 'ed')}, 'hour_' || hour(created_at), supplier]) AS pattern FROM (
  SELECT {_NORM('b.description')} AS nb, {_NORM('e.description')} AS ne, b.amount AS ba, e.amount AS ea, b.date AS bd, e.date AS ed, created_at, {_SUPPLIER_SQL('b.description')} AS supplier FROM recon r JOIN bank_tx b ON b.id = r.bank_transaction_id JOIN ledger e ON e.id = r.company_entry_id WHERE status = 'confirmed')),
patterns AS (SELECT type, pattern, n AS count, n / total AS frequency, CASE WHEN n / total > 0.1 THEN 'high' ELSE 'medium' END AS significance FROM (SELECT type, pattern, count(*) AS n FROM mined WHERE pattern IS NOT NULL GROUP BY 1, 2), (SELECT count(*) AS total FROM recon WHERE status = 'confirmed') WHERE n > 1 AND n / total > 0.01)
"""
_mined = lambda v: context.mine_patterns(v.recon(), v.bank(), v.ledger())
reg("C1_mine_patterns", lambda v: _mined(v).withColumn("frequency", F.round("frequency", 9)))
with_views("C1_mine_patterns", _MINED + "SELECT type, pattern, count, round(frequency, 9) AS frequency, significance FROM patterns")
_LOOK = lambda kind, key, times, cap: f"least(coalesce((SELECT frequency * {times} FROM patterns WHERE type = '{kind}' AND pattern = {key}), 0.0), {cap}::DOUBLE)"
_CONTEXT = _MINED + f""", paired AS (SELECT r.id, r.match_score, {_NORM('b.description')} || '||' || {_NORM('e.description')} AS texts, {_SUPPLIER_SQL('b.description')} AS supplier, {_AMOUNTS.format('b.amount', 'e.amount')} AS ac, {_DATES.format('b.date', 'e.date')} AS dc FROM recon r JOIN bank_tx b ON b.id = r.bank_transaction_id JOIN ledger e ON e.id = r.company_entry_id),
bonus AS (SELECT id, match_score, {_LOOK('description', 'texts', 10, 0.3)} AS b1, {_LOOK('supplier', 'supplier', 2, 0.2)} AS b2, {_LOOK('amount', 'ac', 1, 0.2)} AS b3, {_LOOK('date', 'dc', 1, 0.2)} AS b4, {_LOOK('time', "'hour_9'", 1, 0.1)} AS b5 FROM paired)
"""


def _context_pairs(v: Views) -> DataFrame:
    b = v.bank().select(F.col("id").alias("bank_transaction_id"), *[F.col(c).alias(f"b_{c}") for c in ("amount", "date", "description")], T.normalize_standard(F.col("description")).alias("b_norm"))
    e = v.ledger().select(F.col("id").alias("company_entry_id"), *[F.col(c).alias(f"e_{c}") for c in ("amount", "date", "description")], T.normalize_standard(F.col("description")).alias("e_norm"))
    rows = v.recon().select("id", "bank_transaction_id", "company_entry_id", "match_score").join(b, "bank_transaction_id").join(e, "company_entry_id")
    return context.contextual(rows, _mined(v), F.col("match_score"), 9)


reg("C9_contextual_score", lambda v: _context_pairs(v).select("id", F.round("total_bonus", 6).alias("bonus"), F.round("contextual", 6).alias("score"), "patterns_used", F.round("pattern_consistency", 6).alias("consistency")))
with_views("C9_contextual_score", _CONTEXT + """SELECT id, round(t, 6) AS bonus, round(least(match_score + t, 0.95), 6) AS score, CAST((b1 > 0)::INT + (b2 > 0)::INT + (b3 > 0)::INT + (b4 > 0)::INT + (b5 > 0)::INT AS INTEGER) AS patterns_used,
  round(CASE WHEN b1 > 0 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN b2 > 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN b3 > 0 THEN 0.2 ELSE 0 END::DOUBLE, 6) AS consistency FROM (SELECT *, b1 * 0.3::DOUBLE + b2 * 0.2::DOUBLE + b3 * 0.1::DOUBLE + b4 * 0.1::DOUBLE + b5 * 0.05::DOUBLE AS t FROM bonus)""")
reg("A30_matching_metrics", lambda v: context.matching_metrics(_context_pairs(v)))
with_views("A30_matching_metrics", _CONTEXT + "SELECT count(*) AS n, round(avg(CASE WHEN b1 + b2 + b3 + b4 + b5 > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS contextual_share, round(avg(CASE WHEN b1 + b2 + b3 + b4 + b5 > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS pattern_share FROM bonus")
reg("C11_refresh_due", lambda v: context.refresh_due(v.recon(), "2024-01-30 12:00:00", AS_OF), f"SELECT n AS recent, n > 100 OR epoch(TIMESTAMP '{AS_OF}') - epoch(TIMESTAMP '2024-01-30 12:00:00') > 86400 AS due FROM (SELECT count(*) AS n FROM recon WHERE status = 'confirmed' AND created_at > TIMESTAMP '2024-01-30 12:00:00')")
_TF = "list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i+1]))"
reg("M4_tfidf_similarity", lambda v: v.bank().filter("description <> ''").select("id", F.round(T.tfidf_similarity(F.col("description"), adapters.pick(adapters.LEDGER_TEXTS, (F.col("id") + F.floor(F.col("id") / 12) % 2) % 12)), 6).alias("s")),
    f"""SELECT id, CASE WHEN lower(x) = lower(y) THEN 1.0 ELSE round(coalesce(dot / (sqrt(na) * sqrt(nb)), 0.0), 6) END AS s FROM (SELECT id, x, y,
      (SELECT sum(ca * cb) FROM (SELECT t, count(*) FILTER (side = 1) AS ca, count(*) FILTER (side = 2) AS cb FROM (SELECT unnest(ta) AS t, 1 AS side UNION ALL SELECT unnest(tb), 2) GROUP BY t)) AS dot,
      (SELECT sum(ca * ca * CASE WHEN cb > 0 THEN 1 ELSE pow(1 + ln(1.5), 2) END) FROM (SELECT t, count(*) FILTER (side = 1) AS ca, count(*) FILTER (side = 2) AS cb FROM (SELECT unnest(ta) AS t, 1 AS side UNION ALL SELECT unnest(tb), 2) GROUP BY t)) AS na,
      (SELECT sum(cb * cb * CASE WHEN ca > 0 THEN 1 ELSE pow(1 + ln(1.5), 2) END) FROM (SELECT t, count(*) FILTER (side = 1) AS ca, count(*) FILTER (side = 2) AS cb FROM (SELECT unnest(ta) AS t, 1 AS side UNION ALL SELECT unnest(tb), 2) GROUP BY t)) AS nb
      FROM (SELECT id, x, y, {_TF.format(w='wa')} AS ta, {_TF.format(w='wb')} AS tb FROM (SELECT id, x, y, list_filter(string_split(lower(x), ' '), lambda w: length(w) > 1) AS wa, list_filter(string_split(lower(y), ' '), lambda w: length(w) > 1) AS wb FROM (SELECT id, description AS x, {adapters._list(adapters.LEDGER_TEXTS)}[CAST((id + (id // 12) % 2) % 12 + 1 AS INT)] AS y FROM bank_tx WHERE description <> ''))))""")

# Validation and scans
_odd = lambda v: v.bank().withColumns({
    "description": F.when(F.col("id") % 9 == 0, case(F.floor(F.col("id") / 9) % 7, "teste de carga", "contestação", "12345", "x", "aaaaaaaaaaaaaaa", " ", "debug on")).otherwise(F.col("description")),
    "amount": F.when(F.col("id") % 13 == 0, F.lit(250000).cast("decimal(28,3)")).when(F.col("id") % 13 == 1, F.lit("1234567890.12").cast("decimal(28,3)")).when(F.col("id") % 13 == 2, F.lit("-1.125").cast("decimal(28,3)")).when(F.col("id") % 13 == 3, F.lit(None)).when(F.col("id") % 13 == 4, F.lit(0)).otherwise(F.col("amount").cast("decimal(28,3)")),
    "bank_name": F.when(F.col("id") % 17 == 0, "other bank").otherwise(F.col("bank_name")), "date": F.when(F.col("id") % 19 == 0, F.lit("1850-05-05").cast("date")).otherwise(F.col("date")),
})
_ODD = """(SELECT id, CASE WHEN id % 9 = 0 THEN ['teste de carga', 'contestação', '12345', 'x', 'aaaaaaaaaaaaaaa', ' ', 'debug on'][CAST((id // 9) % 7 + 1 AS INT)] ELSE description END AS description, CASE WHEN id % 17 = 0 THEN 'other bank' ELSE bank_name END AS bank_name, CASE WHEN id % 19 = 0 THEN DATE '1850-05-05' ELSE date END AS date,
  CASE id % 13 WHEN 0 THEN 250000 WHEN 1 THEN 1234567890.12 WHEN 2 THEN -1.125 WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE CAST(amount AS DECIMAL(28,3)) END AS amount FROM bank_tx)"""
_msg = lambda *rules: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + ")"
_F6 = _msg(("amount IS NULL", "amount missing"), ("trim(description) = ''", "description missing"), ("amount > 999999999", "amount too large"), ("amount <> round(amount, 2)", "amount has too many decimals"), ("date < DATE '1900-01-01'", "date too early"), ("date > DATE '2024-12-01'", "date too late"))
_listed = lambda df: df.select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")
reg("F6_validate_transactions", lambda v: _listed(quality.validate_transactions(_odd(v), "2024-12-01")), f"SELECT *, errors = '' AS is_valid FROM (SELECT id, {_F6} AS errors, {_msg(('amount = 0', 'amount is zero'))} AS warnings FROM {_ODD})")
_F8 = _msg(("amount > 999999999.99", "amount over limit"), ("date < DATE '1900-01-01'", "date too early"), ("date > DATE '2024-12-01' + 30", "date too late"))
_F8W = _msg(("amount > 100000 AND amount % 1000 = 0", "large round amount"), (r"regexp_matches(lower(description), '\b(test|teste|debug)\b|^[0-9]+$|^[a-z]$|a{11}')", "suspicious description"), ("bank_name = 'other bank'", "unknown bank"))
reg("F8_transaction_rules", lambda v: _listed(quality.transaction_rules(_odd(v), "2024-12-01")), f"SELECT *, errors = '' AS is_valid FROM (SELECT id, {_F8} AS errors, {_F8W} AS warnings FROM {_ODD})")
_ledger_odd = lambda v: v.ledger().withColumns({
    "category": F.when(F.col("id") % 7 == 0, "Office Supplies").when(F.col("id") % 7 == 1, F.lit(None)).when(F.col("id") % 7 == 2, "").otherwise(F.col("category")),
    "transaction_type": F.when(F.col("id") % 5 == 0, "expense").when(F.col("id") % 5 == 1, "other").otherwise(F.col("transaction_type")), "amount": F.when(F.col("id") % 11 == 0, F.lit(2_000_000).cast("decimal(18,2)")).otherwise(F.col("amount")),
})
_LEDGER_ODD = "(SELECT id, date, description, CASE id % 7 WHEN 0 THEN 'Office Supplies' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE category END AS category, CASE id % 5 WHEN 0 THEN 'expense' WHEN 1 THEN 'other' ELSE transaction_type END AS transaction_type, CASE WHEN id % 11 = 0 THEN 2000000 ELSE amount END AS amount FROM ledger)"
_F7 = "CASE WHEN category IS NULL THEN 'category missing' ELSE " + _msg(("transaction_type = 'other'", "transaction_type not allowed"), ("category = ''", "category too short")) + " END"
_F7W = _msg(("category IS NOT NULL AND transaction_type = 'expense' AND amount > 0", "positive expense"), ("category IS NOT NULL AND transaction_type = 'income' AND amount < 0", "negative income"))
_F9W = "concat_ws(',', nullif(" + _F7W + ", ''), nullif(" + _msg(("transaction_type = 'expense' AND amount > 0", "expense with positive amount"), ("transaction_type = 'income' AND amount < 0", "income with negative amount"), ("abs(amount) > 1000000", "unusually large amount"), (f"category <> '' AND replace(lower(category), ' ', '_') NOT IN ({quoted(quality.STANDARD_CATEGORIES)})", "non-standard category")) + ", ''))"
reg("F7_validate_ledger", lambda v: _listed(quality.validate_ledger(_ledger_odd(v))), f"SELECT *, errors = '' AS is_valid FROM (SELECT id, {_F7} AS errors, {_F7W} AS warnings FROM {_LEDGER_ODD})")
reg("F9_ledger_rules", lambda v: _listed(quality.ledger_rules(_ledger_odd(v))), f"SELECT *, errors = '' AS is_valid FROM (SELECT id, {_F7} AS errors, {_F9W} AS warnings FROM {_LEDGER_ODD})")
_texts = lambda v: v.bank().select("id", case(F.col("id") % 5, "abc", "a1", "", "abcdefghijkl", "b-2").alias("code"), case(F.col("id") % 4, "1,25", "x", "-3", "1.234").alias("number"), case(F.col("id") % 3, "2024-02-30", "2024-02-28", "1800-01-01").alias("day"))
reg("F10_rule_builder", lambda v: _texts(v).select("id", F.array_join(quality.messages(quality.required(F.col("code"), "code"), *quality.text_rules(F.col("code"), "code", 2, 10, "^[a-z]+$"), *quality.number_rules(F.col("number"), "number", 0, 100, 2), *quality.date_rules(F.col("day"), "day", "1900-01-01")), ",").alias("errors")),
    f"""SELECT id, {_msg(("c = ''", "code missing"), ("length(c) < 2", "code too short"), ("length(c) > 10", "code too long"), ("NOT regexp_matches(c, '^[a-z]+$')", "code has wrong form"), ("n = 'x'", "number is no number"), ("n = '-3'", "number too small"), ("n = '1.234'", "number has too many decimals"), ("d = '2024-02-30'", "day is no date"), ("d = '1800-01-01'", "day too early"))} AS errors
    FROM (SELECT id, ['abc', 'a1', '', 'abcdefghijkl', 'b-2'][CAST(id % 5 + 1 AS INT)] AS c, ['1,25', 'x', '-3', '1.234'][CAST(id % 4 + 1 AS INT)] AS n, ['2024-02-30', '2024-02-28', '1800-01-01'][CAST(id % 3 + 1 AS INT)] AS d FROM bank_tx)""")
reg("F2_search_ledger", lambda v: quality.paginate(quality.search_ledger(v.ledger(), kind="expense", start="2024-02-01", end="2024-09-30"), 2, 40).select("id"), "SELECT id FROM ledger WHERE transaction_type = 'expense' AND date BETWEEN DATE '2024-02-01' AND DATE '2024-09-30' ORDER BY date DESC, id LIMIT 40 OFFSET 40")
reg("F12_adjusted_flag", lambda v: v.recon().select("id", quality.adjusted_flag(F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("anomaly_action"))).alias("was_adjusted")), "SELECT id, length(trim(coalesce(CASE WHEN id % 3 = 0 THEN '  ' ELSE anomaly_action END, ''))) > 0 AS was_adjusted FROM recon")
reg("F13_ingest_corrections", lambda v: quality.ingest_corrections(v.ledger().filter("id % 2 = 0").select("id", "date", "description", "amount", "transaction_type", "category"), v.ledger().filter("id % 2 = 1").select(
    "id", F.when(F.col("id") % 5 > 0, F.col("date")).alias("date"), F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("description")).alias("description"), F.when(F.col("id") % 4 == 1, F.col("amount")).alias("amount"), F.when(F.col("id") % 3 == 0, " income ").alias("transaction_type"), F.when(F.col("id") % 9 > 0, " N/A ").otherwise("x").alias("category"))).select("id", "transaction_type", F.col("amount").cast("double").alias("amount"), "category"),
    "SELECT id, transaction_type, CAST(amount AS DOUBLE) AS amount, category FROM ledger WHERE id % 2 = 0 UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN 'income' ELSE 'expense' END, CASE WHEN id % 4 = 1 THEN CAST(amount AS DOUBLE) ELSE 0 END, CASE WHEN id % 9 > 0 THEN 'Nao categorizado' ELSE 'x' END FROM ledger WHERE id % 2 = 1 AND id % 5 > 0 AND id % 7 <> 0 AND trim(description) <> ''")
reg("F15_list_pending", lambda v: quality.list_pending(v.recon()).select("id", "match_score"), "SELECT id, match_score FROM recon WHERE status = 'pending'")
reg("F16_list_anomalies", lambda v: quality.list_anomalies(v.recon(), "medium", False, 50, 10).select("id", "total_count", "has_more"), "SELECT id, n AS total_count, n > 60 AS has_more FROM (SELECT id, anomaly_detected_at, count(*) OVER () AS n FROM recon WHERE is_anomaly AND anomaly_severity = 'medium' AND anomaly_action IS NULL ORDER BY anomaly_detected_at DESC, id LIMIT 50 OFFSET 10)")
_BAITS = ["", " <script src=x>go</script>", " x' or 1=1 -- y", " ..%2fetc ../up", " ; rm all", " alert(1)", ""]
_baited = lambda v: v.table("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), case(F.col("doc_id") % 7, *_BAITS)).alias("t"))
_BAITED = f"(SELECT doc_id, coalesce(text, '') || {'[' + quoted(_BAITS) + ']'}[CAST(doc_id % 7 + 1 AS INT)] AS t FROM documents)"
_hit = lambda t, ps, flags="i": f"regexp_matches({t}, '{('|'.join(ps)).replace(chr(39), chr(39) * 2)}', '{flags}')"
reg("F17_scan_injection", lambda v: quality.scan_injection(_baited(v), F.col("t")).drop("t"), f"SELECT doc_id, {_hit('t', quality.XSS, 'is')} AS has_xss, {_hit('t', quality.SQL_INJECTION)} AS has_sql, {_hit('t', quality.TRAVERSAL)} AS has_traversal, {_hit('t', quality.COMMAND)} AS has_command FROM {_BAITED}")
reg("F19_scan_scripts", lambda v: _baited(v).select("doc_id", quality.scan_scripts(F.col("t")).alias("has_script")), f"SELECT doc_id, {' OR '.join(f'contains(lower(t), {chr(39)}{m}{chr(39)})' for m in quality.SCRIPTS)} AS has_script FROM {_BAITED}")
_TAILS = ["", "&q=1%20or%201%3D1", "?limit=select", "&next=javascript%3Ago"]
reg("F20_scan_urls", lambda v: quality.scan_urls(v.table("pages").select("page_id", F.concat("url", case(F.col("page_id") % 4, *_TAILS)).alias("u")), F.col("u"), 50).drop("u"))
reg("F21_drop_balance_rows", lambda v: quality.drop_balance_rows(v.bank().withColumn("description", F.when(F.col("id") % 6 == 0, "SALDO do dia").otherwise(F.col("description")))).select("id"), "SELECT id FROM bank_tx WHERE id % 6 <> 0")

# Scalars
_forms = lambda v: v.bank().select("id", case(F.col("id") % 8, "yyyy-MM-dd", "dd/MM/yyyy", "x", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy.MM.dd", "x").alias("f"), "date")
reg("X12_coerce_date", lambda v: v.bank().select("id", C.coerce_date(reduce_when(F.col("id") % 8, [F.date_format("date", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy")] + [F.lit("12/31/2023")] + [F.date_format("date", f) for f in ("dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy.MM.dd")] + [F.lit("31/31/2024")])).cast("string").alias("d")),
    "SELECT id, CASE id % 8 WHEN 2 THEN '2023-12-31' WHEN 7 THEN NULL ELSE CAST(date AS VARCHAR) END AS d FROM bank_tx")


def reduce_when(at: Column, values: list[Column]) -> Column:
    out = F.when(at == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(at == i, value)
    return out


_bare = lambda v: v.bank().select("id", F.when(F.col("id") % 5 == 0, case(F.floor(F.col("id") / 5) % 4, "PIX", "TED - ", "TRANSFERENCIA x", "  doc:  Ana ")).otherwise(F.col("description")).alias("t"))
_BARE = "(SELECT id, CASE WHEN id % 5 = 0 THEN ['PIX', 'TED - ', 'TRANSFERENCIA x', '  doc:  Ana '][CAST((id // 5) % 4 + 1 AS INT)] ELSE description END AS t FROM bank_tx)"
reg("X14_clean_description", lambda v: _bare(v).select("id", C.clean_description(F.col("t")).alias("d")), f"SELECT id, CASE WHEN t = '' THEN 'Transação sem descrição' ELSE regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '^(TED|DOC|PIX|TRANSF|SAQUE|DEPOSITO|COMPRA)\\b(\\s*[-:]\\s*)?', '', 'i') END AS d FROM {_BARE}")
reg("X15_clean_transaction", lambda v: _bare(v).withColumns({"a": case(F.col("id") % 4, "12,5", "x", None, "-3.25"), "d": case(F.col("id") % 3, "2024-02-03", "2024-02-03T10:00:00", "no")}).select("id", *[e.cast("string").alias(k) if k == "date" else e.alias(k) for k, e in C.clean_transaction(F.col("t"), F.col("a"), F.col("d")).items()]),
    f"SELECT id, CASE WHEN trim(t) = '' THEN 'Transação sem descrição' ELSE regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '^(TED|DOC|PIX|TRANSF|SAQUE|DEPOSITO|COMPRA)\\b(\\s*[-:]\\s*)?', '', 'i') END AS description, [12.5, 0, 0, -3.25][CAST(id % 4 + 1 AS INT)]::DOUBLE AS amount, CASE WHEN id % 3 < 2 THEN '2024-02-03' END AS date FROM {_BARE}")
_mixed = lambda v: v.bank().select("id", F.concat(F.lit("pago "), F.date_format("date", "dd/MM/yyyy"), F.lit(" R$ 1.234,56 e 99/99/2024, 2,345.60 em 2024-02-28")).alias("t"))
reg("X7_extract_amounts", lambda v: _mixed(v).select("id", F.array_join(F.transform(C.extract_amounts(F.col("t")), lambda x: F.format_string("%.2f", x)), "|").alias("amounts")),
    "SELECT id, array_to_string(list_transform(list_filter([1234.56, 2.34, 1.23, 2345.6] || list_transform(regexp_extract_all(t, '\\d+'), lambda x: CAST(x AS DOUBLE)), lambda x: x <> 0), lambda x: printf('%.2f', x)), '|') AS amounts FROM (SELECT id, 'pago ' || strftime(date, '%d/%m/%Y') || ' R$ 1.234,56 e 99/99/2024, 2,345.60 em 2024-02-28' AS t FROM bank_tx)")
reg("X8_extract_dates", lambda v: _mixed(v).select("id", F.array_join(C.extract_dates(F.col("t")), "|").alias("dates")), "SELECT id, CAST(date AS VARCHAR) || '|2024-02-28' AS dates FROM bank_tx")
_LABELS = ["despesa", "receita", "juros", "credito", "Juros/Multa", "nada"]
_labelled = lambda v: v.ledger().select("id", F.when(F.col("id") % 4 == 0, F.lit(0)).otherwise(F.col("amount")).alias("amount"), case(F.col("id") % 6, *_LABELS).alias("label"))
_LABELLED = f"(SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE amount END AS amount, {adapters._list(_LABELS)}[CAST(id % 6 + 1 AS INT)] AS label FROM ledger)"
reg("X17_label_to_type", lambda v: _labelled(v).select("id", C.label_to_type(F.lower("label")).alias("label_type"), C.entry_type(F.col("amount"), F.lower("label")).alias("entry_type"), C.type_conflict(F.col("amount"), F.lower("label")).alias("conflict")),
    f"SELECT id, lt AS label_type, CASE WHEN amount < 0 THEN 'expense' WHEN amount > 0 THEN 'income' WHEN lt <> '' THEN lt ELSE 'expense' END AS entry_type, (amount < 0 AND lt = 'income') OR (amount > 0 AND lt = 'expense') AS conflict FROM (SELECT *, CASE WHEN label IN ('despesa', 'juros') THEN 'expense' WHEN label IN ('receita', 'credito') THEN 'income' ELSE '' END AS lt FROM {_LABELLED})")
_any_word = lambda t, words: "(" + " OR ".join(f"contains({t}, '{w}')" for w in words.split("|")) + ")"
reg("X24_infer_entry_type", lambda v: v.ledger().withColumn("d", F.when(F.col("id") % 6 == 0, case(F.col("id") % 4, "Estorno x", "Venda e multa", "nada", "Depósito")).otherwise(F.col("description"))).select("id", *[e.alias(k) for k, e in ledger.infer_entry_type(F.col("d"), F.col("category"), F.lit("")).items()]),
    f"""SELECT id, CASE WHEN i THEN 'income' WHEN e THEN 'expense' WHEN r THEN NULL WHEN c IN ({quoted(ledger.INCOME_CATEGORIES)}) THEN 'income' WHEN c IN ({quoted(ledger.EXPENSE_CATEGORIES)}) THEN 'expense' END AS type_ai, CASE WHEN i AND e THEN 'low' WHEN i OR e OR r THEN 'high' WHEN c IN ({quoted(ledger.INCOME_CATEGORIES + ledger.EXPENSE_CATEGORIES)}) THEN 'medium' ELSE 'low' END AS confidence,
    concat_ws(' ', CASE WHEN i THEN 'keywords_income' END, CASE WHEN e THEN 'keywords_expense' END, CASE WHEN r THEN 'refund_terms' END) AS reason FROM (SELECT id, c, {_any_word('t', ledger.INCOME_WORDS)} AS i, {_any_word('t', ledger.EXPENSE_WORDS)} AS e, {_any_word('t', ledger.REFUND_WORDS)} AS r FROM (SELECT id, lower(category) AS c, {FOLD.format('d')} || ' ' || lower(category) || ' ' AS t
    FROM (SELECT *, CASE WHEN id % 6 = 0 THEN ['Estorno x', 'Venda e multa', 'nada', 'Depósito'][CAST(id % 4 + 1 AS INT)] ELSE description END AS d FROM ledger)))""")
reg("X5_normalize_confidence", lambda v: v.bank().filter("description <> ''").select("id", F.round(T.normalize_confidence(F.col("description")), 6).alias("c")), f"SELECT id, round(least(1.0, 1.2::DOUBLE * len(string_split(n, ' ')) / len(string_split(description, ' '))), 6) AS c FROM (SELECT id, description, {STANDARD} AS n FROM bank_tx WHERE description <> '')")
_secret = lambda: F.create_map(F.lit("api_token"), F.col("event_type"), F.lit("name"), F.col("user_id").cast("string"), F.lit("tax_id"), F.col("user_id").cast("string"))
reg("X28_mask_sensitive", lambda v: v.table("events").select("event_id", F.to_json(workflow.mask_sensitive(_secret())).alias("masked")), """SELECT event_id, '{"api_token":"' || repeat('*', least(length(event_type), 8)) || '","name":"' || user_id || '","tax_id":"0"}' AS masked FROM events""")
reg("X30_event_hash", lambda v: v.table("events").select("event_id", workflow.event_hash(event_type=F.col("event_type"), user_id=F.col("user_id"), action=F.when(F.col("event_id") % 2 == 0, "a|b")).alias("h")), """SELECT event_id, sha256('{' || CASE WHEN event_id % 2 = 0 THEN '"action":"a|b",' ELSE '' END || '"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events""")
reg("X33_convert_currency", lambda v: v.bank().select("id", C.convert_currency(F.col("amount"), F.element_at(F.array(F.lit("4"), F.lit("5"), F.lit("0"), F.lit("0.5")), (F.col("id") % 4 + 1).cast("int")).cast("decimal(18,6)")).cast("double").alias("value")),
    "SELECT id, CASE id % 4 WHEN 0 THEN CAST(round(CAST(amount * 25 AS DECIMAL(28,4)) * 0.01, 2) AS DOUBLE) WHEN 1 THEN CAST(round(CAST(amount * 2 AS DECIMAL(28,3)) * 0.1, 2) AS DOUBLE) WHEN 3 THEN CAST(amount * 2 AS DOUBLE) END AS value FROM bank_tx")
reg("W4_last_n", lambda v: windows.last_n(v.bank(), "date", 5).select("id"), "SELECT id FROM bank_tx ORDER BY date DESC, id DESC LIMIT 5")
reg("W5_top_n_groups", lambda v: windows.top_n_groups(v.recon().filter("is_anomaly"), "anomaly_type", 3), "SELECT anomaly_type, count(*) AS n FROM recon WHERE is_anomaly GROUP BY 1 ORDER BY n DESC, anomaly_type LIMIT 3")

# Reports
_flagged = lambda v: v.bank().withColumns({"is_anomaly": F.col("id") % 4 == 0, "date": F.when((F.weekday("date") >= 5) & (F.col("id") % 3 > 0), F.date_add("date", 2)).otherwise(F.col("date"))})
_FLAGGED = "(SELECT id, ts, amount, category, id % 4 = 0 AS is_anomaly, CASE WHEN isodow(date) >= 6 AND id % 3 > 0 THEN date + 2 ELSE date END AS date FROM bank_tx)"
reg("A8_anomaly_insights", lambda v: reports.anomaly_insights(_flagged(v)), f"""SELECT id, CASE WHEN r = '' THEN '{reports.REASONS[4]}' ELSE r END AS reason, total, share FROM (SELECT id, is_anomaly, total, round(100 * total / n, 1) AS share, concat_ws(' • ', CASE WHEN x - mu > 2 * sd THEN '{reports.REASONS[0]}' WHEN x - mu > 1.5 * sd THEN '{reports.REASONS[1]}' END,
    CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN '{reports.REASONS[2]}' END, CASE WHEN isodow(date) >= 6 AND weekends < 0.2 THEN '{reports.REASONS[3]}' END) AS r FROM (SELECT *, abs(CAST(amount AS DOUBLE)) AS x FROM {_FLAGGED}),
    (SELECT avg(abs(CAST(amount AS DOUBLE))) AS mu, stddev_pop(abs(CAST(amount AS DOUBLE))) AS sd, avg(CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END) AS weekends, count(*) FILTER (is_anomaly) AS total, count(*) AS n FROM {_FLAGGED})) WHERE is_anomaly""")
reg("A9_insight_recommendations", lambda v: reports.insight_recommendations(_flagged(v)), f"SELECT category AS top_category, round(spent, 2) AS top_spent, anomalies, CASE WHEN net < 0 THEN net END AS negative_net FROM (SELECT category, {NEG} AS spent FROM bank_tx GROUP BY 1 ORDER BY spent DESC, category DESC LIMIT 1), (SELECT count(*) FILTER (id % 4 = 0) AS anomalies, {money('sum(amount)')} AS net FROM bank_tx)")
reg("A13_anomaly_stats", lambda v: reports.anomaly_stats(v.recon(), AS_OF), f"""SELECT anomaly_type, anomaly_severity, n, resolved, n - resolved AS pending, round(resolved / n, 4) AS resolution_rate, CASE WHEN g = 3 THEN round(n / records, 4) END AS anomaly_rate, d AS detected_7d, r AS resolved_7d, d - r AS net_7d FROM (SELECT anomaly_type, anomaly_severity, grouping(anomaly_type, anomaly_severity) AS g, count(*) AS records,
    count(*) FILTER (is_anomaly) AS n, count(*) FILTER (is_anomaly AND anomaly_action IS NOT NULL) AS resolved, count(*) FILTER (is_anomaly AND anomaly_detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS d, count(*) FILTER (is_anomaly AND anomaly_reviewed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS r FROM recon GROUP BY GROUPING SETS ((), (anomaly_type), (anomaly_severity))) WHERE g = 3 OR coalesce(anomaly_type, anomaly_severity) IS NOT NULL""")
reg("A18_feedback_learning", lambda v: reports.feedback_learning(v.table("events").select("user_id", case(F.col("event_id") % 3, "confirm", "dismiss", "adjust").alias("kind"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5).alias("confidence"), (F.col("event_id") % 10 / 10).alias("original"), F.when(F.col("event_id") % 3 == 2, F.col("event_id") % 7 / 10).alias("adjusted"))),
    "SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS confirmed, round(coalesce(avg(nullif(event_id % 5, 0)), 0.0), 4) AS mean_confidence, round(avg(CASE WHEN event_id % 3 = 2 THEN (event_id % 7) / 10 - (event_id % 10) / 10 END), 4) AS mean_change FROM events GROUP BY 1")
_STATES = ["completed", "escalated", "rejected", "draft", "completed"]
reg("A20_workflow_analytics", lambda v: reports.workflow_analytics(v.bank().select("id", "bank_name", F.col("bank_name").alias("template"), case(F.col("id") % 5, *_STATES).alias("state"), F.col("ts").alias("started"), (F.col("ts") + F.expr("make_interval(0,0,0,0,0,0,id % 1000)")).alias("ended"))),
    "SELECT bank_name AS template, count(*) AS n, count(*) FILTER (id % 5 IN (0, 4)) AS completed, round(count(*) FILTER (id % 5 = 1) / count(*), 4) AS escalation_rate, round(count(*) FILTER (id % 5 = 2) / count(*), 4) AS rejection_rate, round(avg(CASE WHEN id % 5 IN (0, 4) THEN id % 1000 END), 2) AS mean_seconds FROM bank_tx GROUP BY 1")
_severe = lambda v: v.table("events").withColumns({"severity": case(F.col("event_id") % 4, "low", "high", "critical", "medium"), "violation": F.col("event_id") % 9 == 0})
reg("A21_compliance_report", lambda v: reports.compliance_report(_severe(v), "2024-01-05", "2024-01-20"), "SELECT event_type, user_id, count(*) AS n, count(*) FILTER (event_id % 4 = 2) AS critical, count(*) FILTER (event_id % 4 = 1) AS high, count(*) FILTER (event_id % 9 = 0) AS violations FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY GROUPING SETS ((), (event_type), (user_id))")
_line = lambda c: f"greatest(0.0, CASE WHEN {c}s <= 1e-8 THEN {c}l ELSE {c}b + {c}k * (last + s) END)"
reg("L7_forecast_trend", lambda v: reports.forecast_trend(reports.monthly_series(v.bank()), 6), f"""SELECT strftime(DATE '2024-01-01' + to_months(CAST(last + s AS INTEGER)), '%Y-%m') AS month, round({_line('i')}, 4) AS income, round({_line('e')}, 4) AS expense, round({_line('i')} - {_line('e')}, 4) AS net
    FROM (SELECT max(i) AS last, regr_slope(income, i) AS ik, regr_intercept(income, i) AS ib, stddev(income) AS "is", arg_max(income, i) AS il, regr_slope(expense, i) AS ek, regr_intercept(expense, i) AS eb, stddev(expense) AS es, arg_max(expense, i) AS el FROM (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i FROM ({MONTHS}))), range(1, 7) r(s)""".replace("WHEN is <=", 'WHEN "is" <='))

# Workflow and audit
_steps = lambda v: v.bank().select(F.floor(F.col("id") / 6).alias("record"), (F.col("id") % 6).alias("seq"), adapters.pick(["submit_for_review", "approve_review", "approve_final", "reconcile", "complete", "cancel"], (F.col("id") % 6 + F.when(F.floor(F.col("id") / 6) % 4 == 1, 1).otherwise(0)) % 6).alias("action"),
                                   adapters.pick(["operator", "reviewer", "approver", "operator", "admin", "reviewer"], (F.col("id") % 6 + F.when(F.floor(F.col("id") / 6) % 4 == 2, 1).otherwise(0)) % 6).alias("role"))
_LOGS = "(SELECT id // 6 AS record, id % 6 AS seq, ['submit_for_review', 'approve_review', 'approve_final', 'reconcile', 'complete', 'cancel'][CAST((id % 6 + CASE WHEN (id // 6) % 4 = 1 THEN 1 ELSE 0 END) % 6 + 1 AS INT)] AS action, ['operator', 'reviewer', 'approver', 'operator', 'admin', 'reviewer'][CAST((id % 6 + CASE WHEN (id // 6) % 4 = 2 THEN 1 ELSE 0 END) % 6 + 1 AS INT)] AS role FROM bank_tx)"
reg("G1_replay_workflow", lambda v: workflow.replay_workflow(_steps(v)))
with_views("G1_replay_workflow", f""", l AS {_LOGS}, t AS (SELECT * FROM {_RULES})
""")
SQL["G1_replay_workflow"] = SQL["G1_replay_workflow"].replace("WITH bank_tx", "WITH RECURSIVE bank_tx", 1) + """, walk AS (SELECT record, -1 AS seq, 'draft' AS state, 0 AS applied, 0 AS invalid FROM (SELECT DISTINCT record FROM l) UNION ALL
  SELECT w.record, w.seq + 1, coalesce(t.next_state, w.state), w.applied + (l.action IS NOT NULL AND t.next_state IS NOT NULL)::INT, w.invalid + (l.action IS NOT NULL AND t.next_state IS NULL)::INT FROM walk w LEFT JOIN l ON l.record = w.record AND l.seq = w.seq + 1 LEFT JOIN t ON t.state = w.state AND t.action = l.action AND t.role = l.role WHERE w.seq < 5)
SELECT record, state, applied, invalid FROM walk WHERE seq = 5"""
reg("G1_legacy_state", lambda v: v.recon().select("id", workflow.legacy_state(F.col("status")).alias("state")), "SELECT id, CASE status WHEN 'pending' THEN 'pending_review' WHEN 'confirmed' THEN 'reconciled' ELSE status END AS state FROM recon")
reg("G2_available_actions", lambda v: workflow.available_actions(_log(v)).select("id", F.array_join("actions", ",").alias("actions")), f"SELECT l.id, coalesce(string_agg(DISTINCT t.action, ',' ORDER BY t.action), '') AS actions FROM {LOG} l LEFT JOIN {_RULES} ON l.state = t.state AND l.role = t.role GROUP BY 1")
reg("G3_transition_conditions", lambda v: v.bank().select("id", *[e.alias(k) for k, e in workflow.transition_conditions(case(F.col("id") % 3, "why", "", None), F.col("amount") * 100, case(F.col("id") % 4, 1, 0, None, 2)).items()]),
    "SELECT id, id % 3 = 0 AS has_justification, NOT abs(amount * 100) > 10000 AS high_value, id % 4 IN (0, 3) AS requires_attachment FROM bank_tx")
reg("G4_notifications", lambda v: workflow.notifications(workflow.transition_lookup(_log(v))).select("id", "recipient_role", "template", "priority"), f"""SELECT l.id, n.role AS recipient_role, n.template, CASE WHEN t.next_state IN ('escalated', 'rejected') THEN 'high' ELSE 'normal' END AS priority FROM {LOG} l JOIN {_RULES} ON l.state = t.state AND l.action = t.action AND l.role = t.role
    JOIN (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in workflow.NOTICES)}) n(state, role, template) ON n.state = t.next_state""")
_moves = lambda v: _log(v).withColumns({"record": F.col("id") % 100, "seq": F.col("id")})
reg("G5_workflow_history", lambda v: workflow.workflow_history(_moves(v)).select("record", "id", "state", "next_state", "place"), f"SELECT l.id % 100 AS record, l.id, l.state, t.next_state, CAST(row_number() OVER (PARTITION BY l.id % 100 ORDER BY l.id DESC) AS INTEGER) AS place FROM {LOG} l JOIN {_RULES} ON l.state = t.state AND l.action = t.action AND l.role = t.role")
_open = lambda v: _log(v).withColumns({"amount": F.col("amount") * 1000, "match_score": F.col("id") % 20 / 20, "state": case(F.col("id") % 4, "pending_review", "pending_approval", "escalated", "on_hold")})
_OPENED = "(SELECT id, since, amount * 1000 AS amount, (id % 20) / 20 AS match_score, ['pending_review', 'pending_approval', 'escalated', 'on_hold'][CAST(id % 4 + 1 AS INT)] AS state, (epoch(TIMESTAMP '" + AS_OF + f"') - floor(epoch(since))) / 3600 AS hours FROM {LOG})"
_ESC = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}" for x in r) + ")" for r in workflow.ESCALATIONS) + ") e(rule, trigger, st, h, a, m, level, role)"
_MET = f"{_OPENED} o JOIN {_ESC} ON (e.st IS NULL OR e.st = o.state) AND coalesce((trigger = 'timeout' AND hours >= h) OR (trigger = 'threshold_exceeded' AND abs(amount) >= a) OR (trigger = 'risk_threshold' AND match_score <= m), false)"
reg("J17_rule_application", lambda v: workflow.escalate(_open(v), AS_OF).select("id", "rule", "level", "severity", "target_role"), f"SELECT id, rule, level, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity, role AS target_role FROM {_MET}")
reg("G7_escalate", lambda v: workflow.escalate(_open(v), AS_OF, workflow.escalation_rules(_open(v), v.spark.createDataFrame([("old_hold", "timeout", "on_hold", 100.0, None, None, 4, "admin")], workflow.escalation_rules(_open(v)).schema), ("high_risk_match",))).select("id", "rule", "severity"),
    f"SELECT id, rule, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity FROM {_MET} WHERE rule <> 'high_risk_match' UNION ALL SELECT id, 'old_hold', 'critical' FROM {_OPENED} WHERE state = 'on_hold' AND hours >= 100")
reg("A22_escalation_stats", lambda v: reports.escalation_stats(workflow.escalate(_open(v), AS_OF)), f"SELECT level, trigger, count(*) AS n, count(DISTINCT id) AS items FROM {_MET} GROUP BY GROUPING SETS ((), (level), (trigger))")
_audit = lambda v: v.bank().select((F.col("id") % 500).alias("record"), case(F.col("id") % 3, "create", "approve", "view").alias("action"), (F.floor(F.col("id") / 500) % 7).alias("user_id"), (F.col("amount") * 300).alias("amount"), "ts")
reg("G8_compliance_rules", lambda v: workflow.compliance_rules(_audit(v), AS_OF), f"""SELECT record, len(list_intersect(a, c)) = 0 AS separated, NOT amount > 50000 OR len(a) >= 2 AS two_approvals, len(a) > 0 OR hours < 48 AS in_time FROM (SELECT id % 500 AS record, coalesce(list(DISTINCT (id // 500) % 7) FILTER (id % 3 = 1), []) AS a, coalesce(list(DISTINCT (id // 500) % 7) FILTER (id % 3 = 0), []) AS c, max(abs(amount * 300)) AS amount, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(min(ts)))) / 3600 AS hours FROM bank_tx GROUP BY 1)""")
reg("G9_audit_normalize", lambda v: workflow.audit_rows(v.table("events").select(F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("event_type"), "user_id", F.lit("tx").alias("resource_type"), F.col("event_id").alias("resource_id"), F.lit("edit").alias("action"), F.col("ts").cast("string").alias("ts"),
    F.create_map(F.lit("a"), F.lit("1"), F.lit("token"), F.lit("abc")).alias("old_values"), F.create_map(F.lit("a"), (F.col("event_id") % 2).cast("string"), F.lit("token"), F.lit("abc")).alias("new_values"))).select("resource_id", F.array_join("changed", ",").alias("changed"), F.to_json("new_values").alias("new_values")),
    """SELECT event_id AS resource_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE '' END AS changed, '{"a":"' || event_id % 2 || '","token":"***"}' AS new_values FROM events WHERE event_id % 5 > 0""")
reg("G10_audit_query", lambda v: workflow.audit_query(v.table("events"), kind="error", start="2024-01-10", end="2024-01-12", limit=200).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 200")
_classes = lambda v: v.table("events").select("event_id", case(F.col("event_id") % 4, "user", "system", "security", "other").alias("class"), (F.col("ts") - F.expr("make_interval(0,0,0,cast(event_id % 3000 as int))")).alias("ts"))
reg("G11_retention", lambda v: workflow.retained(_classes(v), AS_OF).select("event_id"), f"SELECT event_id FROM (SELECT event_id, date_diff('day', CAST(ts - to_days(CAST(event_id % 3000 AS INTEGER)) AS DATE), DATE '{AS_OF[:10]}') AS age FROM events) WHERE age <= CASE event_id % 4 WHEN 0 THEN 365 WHEN 1 THEN 90 WHEN 2 THEN 2555 ELSE 1000000 END")
_tasks = lambda v: v.bank().select(F.floor(F.col("id") / 4).alias("workflow"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("step"), F.col("ts").alias("started"), (F.col("id") % 4 * 5000).alias("minutes"), (F.col("id") % 5 > 0).alias("done"), (F.col("id") % 4 < 3).alias("required"))
reg("G12_overdue_steps", lambda v: workflow.overdue_steps(_tasks(v), AS_OF).select("workflow", "step", F.col("late_minutes").cast("long").alias("late_minutes")), f"SELECT id // 4 AS workflow, 's' || id % 4 AS step, CAST(floor(age - id % 4 * 5000) AS BIGINT) AS late_minutes FROM (SELECT id, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 60 AS age FROM bank_tx) WHERE id % 5 = 0 AND age > id % 4 * 5000")
reg("G12_workflow_report", lambda v: workflow.workflow_report(_tasks(v)), "SELECT id // 4 AS workflow, count(*) AS steps, count(*) FILTER (id % 5 > 0) AS done, coalesce(string_agg('s' || id % 4, ',' ORDER BY id % 4) FILTER (id % 5 = 0), '') AS open, bool_and(id % 5 > 0 OR id % 4 = 3) AS complete FROM bank_tx GROUP BY 1")


# Ledgers
def _sheets(v: Views) -> list[DataFrame]:
    e = v.ledger()
    value = F.when(F.col("id") % 4 == 0, F.concat(F.lit("R$ "), F.translate(F.col("amount").cast("string"), ".", ","))).otherwise(F.col("amount").cast("string"))
    cols = [F.date_format("date", "dd/MM/yyyy").alias("Data"), F.when(F.col("id") % 9 == 0, "Saldo do dia").otherwise(F.col("description")).alias("Histórico"), value.alias("Valor (R$)")]
    kind = case(F.col("id") % 6, "despesa", "receita", "juros", "credito", "  ", "nada")
    return [e.filter("id % 2 = 0").select("id", *cols, kind.alias("Tipo"), F.col("cost_center").alias("Centro de Custo")), e.filter("id % 2 = 1").select("id", *cols, kind.alias("Type")), e.select("id", F.lit(1).alias("x"))]


_LEDGER_ROWS = """(SELECT id, CAST(date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount, CASE WHEN trim(k) = '' THEN 'Nao categorizado' ELSE k END AS category, CASE WHEN amount < 0 THEN 'expense' WHEN amount > 0 THEN 'income' WHEN k IN ('receita', 'credito') THEN 'income' ELSE 'expense' END AS transaction_type,
  CASE WHEN k IN ('despesa', 'juros') THEN 'expense' WHEN k IN ('receita', 'credito') THEN 'income' ELSE '' END AS l, CASE WHEN id % 2 = 0 THEN cost_center ELSE '' END AS cost_center FROM (SELECT *, ['despesa', 'receita', 'juros', 'credito', '  ', 'nada'][CAST(id % 6 + 1 AS INT)] AS k FROM ledger) WHERE id % 9 <> 0)"""
reg("S8_ledger_source", lambda v: ledger.ledger_entries(ledger.union_sheets(_sheets(v))).filter("is_valid").select("id", F.col("date").cast("string").alias("date"), "description", "amount", "category", "transaction_type", "type_conflict", "cost_center"),
    f"SELECT id, date, description, amount, category, transaction_type, (amount < 0 AND l = 'income') OR (amount > 0 AND l = 'expense') AS type_conflict, cost_center FROM {_LEDGER_ROWS} WHERE trim(description) <> ''")
reg("S11_union_sheets", lambda v: ledger.union_sheets(_sheets(v)).select("id", "data", "description", "tipo"), "SELECT id, strftime(date, '%d/%m/%Y') AS data, CASE WHEN id % 9 = 0 THEN 'Saldo do dia' ELSE description END AS description, ['despesa', 'receita', 'juros', 'credito', '  ', 'nada'][CAST(id % 6 + 1 AS INT)] AS tipo FROM ledger")
reg("A29_import_quality", lambda v: ledger.import_quality(ledger.ledger_entries(ledger.union_sheets(_sheets(v)))), f"SELECT *, valid_share < 0.5 AS warning FROM (SELECT count(*) AS n, round(avg(CASE WHEN trim(description) <> '' THEN 1.0::DOUBLE ELSE 0 END), 4) AS valid_share FROM {_LEDGER_ROWS})")
_looks = lambda v: v.bank().select(F.col("amount").cast("string").alias("value"), F.date_format("date", "dd/MM/yyyy").alias("day"), F.when(F.col("id") % 3 == 0, "R$ 5%").alias("note"), case(F.col("id") % 2, "sim", "nao").alias("flag"), F.lit(None).cast("string").alias("nothing"))
reg("X32_column_patterns", lambda v: ledger.column_patterns(_looks(v), ["value", "day", "note", "flag", "nothing"]).select("column_name", "n", "missing", "missing_share", "kind", "currency", "percent", "parentheses"),
    """SELECT unnest(['value', 'day', 'note', 'flag', 'nothing']) AS column_name, n, unnest([0, 0, m, 0, n]) AS missing, unnest([0.0, 0.0, round(m / n, 4), 0.0, 1.0]) AS missing_share, unnest(['numeric', 'date', 'text', 'boolean', 'empty']) AS kind, unnest([false, false, true, false, false]) AS currency, unnest([false, false, true, false, false]) AS percent, unnest([false, false, false, false, false]) AS parentheses
    FROM (SELECT count(*) AS n, count(*) FILTER (id % 3 > 0) AS m FROM bank_tx)""")
