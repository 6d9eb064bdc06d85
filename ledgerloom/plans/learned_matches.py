"""Queries of matching with history, suggestions and predictions, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import context, suggestions
from ledgerloom.plans.adapters import FOLD
from ledgerloom.plans.registry import _ENT, _PAIRS, _RANKED, PREP, _jac, reg
from ledgerloom.plans.rules import _CONTEXT, _ENRICHED, _JUDGED, _LOOK, _MINED, _SUPPLIER_SQL, _context_pairs, _mined, with_views

_BONUS = "b1 * 0.3::DOUBLE + b2 * 0.2::DOUBLE + b3 * 0.1::DOUBLE + b4 * 0.1::DOUBLE + b5 * 0.05::DOUBLE"
_CONS = "CASE WHEN b1 > 0 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN b2 > 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN b3 > 0 THEN 0.2 ELSE 0 END::DOUBLE"
_USED = "CAST((b1 > 0)::INT + (b2 > 0)::INT + (b3 > 0)::INT + (b4 > 0)::INT + (b5 > 0)::INT AS INTEGER)"
_CLASS = "CASE WHEN ba = ea THEN 'exact' WHEN CAST(diff AS DOUBLE) / CAST(greatest(ba, ea) AS DOUBLE) < 0.05 THEN 'close' ELSE 'variable' END"
_WHEN = "CASE WHEN days = 0 THEN 'same_day' WHEN days <= 3 THEN 'few_days' WHEN days <= 7 THEN 'week' ELSE 'extended' END"
_LOOKED = f"(SELECT *, {_LOOK('description', 'texts', 10, 0.3)} AS b1, {_LOOK('supplier', 'supplier', 2, 0.2)} AS b2, {_LOOK('amount', 'ac', 1, 0.2)} AS b3, {_LOOK('date', 'dc', 1, 0.2)} AS b4, {_LOOK('time', chr(39) + 'hour_9' + chr(39), 1, 0.1)} AS b5 FROM (SELECT *, {_CLASS} AS ac, {_WHEN} AS dc, {_SUPPLIER_SQL('bd')} AS supplier FROM f))"
_FULL = (
    _PAIRS.replace("ON abs(b.amount) = abs(e.amount) OR b.date = e.date OR (abs(b.date - e.date) <= 3 AND abs(abs(b.amount) - abs(e.amount)) <= 0.02 * abs(b.amount))", "ON abs(b.date - e.date) <= 30 AND abs(abs(b.amount) - abs(e.amount)) <= 0.02 * greatest(abs(b.amount), abs(e.amount))")
    .replace("f AS (SELECT b_id, e_id, diff, days, ba, ea,", "f AS (SELECT b_id, e_id, diff, days, ba, ea, bd, bn || '||' || en AS texts,")
    .replace("0.7 * least(0.95, base)", "0.7 * least(base + t, 0.95)").replace("0.3 * (0.3 * q + 0.25 * (1.0", f"0.3 * (0.3 * q + 0.25 * ({_CONS}) + 0.25 * (1.0")
    .replace("g AS (SELECT b_id, e_id, diff, days, ba, ea,", f"g AS (SELECT b_id, e_id, diff, days, ba, ea, {_USED} AS patterns_used,").replace("AS score FROM f)", f"AS score FROM (SELECT *, {_BONUS} AS t FROM {_LOOKED}))")
)
_TOP = _RANKED.replace("score, diff,", "score, patterns_used, diff,")
reg("M20_matches_with_history", lambda v: suggestions.find_matches_learned(v.bank(), v.ledger(), _mined(v), 9).select("b_id", "e_id", "rank", "score", "patterns_used", "recommendation", "n_anomalies", F.round("total", 4).alias("total"), "severity", "primary_type"))
_MATCHED = f"""(SELECT b_id * 1000000 + e_id AS id, score AS match_score, b.date AS d, b.transaction_type AS bt, b.description AS bd, e.description AS ed, CAST(b.amount AS DOUBLE) AS a, CAST(e.amount AS DOUBLE) AS c, e.date AS f, lower(b.category) AS bc, lower(e.category) AS ec, e.transaction_type AS et
  FROM top JOIN bank_tx b ON b.id = b_id JOIN ledger e ON e.id = e_id)"""
with_views("M20_matches_with_history", _MINED + _FULL.rstrip() + f""", top AS ({_TOP}), u AS (SELECT NULL::BIGINT AS uid)
    SELECT b_id, e_id, rank, score, patterns_used, CASE WHEN score >= 0.9 THEN 'auto' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.6 THEN 'review' ELSE 'weak' END AS recommendation, n AS n_anomalies, round(least(t, 1.0), 4) AS total, severity, primary_type
    FROM top JOIN {_JUDGED.replace(_ENRICHED, _MATCHED)} ON id = b_id * 1000000 + e_id""")

reg("M22_contextual_suggestions", lambda v: suggestions.contextual_suggestions(v.bank(), v.ledger(), _mined(v), 9).select("b_id", "e_id", "rank", "score", "patterns_used"))
with_views("M22_contextual_suggestions", _MINED + f""", b AS ({PREP.format('bank_tx')}), e AS ({PREP.format('ledger')}),
  tb AS (SELECT description AS bd, any_value(norm) AS bn, any_value(words) AS words, {', '.join(f'any_value({k}) AS {k}' for k in T.ENTITIES)} FROM b GROUP BY 1), te AS (SELECT description AS ed, any_value(norm) AS en, any_value(words) AS words, {', '.join(f'any_value({k}) AS {k}' for k in T.ENTITIES)} FROM e GROUP BY 1),
  tx AS (SELECT bd, ed, bn || '||' || en AS texts, CASE WHEN bn = '' OR en = '' THEN 0.0::DOUBLE WHEN bn = en THEN 1.0 WHEN contains(bn, en) OR contains(en, bn) THEN 0.95 ELSE least(1.0, 0.7::DOUBLE * {_jac('list_distinct(b.words)', 'list_distinct(e.words)')} + 0.3::DOUBLE * {_ENT}) END AS sim FROM tb b, te e),
  f AS (SELECT b.id AS b_id, e.id AS e_id, abs(abs(b.amount) - abs(e.amount)) AS diff, abs(b.amount) AS ba, abs(e.amount) AS ea, abs(b.date - e.date) AS days, bd, texts, sim FROM tx JOIN b ON b.description = bd JOIN e ON e.description = ed WHERE sim > 0.4),
  s AS (SELECT b_id, e_id, round(least(sim + {_BONUS}, 0.95), 6) AS score, {_USED} AS patterns_used FROM {_LOOKED} WHERE least(sim + {_BONUS}, 0.95) > 0.6)
  SELECT b_id, e_id, CAST(row_number() OVER (PARTITION BY b_id ORDER BY score DESC, e_id) AS INTEGER) AS rank, score, patterns_used FROM s QUALIFY rank <= 10""")

# Predictions, entity pairs, users
reg("C10_predict_missing", lambda v: suggestions.predict_missing(v.bank().select("id", "description", F.when(F.col("id") % 50 == 0, F.col("amount") * 1000).otherwise(F.col("amount")).alias("amount")), _mined(v)).select("id", *[F.array_join(c, "|").alias(c) for c in ("suppliers", "payment_methods", "categories")], "amount_pattern", "confidence"))
_ent = lambda k: f"list_sort(list_distinct(regexp_extract_all({FOLD.format('description')}, '{T.ENTITIES[k]}')))"
with_views("C10_predict_missing", _MINED + f""", k AS (SELECT count(DISTINCT type) AS kinds, (SELECT arg_min(pattern, (-count, pattern)) FROM patterns WHERE type = 'amount') AS usual FROM patterns),
  x AS (SELECT id, description <> '' AS told, {_ent('company')}[1:3] AS s, {_ent('payment_method')} AS p, {_ent('tax')} AS t, abs(CASE WHEN id % 50 = 0 THEN amount * 1000 ELSE amount END) AS a FROM bank_tx),
  y AS (SELECT *, list_sort(list_filter([CASE WHEN len(t) > 0 THEN 'taxes' END, CASE WHEN len(t) > 0 THEN 'government_fees' END, CASE WHEN list_contains(p, 'boleto') THEN 'bill_payment' END, CASE WHEN list_contains(p, 'pix') THEN 'instant_payment' END, CASE WHEN len(s) > 0 THEN 'supplier_payment' END, CASE WHEN a > 0 AND a < 100 THEN 'small_expense' WHEN a > 10000 THEN 'large_payment' END], lambda z: z IS NOT NULL))[1:5] AS c FROM x)
  SELECT id, CASE WHEN told THEN array_to_string(s, '|') ELSE '' END AS suppliers, CASE WHEN told THEN array_to_string(p, '|') ELSE '' END AS payment_methods, CASE WHEN told THEN array_to_string(c, '|') ELSE '' END AS categories, CASE WHEN told THEN usual ELSE 'unknown' END AS amount_pattern,
    CASE WHEN told THEN round(CASE WHEN len(s) > 0 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN len(p) > 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN len(c) > 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN kinds > 10 THEN 0.2 WHEN kinds > 5 THEN 0.1 ELSE 0 END::DOUBLE, 6) ELSE 0.0 END AS confidence FROM y, k""")
reg("C4_entity_pair_bonus", lambda v: context.mine_patterns(v.recon().withColumn("status", F.lit("confirmed")), v.bank(), v.ledger(), entities=True).filter("type = 'entity'").select("pattern", "count", F.round("frequency", 9).alias("frequency")))
_of = lambda k, side: f"list_distinct(regexp_extract_all({FOLD.format(side + '.description')}, '{T.ENTITIES[k]}'))"
with_views("C4_entity_pair_bonus", f""", c AS (SELECT r.id, b.description AS bt, e.description AS et, {_of('company', 'b')} AS bc, {_of('company', 'e')} AS ec, {_of('payment_method', 'b')} AS bp, {_of('payment_method', 'e')} AS ep FROM recon r JOIN bank_tx b ON b.id = r.bank_transaction_id JOIN ledger e ON e.id = r.company_entry_id),
  l AS (SELECT DISTINCT id, 'company:' || x || '||' || y AS pattern FROM (SELECT id, x, unnest(ec) AS y FROM (SELECT id, unnest(bc) AS x, ec FROM c)) UNION ALL SELECT DISTINCT id, 'payment_method:' || x || '||' || y FROM (SELECT id, x, unnest(ep) AS y FROM (SELECT id, unnest(bp) AS x, ep FROM c)))
  SELECT pattern, count(*) AS count, round(count(*) / (SELECT count(*) FROM recon), 9) AS frequency FROM l GROUP BY 1 HAVING count(*) > 1 AND count(*) / (SELECT count(*) FROM recon) > 0.01""")
_users = lambda v: v.table("events").select(F.col("user_id")).distinct().filter("user_id % 3 > 0").select("user_id", (F.col("user_id") % 11 / 10).alias("style_bonus"), F.create_map(F.concat(F.lit("hour_"), (F.col("user_id") % 12).cast("string")), F.lit(1.0)).alias("hours"))
reg("C7_user_behavior_bonus", lambda v: context.user_behavior(v.table("events").select("event_id", F.col("user_id").alias("by")), _users(v), "by", 9).select("event_id", F.round("user_bonus", 6).alias("bonus")),
    "SELECT event_id, round(CASE WHEN user_id % 3 > 0 THEN least(0.1::DOUBLE * (user_id % 11) / 10 + CASE WHEN user_id % 12 = 9 THEN 0.05 ELSE 0 END::DOUBLE, 0.15) ELSE 0 END, 6) AS bonus FROM events")
reg("C9_explanation", lambda v: _context_pairs(v).select("id", "explanation"))
_shown = ", ".join(f"CASE WHEN {b} > 0.01 THEN printf('{context.FACTORS[k]}: +%.3f', {b}) END" for k, b in (("description", "b1"), ("supplier", "b2"), ("amount", "b3"), ("date", "b4"), ("time", "b5")))
with_views("C9_explanation", _CONTEXT + f"""SELECT id, CASE WHEN said = '' THEN 'No significant contextual patterns found' ELSE 'Contextual adjustments: ' || said || CASE WHEN t > 0.1 THEN printf(' (Total bonus: +%.3f)', t) ELSE '' END END AS explanation
  FROM (SELECT id, concat_ws('; ', {_shown}) AS said, {_BONUS} AS t FROM bonus)""")
