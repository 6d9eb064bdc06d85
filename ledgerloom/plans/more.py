"""Queries of similarities, generated normalisers, files and stores, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import normalizers, similar
from ledgerloom.functions import text as T
from ledgerloom.operators import stores
from ledgerloom.plans import adapters
from ledgerloom.plans.adapters import FOLD
from ledgerloom.plans.registry import SQL, STANDARD, Views, reg
from ledgerloom.plans.rules import _mined, case, with_views
from ledgerloom.sources import files, ofx

# Similarities: each record's bank text against its ledger text, and against that of another wording
_WORDS = 'SELECT id, a, b, list_distinct(list_filter(string_split(trim(a), \' \'), lambda w: w <> \'\')) AS wa, list_distinct(list_filter(string_split(trim(b), \' \'), lambda w: w <> \'\')) AS wb'


def _texts(v: Views) -> DataFrame:
    """(id, a, b): folded texts; b is a's own with a letter gone, another one's or the ledger's wording."""
    i = F.col("id")
    other = adapters.pick(adapters.LEDGER_TEXTS, (i + F.floor(i / 12) % 3) % 12)
    b = F.when(i % 4 == 0, F.concat(F.substring("description", 1, 4), F.substring("description", 6, 99))).when(i % 4 == 1, F.reverse("description")).otherwise(other)
    return v.bank().select("id", T.fold_text(F.col("description")).alias("a"), T.fold_text(b).alias("b"))


_PAIRED = f"""(SELECT id, {FOLD.format('description')} AS a, {FOLD.format("CASE WHEN id % 4 = 0 THEN description[1:4] || description[6:] WHEN id % 4 = 1 THEN reverse(description) ELSE " + adapters._list(adapters.LEDGER_TEXTS) + "[CAST((id + (id // 12) % 3) % 12 + 1 AS INT)] END")} AS b FROM bank_tx)"""
_near = lambda a, b, r: f"(levenshtein({a}, {b}) <= greatest(length({a}), length({b})) - {r} * (length({a}) + length({b})) / 2 + 1e-9)"
_alike = lambda a, b: f"CASE WHEN length({a}) < 3 OR length({b}) < 3 THEN {a} = {b} ELSE contains({a}, {b}) OR contains({b}, {a}) OR {_near(a, b, 0.7)} END"
_BY_WORDS = f"""CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE greatest(len(list_intersect(wa, wb)) / len(list_distinct(wa || wb)), (len(list_intersect(wa, wb)) + 0.5::DOUBLE *
    len(list_filter(wa, lambda x: NOT list_contains(wb, x) AND len(list_filter(wb, lambda y: NOT list_contains(wa, y) AND {_alike('x', 'y')})) > 0))) / greatest(len(wa), len(wb))) END"""
reg("M15_fuzzy_similarity", lambda v: _texts(v).select("id", F.round(similar.fuzzy_similarity(F.col("a"), F.col("b")), 6).alias("s")))
_TA, _TB = "trim(a)", "trim(b)"
SQL["M15_fuzzy_similarity"] = f"""SELECT id, round(CASE WHEN {_TA} = '' OR {_TB} = '' THEN 0.0::DOUBLE WHEN {_TA} = {_TB} THEN 1.0 WHEN contains({_TA}, {_TB}) OR contains({_TB}, {_TA}) THEN 0.9
    WHEN {_near(_TA, _TB, 0.85)} THEN 2.0::DOUBLE * (greatest(length({_TA}), length({_TB})) - levenshtein({_TA}, {_TB})) / (length({_TA}) + length({_TB})) ELSE {_BY_WORDS} END, 6) AS s FROM ({_WORDS} FROM {_PAIRED})"""
reg("M16_word_similarity", lambda v: _texts(v).select("id", F.round(similar.word_similarity(F.col("a"), F.col("b")), 6).alias("s")))
SQL["M16_word_similarity"] = f"SELECT id, round({_BY_WORDS}, 6) AS s FROM ({_WORDS} FROM {_PAIRED})"
reg("M17_similar_words", lambda v: _texts(v).select("id", F.explode(F.split("a", " ")).alias("x"), "b").select("id", "x", F.explode(F.split("b", " ")).alias("y")).select("id", "x", "y", similar.similar_words(F.col("x"), F.col("y")).alias("similar")))
SQL["M17_similar_words"] = f"SELECT id, x, y, {_alike('x', 'y')} AS similar FROM (SELECT id, x, unnest(string_split(b, ' ')) AS y FROM (SELECT id, unnest(string_split(a, ' ')) AS x, b FROM {_PAIRED}))"
reg("M5_reference_bonus", lambda v: _texts(v).select("id", similar.reference_bonus(F.col("b"), F.col("a"), 0.05).alias("bonus")))
SQL["M5_reference_bonus"] = f"""SELECT id, CASE WHEN {_TA} = '' OR {_TB} = '' THEN 0.0::DOUBLE WHEN contains({_TA}, {_TB}) OR {_near(_TA, _TB, 0.95)} THEN 0.05 WHEN {_near(_TA, _TB, 0.85)} THEN 0.025 ELSE 0.0 END AS bonus FROM {_PAIRED}"""
for _name in ("M15_fuzzy_similarity", "M16_word_similarity", "M17_similar_words", "M5_reference_bonus"):
    SQL[_name] = adapters.VIEWS + SQL[_name]

# Generated normalisers, called from SQL
_MODES = {"strict": {}, "standard": {}, "aggressive": {}, "long_words": {"remove_noise_words": False, "min_word_length": 5, "max_word_length": 7}}


def _generated(v: Views) -> DataFrame:
    for name, options in _MODES.items():
        normalizers.create_normalizer(v.spark, f"normalize_{name}", normalizers.NormalizerConfig(name if name != "long_words" else "standard", **options))
    v.bank().createOrReplaceTempView("bank_texts")
    return v.spark.sql("SELECT id, " + ", ".join(f"normalize_{m}(description) AS {m}" for m in _MODES) + ", array_join(normalize_standard_entities(description)['tax'], '|') AS tax FROM bank_texts")


_tokens = lambda gap: f"string_split(trim(regexp_replace(regexp_replace({FOLD.format('description')}, '[^a-z0-9_\\s]', '{gap}', 'g'), '\\s+', ' ', 'g')), ' ')"
_noise = "[" + ", ".join(f"'{w}'" for w in T.NOISE) + "]"
reg("U3_custom_normalizer", _generated, f"""SELECT id, trim({FOLD.format('description')}) AS strict, {STANDARD} AS standard, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS aggressive,
    array_to_string(list_filter({_tokens(' ')}, lambda x: length(x) BETWEEN 5 AND 7), ' ') AS long_words, array_to_string(list_sort(list_distinct(regexp_extract_all({FOLD.format('description')}, '{T.ENTITIES['tax']}'))), '|') AS tax
    FROM (SELECT *, list_filter({_tokens('')}, lambda x: length(x) >= 2 AND NOT list_contains({_noise}, x)) AS w FROM bank_tx)""")


# Files
def _statements(v: Views) -> DataFrame:
    return ofx.statement_texts(v.bank())


def _by_table_function(v: Views) -> DataFrame:
    files.register_ofx_rows(v.spark)
    _statements(v).createOrReplaceTempView("statements")
    return v.spark.sql("SELECT path, r.transaction_id, CAST(CAST(r.timestamp AS DATE) AS STRING) AS date, CAST(r.amount AS DOUBLE) AS amount, r.description, r.transaction_type FROM statements, LATERAL ofx_rows(statements.text) AS r")


_CLEANED = """CASE WHEN description = '' THEN 'Transação sem descrição' ELSE regexp_replace(trim(regexp_replace(description, '\\s+', ' ', 'g')), '^(TED|DOC|PIX|TRANSF|SAQUE|DEPOSITO|COMPRA)\\b(\\s*[-:]\\s*)?', '', 'i') END"""
reg("U4_ofx_table_function", _by_table_function, f"SELECT account_id || '/' || strftime(date, '%Y%m') AS path, transaction_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, {_CLEANED} AS description, transaction_type FROM bank_tx")


def _odd_files(v: Views) -> DataFrame:
    """A file per page and per statement, some with an odd name, size, head, mark of byte order or missing end."""
    pages = v.table("pages").select(F.concat(F.lit("in/"), F.col("page_id").cast("string"), case(F.col("page_id") % 3, ".ofx", ".OFX", ".html")).alias("path"), F.length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    made = _statements(v).select("path", F.regexp_count("text", F.lit("<STMTTRN>")).alias("k"), "text")
    text = F.when(F.col("k") % 5 == 0, F.regexp_replace("text", "</OFX>", "")).when(F.col("k") % 5 == 1, F.concat(F.lit("﻿"), "text")).when(F.col("k") % 5 == 2, F.concat(F.repeat(F.lit(" "), F.lit(3000)), "text")).when(F.col("k") % 5 == 3, F.regexp_replace("text", "<BANKTRANLIST>|<BANKMSGSRSV1>|<STMTRS>", "")).otherwise(F.col("text"))
    made = made.select(F.concat("path", case(F.col("k") % 7, ".ofx", ".qfx", ".txt", ".ofx", ".ofx", ".Ofx", ".ofx")).alias("path"), F.when(F.col("k") % 11 == 0, 20_000_000).otherwise(F.length(text)).cast("long").alias("length"), text.cast("binary").alias("content"))
    return pages.union(made)


_PER_STATEMENT = """SELECT account_id, account_id || '/' || strftime(date, '%Y%m') AS path, count(*) AS k, sum(amount) AS total FROM bank_tx GROUP BY 1, 2"""
_GATED = f"""(SELECT account_id, k, total, CASE WHEN k % 7 = 2 THEN 'extension' WHEN k % 11 = 0 THEN 'size' WHEN k % 5 = 2 THEN 'content' END AS reason FROM ({_PER_STATEMENT})
    UNION ALL SELECT NULL, 0, 0, CASE WHEN page_id % 3 = 2 THEN 'extension' WHEN NOT (contains(upper(html[1:2048]), '<OFX>') OR contains(upper(html[1:2048]), 'OFXHEADER')) THEN 'content' END FROM pages)"""
reg("S21_file_gate", lambda v: files.file_gate(_odd_files(v), "ofx").groupBy("reason").agg(F.count("*").alias("n")))
reg("S3_quarantine", lambda v: files.admitted(_odd_files(v))[1].groupBy("reason").agg(F.count("*").alias("n")))
reg("S4_repaired_statements", lambda v: ofx.statement_rows(files.admitted(_odd_files(v))[0]).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total")))
SQL["S21_file_gate"] = adapters.VIEWS + f"SELECT reason, count(*) AS n FROM {_GATED} GROUP BY 1"
SQL["S3_quarantine"] = adapters.VIEWS + f"SELECT coalesce(reason, 'structure') AS reason, count(*) AS n FROM {_GATED} WHERE reason IS NOT NULL OR k % 5 = 3 GROUP BY 1"
SQL["S4_repaired_statements"] = adapters.VIEWS + f"SELECT account_id, CAST(sum(k) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total FROM {_GATED} WHERE reason IS NULL AND k % 5 <> 3 AND account_id IS NOT NULL GROUP BY 1"


def _two_runs(v: Views) -> DataFrame:
    """Half of the statements are uploaded, then all."""
    path, made = v.scratch(), _statements(v)
    first = files.upload_log(made.filter("path like '%01' or path like '%03' or path like '%05'"), path, "first")
    second = files.upload_log(made.withColumn("path", F.concat(F.lit("again/"), "path")), path, "second")
    return first.union(second).select("run", "path", "bank_name", "total_entries", "transactions_count", "duplicate_entries_count", "status")


_PER_FILE = "SELECT account_id || '/' || strftime(date, '%Y%m') AS path, count(*) AS n FROM bank_tx GROUP BY 1"
reg("S13_upload_log_sink", _two_runs, f"""SELECT 'first' AS run, path, 'caixa' AS bank_name, n AS total_entries, n AS transactions_count, 0::BIGINT AS duplicate_entries_count, 'success' AS status FROM ({_PER_FILE}) WHERE path[-2:] IN ('01', '03', '05')
    UNION ALL SELECT 'second', 'again/' || path, 'caixa', n, CASE WHEN path[-2:] IN ('01', '03', '05') THEN 0 ELSE n END, CASE WHEN path[-2:] IN ('01', '03', '05') THEN n ELSE 0 END, CASE WHEN path[-2:] IN ('01', '03', '05') THEN 'duplicate' ELSE 'success' END FROM ({_PER_FILE})""")


# Stores
def _stored(v: Views) -> DataFrame:
    path = v.scratch()
    stores.export_patterns(_mined(v), path)
    return stores.import_patterns(v.spark, path).withColumn("frequency", F.round("frequency", 9))


reg("S16_pattern_store", _stored)
SQL["S16_pattern_store"] = SQL["C1_mine_patterns"]
_json = lambda v: v.recon().select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.concat(F.lit('{"score": '), F.col("match_score").cast("string"))).when(F.col("id") % 5 == 3, "[1, 2]").otherwise(F.to_json(F.struct(F.col("match_score").alias("score"), F.col("status").alias("note")))).alias("text"))
reg("S17_json_columns", lambda v: _json(v).select("id", stores.decode_json(F.col("text"), "score double, note string").alias("x")).select("id", "x.score", "x.note", stores.encode_json(F.col("x")).alias("again")),
    """SELECT id, CASE WHEN ok THEN CAST(json_extract_string(t, '$.score') AS DOUBLE) END AS score, CASE WHEN ok THEN json_extract_string(t, '$.note') END AS note, CASE WHEN ok THEN t ELSE '{}' END AS again FROM (SELECT id, t, coalesce(CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' END, false) AS ok FROM (
      SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 1 THEN '{"score": ' || match_score WHEN id % 5 = 3 THEN '[1, 2]' ELSE '{"score":' || match_score || ',"note":"' || status || '"}' END AS t FROM recon))""")
_stale = lambda v: v.bank().withColumn("category", F.when(F.col("id") % 3 == 0, "outros").when(F.col("id") % 5 != 0, F.col("category")))


def _changes(v: Views) -> DataFrame:
    report = stores.category_changes(_stale(v), bank="itau", start="2024-02-01", limit=10_000)
    return report.transitions.crossJoin(F.broadcast(report.summary.select("total", "changed", F.array_join("new_categories", ",").alias("new_categories"))))


_STALE = "(SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'outros' WHEN id % 5 <> 0 THEN category END AS category), category AS ruled FROM bank_tx)"
reg("S18_category_change_report", _changes)
with_views("S18_category_change_report", f""", j AS (SELECT coalesce(category, 'NULL') AS old, ruled AS new FROM {_STALE} WHERE bank_name = 'itau' AND date >= DATE '2024-02-01' ORDER BY date DESC, id LIMIT 10000)
    SELECT old, new, count(*) AS n, (SELECT count(*) FROM j) AS total, (SELECT count(*) FROM j WHERE old <> new) AS changed, (SELECT string_agg(DISTINCT new, ',' ORDER BY new) FROM j WHERE old <> new AND new <> 'outros') AS new_categories FROM j GROUP BY 1, 2""")
reg("S18_applied_changes", lambda v: stores.apply_changes(_stale(v), stores.category_changes(_stale(v), only_outros=True, limit=500)).select("id", "category"))
with_views("S18_applied_changes", f""", j AS (SELECT id AS jid, ruled AS new FROM {_STALE} WHERE category = 'outros' OR category IS NULL ORDER BY date DESC, id LIMIT 500)
    SELECT id, CASE WHEN jid IS NOT NULL AND new <> coalesce(category, 'NULL') THEN new ELSE category END AS category FROM {_STALE} LEFT JOIN j ON jid = id""")
