"""Bank, ledger and reconciliation tables derived from `events`, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import CATEGORIES, categorize

#: Descriptions by event_id % 12, bank and ledger wording.
BANK_TEXTS = ["PAGAMENTO BOLETO ENERGIA LTDA", "PIX RECEBIDO CLIENTE SILVA", "DARF IMPOSTO FEDERAL", "TARIFA BANCARIA MENSAL", "COMPRA SUPERMERCADO CENTRAL", "TED FORNECEDOR ALFA LTDA", "Salário João e Cia", "", "ASSINATURA SOFTWARE GITHUB", "FRETE TRANSPORTADORA SUL ME", "ALUGUEL LOJA CENTRO", "MULTA JUROS DE MORA"]
LEDGER_TEXTS = ["ENERGIA LTDA BOLETO", "CLIENTE SILVA PIX", "IMPOSTO FEDERAL DARF", "TARIFA MENSAL", "SUPERMERCADO CENTRAL", "FORNECEDOR ALFA LTDA TED", "João salário", "SEM NOTA", "GITHUB ASSINATURA", "TRANSPORTADORA SUL ME", "LOJA CENTRO ALUGUEL", "JUROS DE MORA"]
BANKS = ["caixa", "sicoob", "nubank", "itau", "bradesco", "santander", "bb"]
TYPES = ["amount_mismatch", "date_discrepancy", "description_mismatch", "category_conflict", "duplicate_match"]
SEVERITIES = ["low", "medium", "high", "critical"]


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def bank_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))


def bank_rows(e: DataFrame) -> DataFrame:
    amount = F.when(F.col("event_type").isin("purchase", "error"), -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)")
    rows = e.select(
        F.col("event_id").alias("id"), pick(BANKS, F.col("user_id") % 7).alias("bank_name"), F.concat(F.lit("ACC-"), F.col("user_id").cast("string")).alias("account_id"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("transaction_id"), F.col("ts"), F.date_add(F.to_date("ts"), (F.col("user_id") % 360).cast("int")).alias("date"),
        amount.alias("amount"), pick(BANK_TEXTS, F.col("event_id") % 12).alias("description"),
    )
    return rows.withColumn("transaction_type", F.when(F.col("amount") > 0, "credit").otherwise("debit")).withColumn("category", categorize(F.col("description")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_id") % 3 == 0)
    i = F.col("event_id")
    amount = F.when(F.col("event_type").isin("purchase", "error"), -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)")
    scale = (1000 + (F.floor(i / 3) % 5 - 2) * 5).cast("decimal(6,0)")
    rows = e.select(
        i.alias("id"), F.date_add(F.to_date("ts"), (F.col("user_id") % 360 + F.floor(i / 3) % 5).cast("int")).alias("date"), F.round(amount * scale / 1000, 2).cast("decimal(18,2)").alias("amount"),
        pick(LEDGER_TEXTS, i % 12).alias("description"), F.concat(F.lit("CC"), (i % 4).cast("string")).alias("cost_center"), F.concat(F.lit("D"), (i % 5).cast("string")).alias("department"), F.concat(F.lit("P"), (i % 7).cast("string")).alias("project"),
    )
    return rows.withColumn("transaction_type", F.when(F.col("amount") > 0, "income").otherwise("expense")).withColumn("category", categorize(F.col("description")))


def recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_id") % 2 == 0)
    i = F.col("event_id")
    anomaly, done = i % 7 == 0, i % 28 == 0
    return e.select(
        i.alias("id"), i.alias("bank_transaction_id"), (i - i % 3).alias("company_entry_id"), ((50 + i % 50) / 100).alias("match_score"), pick(["pending", "confirmed", "rejected"], F.floor(i / 2) % 3).alias("status"),
        F.col("ts").alias("created_at"), anomaly.alias("is_anomaly"), F.when(anomaly, pick(TYPES, i % 5)).alias("anomaly_type"), F.when(anomaly, pick(SEVERITIES, F.floor(i / 14) % 4)).alias("anomaly_severity"),
        F.when(anomaly, (i % 100) / 100).alias("anomaly_score"), F.when(anomaly, F.col("ts")).alias("anomaly_detected_at"), F.when(done, F.col("user_id") % 5).alias("anomaly_reviewed_by"),
        F.when(done, F.col("ts") + F.expr("make_interval(0,0,0,0,5,0,0)")).alias("anomaly_reviewed_at"), F.when(done, pick(["confirmed", "dismissed", "escalated"], F.floor(i / 28) % 3)).alias("anomaly_action"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def sql_category(c: str) -> str:
    """X19 in DuckDB's SQL over a column."""
    whens = " ".join("WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words.split("|")) + f" THEN '{name}'" for name, words in CATEGORIES.items())
    return f"CASE {whens} ELSE 'outros' END"


FOLD = "regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g')"

VIEWS = f"""WITH bank_tx AS (SELECT *, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS transaction_type, {sql_category(FOLD.format('description'))} AS category FROM (
  SELECT event_id AS id, {_list(BANKS)}[CAST(user_id % 7 + 1 AS INT)] AS bank_name, 'ACC-' || user_id AS account_id, 'T' || event_id AS transaction_id, ts,
    CAST(ts AS DATE) + CAST(user_id % 360 AS INT) AS date, CAST(CASE WHEN event_type IN ('purchase','error') THEN -value ELSE value END AS DECIMAL(18,2)) AS amount,
    {_list(BANK_TEXTS)}[CAST(event_id % 12 + 1 AS INT)] AS description FROM events)),
ledger AS (SELECT *, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS transaction_type, {sql_category(FOLD.format('description'))} AS category FROM (
  SELECT event_id AS id, CAST(ts AS DATE) + CAST(user_id % 360 + (event_id // 3) % 5 AS INT) AS date,
    CAST(round(CAST(CAST(CASE WHEN event_type IN ('purchase','error') THEN -value ELSE value END AS DECIMAL(18,2)) * (1000 + ((event_id // 3) % 5 - 2) * 5) AS DECIMAL(28,2)) * 0.001, 2) AS DECIMAL(18,2)) AS amount,
    {_list(LEDGER_TEXTS)}[CAST(event_id % 12 + 1 AS INT)] AS description, 'CC' || event_id % 4 AS cost_center, 'D' || event_id % 5 AS department, 'P' || event_id % 7 AS project FROM events WHERE event_id % 3 = 0)),
recon AS (SELECT event_id AS id, event_id AS bank_transaction_id, event_id - event_id % 3 AS company_entry_id, (50 + event_id % 50) / 100 AS match_score,
    ['pending','confirmed','rejected'][CAST((event_id // 2) % 3 + 1 AS INT)] AS status, ts AS created_at, event_id % 7 = 0 AS is_anomaly,
    CASE WHEN event_id % 7 = 0 THEN {_list(TYPES)}[CAST(event_id % 5 + 1 AS INT)] END AS anomaly_type, CASE WHEN event_id % 7 = 0 THEN {_list(SEVERITIES)}[CAST((event_id // 14) % 4 + 1 AS INT)] END AS anomaly_severity,
    CASE WHEN event_id % 7 = 0 THEN (event_id % 100) / 100 END AS anomaly_score, CASE WHEN event_id % 7 = 0 THEN ts END AS anomaly_detected_at, CASE WHEN event_id % 28 = 0 THEN user_id % 5 END AS anomaly_reviewed_by,
    CASE WHEN event_id % 28 = 0 THEN ts + INTERVAL 5 HOUR END AS anomaly_reviewed_at, CASE WHEN event_id % 28 = 0 THEN ['confirmed','dismissed','escalated'][CAST((event_id // 28) % 3 + 1 AS INT)] END AS anomaly_action
  FROM events WHERE event_id % 2 = 0)
"""
