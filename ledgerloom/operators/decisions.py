"""From matches to records and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import simple_similarity
from ledgerloom.operators.matching import MatchConfig, best_pairs

#: Review actions, long and short, and what they store.
REVIEWS = {"confirm": "confirmed", "confirmed": "confirmed", "dismiss": "dismissed", "dismissed": "dismissed", "escalate": "escalated", "escalated": "escalated", "request_info": "request_info", "mark_for_training": "mark_for_training"}


def existing_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (bank_transaction_id, company_entry_id) with `record_id`, the smallest id of a record of the pair, null for none."""
    known = records.groupBy("bank_transaction_id", "company_entry_id").agg(F.min("id").alias("record_id"))
    return pairs.join(known, ["bank_transaction_id", "company_entry_id"], "left")


def fetch_duplicates(keys: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """All stored rows equal to a key; nulls equal nothing."""
    return stored.join(keys.select(*on).distinct(), on, "left_semi")


def suggestion_reasons(cfg: MatchConfig = MatchConfig()) -> Column:
    """M19 over a scored pair's columns: the score's band first, then amount, date and text."""
    diff, days = F.abs(F.abs("b_amount") - F.abs("e_amount")), F.abs(F.datediff("b_date", "e_date"))
    alike = simple_similarity(F.col("b_description"), F.col("e_description"))
    near = diff <= F.abs("b_amount") * F.lit(cfg.tolerance).cast("decimal(4,2)")
    return F.array_compact(F.array(
        F.when(F.col("score") >= 0.9, "Correspondência excelente").when(F.col("score") >= 0.8, "Correspondência forte").when(F.col("score") >= 0.7, "Correspondência provável"),
        F.when(diff < 0.01, "Valores idênticos").when(near, "Valores muito próximos"),
        F.when(days == 0, "Mesma data").when(days <= 3, "Datas próximas"),
        F.when(alike >= 0.8, "Descrições muito similares").when(alike >= 0.6, "Descrições similares"),
    ))


def score_explanations() -> Column:
    """M13 over a scored pair's columns: a map of amount, date, description, data quality and patterns to texts."""
    diff, days, a = F.abs(F.abs("b_amount") - F.abs("e_amount")), F.abs(F.datediff("b_date", "e_date")), F.abs("b_amount")
    money = F.format_string("%.2f", diff.cast("double"))
    said = lambda head, tail="": F.concat(F.lit(head), money, F.lit(tail))
    amount = F.when(diff < 0.01, "Valores idênticos - correspondência perfeita").when(diff < a * 0.02, said("Valores muito próximos (diferença de R$ ", ")")).when(diff < a * 0.05, said("Valores próximos (diferença de R$ ", ")")).otherwise(said("Diferença significativa de valores (R$ ", ")"))
    d = days.cast("string")
    date = (
        F.when(days == 0, "Mesma data - correspondência perfeita").when(days <= 1, F.concat(F.lit("Diferença de "), d, F.lit(" dia - muito próximo")))
        .when(days <= 3, F.concat(F.lit("Diferença de "), d, F.lit(" dias - aceitável"))).when(days <= 7, F.concat(F.lit("Diferença de "), d, F.lit(" dias - moderada")))
        .otherwise(F.concat(F.lit("Diferença significativa de "), d, F.lit(" dias")))
    )
    bands = lambda c, texts, last: F.coalesce(*[F.when(F.col(c) >= least, text) for least, text in texts], F.lit(last))
    text = bands("text_similarity", [(0.9, "Descrições muito similares ou idênticas"), (0.7, "Descrições similares com boa correspondência"), (0.5, "Descrições parcialmente similares")], "Descrições com baixa similaridade")
    quality = bands("data_quality", [(0.8, "Dados de alta qualidade em ambos os registros"), (0.6, "Dados de boa qualidade"), (0.4, "Dados de qualidade moderada")], "Dados com problemas de qualidade")
    return F.create_map(F.lit("amount"), amount, F.lit("date"), date, F.lit("description"), text, F.lit("data_quality"), quality)


def suggest_matches(bank: DataFrame, entries: DataFrame, records: DataFrame, k: int = 5, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """For each bank row the k best entries without an open record of the pair, with reasons."""
    taken = records.filter(F.col("status").isin("pending", "confirmed")).select(F.col("bank_transaction_id").alias("b_id"), F.col("company_entry_id").alias("e_id"))
    best = best_pairs(bank, entries, k, cfg, ("b_amount", "e_amount", "b_date", "e_date", "b_description", "e_description"), taken=taken)
    return best.select("b_id", "e_id", "rank", "score", suggestion_reasons(cfg).alias("reasons"))


def create_records(matches: DataFrame, records: DataFrame) -> DataFrame:
    """New pending records of valid matches (b_id, e_id, score): both ids, a score from 0 to 1, no record of the pair yet. One row a pair, of its best score."""
    valid = matches.filter("b_id is not null and e_id is not null and score between 0 and 1")
    one = valid.groupBy(F.col("b_id").alias("bank_transaction_id"), F.col("e_id").alias("company_entry_id")).agg(F.max("score").alias("match_score"))
    return one.join(records.select("bank_transaction_id", "company_entry_id"), ["bank_transaction_id", "company_entry_id"], "left_anti").withColumn("status", F.lit("pending"))


def manual_match(requests: DataFrame, tx: DataFrame, entries: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (bank_transaction_id, company_entry_id, confidence, justification) with an outcome: created, existing (with its record) or an error."""
    b = tx.select(F.col("id").alias("bank_transaction_id"), F.lit(True).alias("has_b")).distinct()
    e = entries.select(F.col("id").alias("company_entry_id"), F.lit(True).alias("has_e")).distinct()
    rows = existing_pairs(requests.join(b, "bank_transaction_id", "left").join(e, "company_entry_id", "left"), records)
    bad = F.when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), "confidence out of range").when(F.col("has_b").isNull(), "no such transaction").when(F.col("has_e").isNull(), "no such entry")
    return rows.withColumn("outcome", F.coalesce(bad, F.when(F.col("record_id").isNotNull(), "existing").otherwise("created"))).drop("has_b", "has_e")


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, action confirm or reject) with `outcome` and `new_status`: done, unchanged when it stands so already, or an error.

    Of several decisions on one id the first by `seq` counts, as the later ones meet its result.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    wanted = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "reject", "rejected")
    rows = decisions.withColumn("turn", first).withColumn("wanted", wanted)
    opening = rows.filter("turn = 1").select("id", F.col("wanted").alias("first_wanted"))
    met = rows.join(opening, "id").join(records.select("id", F.col("status").alias("stored")), "id", "left")
    status = F.when(F.col("turn") == 1, F.col("stored")).otherwise(F.when((F.col("stored") == "pending") & F.col("first_wanted").isNotNull(), F.col("first_wanted")).otherwise(F.col("stored")))
    met = met.withColumn("status", status)
    outcome = (
        F.when(F.col("status").isNull(), "not found").when(F.col("wanted").isNull(), "unknown action").when(F.col("status") == F.col("wanted"), "unchanged")
        .when(F.col("status").isin("confirmed", "rejected"), "conflict").otherwise("done")
    )
    return met.withColumn("outcome", outcome).withColumn("new_status", F.when(F.col("outcome") == "done", F.col("wanted")).otherwise(F.col("status"))).select("id", "seq", "action", "outcome", "new_status")


def decision_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes and the share of those done or unchanged."""
    good = F.count(F.when(F.col("outcome").isin("done", "unchanged"), 1))
    return outcomes.agg(F.count("*").alias("n"), good.alias("succeeded"), (F.count("*") - good).alias("failed")).withColumn("success_rate", F.round(F.try_divide("succeeded", "n"), 4))


def adjust_scores(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, new_score) with an outcome; only scores from 0 to 1 of records that are open."""
    rows = changes.join(records.select("id", "status", F.col("match_score").alias("old_score")), "id", "left")
    bad = F.when(~F.col("new_score").between(0, 1) | F.col("new_score").isNull(), "score out of range").when(F.col("status").isNull(), "not found").when(F.col("status").isin("confirmed", "rejected"), "closed")
    return rows.select("id", "old_score", "new_score", F.coalesce(bad, F.lit("adjusted")).alias("outcome"))


def flag_and_resolve(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Anomalies with their latest review (id, action, reviewer, seq): the action in short form, escalation makes severity critical; none leaves pending_review."""
    short = F.create_map(*[F.lit(x) for kv in REVIEWS.items() for x in kv])
    known = reviews.withColumn("action", F.element_at(short, F.col("action"))).filter("action is not null")
    last = known.groupBy("id").agg(F.max_by(F.struct("action", "reviewer"), "seq").alias("r"))
    rows = records.filter("is_anomaly").join(last, "id", "left")
    severity = F.when(F.col("r.action") == "escalated", "critical").otherwise(F.col("anomaly_severity"))
    return rows.select("id", "anomaly_type", severity.alias("severity"), F.coalesce("r.action", F.lit("pending_review")).alias("action"), F.col("r.reviewer").alias("reviewer"))


def propagate_resolution(records: DataFrame, similar: DataFrame, resolved: DataFrame) -> DataFrame:
    """Patches (id, action, from_id) for open anomalies similar to a resolved one: confirmed above a score of 0.8, dismissed below 0.4; of several the smallest from_id."""
    hit = similar.join(resolved.select("id", "action"), "id").select(F.col("id").alias("from_id"), F.col("other_id").alias("id"), "action")
    rows = hit.join(records.filter("is_anomaly and anomaly_action is null").select("id", "anomaly_score"), "id")
    takes = ((F.col("action") == "confirm") & (F.col("anomaly_score") > 0.8)) | ((F.col("action") == "dismiss") & (F.col("anomaly_score") < 0.4))
    return rows.filter(takes).groupBy("id").agg(F.min(F.struct("from_id", "action")).alias("x")).select("id", F.col("x.action").alias("action"), F.col("x.from_id").alias("from_id"))
