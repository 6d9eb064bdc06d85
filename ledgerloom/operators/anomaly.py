"""Analysis of a matched pair's anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import sequence_ratio
from ledgerloom.operators.joins import duplicate_match_join

ITEM = "struct<type:string,severity:string,score:double>"
#: Weights of severities, and pairs of categories that conflict.
WEIGHTS = {"low": 0.3, "medium": 0.6, "high": 0.8, "critical": 1.0}
CONFLICTS = [("alimentacao", "transporte"), ("alimentacao", "vestuario"), ("transporte", "educacao"), ("saude", "lazer"), ("investimento", "saude"), ("salario", "transferencia")]
GENERIC = ("outros", "transferencia", "saque")
#: Advice by type of anomaly, and by overall severity.
ADVICE = {
    "date_discrepancy": "Investigar o motivo da diferença de datas entre os registros",
    "description_mismatch": "Verificar se as descrições se referem à mesma transação, apesar das diferenças",
    "category_conflict": "Revisar a categorização para garantir consistência entre os sistemas",
    "unusual_pattern": "Investigar o padrão incomum para possível fraude ou erro de sistema",
    "duplicate_match": "Verificar se esta não é uma duplicata de outra reconciliação existente",
}
AMOUNT_ADVICE = ("Verificar se há erro de digitação nos valores ou se há múltiplas transações relacionadas", "Confirmar se a diferença de valor é aceitável para o negócio")
SEVERITY_ADVICE = {"critical": "REVISÃO URGENTE: Esta reconciliação requer atenção imediata", "high": "Recomenda-se revisão por supervisor antes da confirmação"}


def item(kind: str, severity, score) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return F.struct(F.lit(kind).alias("type"), as_col(severity).alias("severity"), as_col(score).cast("double").alias("score"))


def amount_mismatch(a: Column, b: Column) -> Column:
    """D1 on amounts: null, or the item of the first band that the relative difference exceeds."""
    x, y = F.abs(a).cast("double"), F.abs(b).cast("double")
    pct = F.abs(x - y) / F.greatest(x, y)
    bands = [(0.5, "critical", 0.95, 1.5), (0.2, "high", 0.8, 2.0), (0.05, "medium", 0.6, 5.0), (0.01, "low", 0.3, 10.0)]
    out = F.when((x == 0) | (y == 0), item("amount_mismatch", "critical", 0.9))
    for over, severity, most, times in bands:
        out = out.when(pct > over, item("amount_mismatch", severity, F.least(F.lit(most), pct * times)))
    return out


def date_discrepancy(a: Column, b: Column) -> Column:
    """D2."""
    days = F.abs(F.datediff(a, b))
    out = F.when(days.isNull(), item("date_discrepancy", "high", 0.8))
    for over, severity, most, per in [(90, "critical", 0.95, 365), (30, "high", 0.8, 120), (7, "medium", 0.6, 60), (3, "low", 0.3, 30)]:
        out = out.when(days > over, item("date_discrepancy", severity, F.least(F.lit(most), days / per)))
    return out


def description_mismatch(a: Column, b: Column) -> Column:
    """D3: missing text, or a low ratio of matching blocks, the less so the more words both have."""
    x, y = F.trim(F.lower(F.coalesce(a, F.lit("")))), F.trim(F.lower(F.coalesce(b, F.lit(""))))
    ratio = sequence_ratio(x, y)
    common = F.size(F.array_intersect(F.split(x, r"\s+"), F.split(y, r"\s+")))
    kind = "description_mismatch"
    return (
        F.when((x == "") | (y == ""), item(kind, "medium", 0.6)).when((ratio < 0.1) & (common == 0), item(kind, "high", 0.8))
        .when((ratio < 0.3) & (common <= 1), item(kind, "medium", 0.6)).when(ratio < 0.5, item(kind, "low", 0.3))
    )


def category_conflict(a: Column, b: Column) -> Column:
    """On lower-cased categories, none being `outros`: listed pairs conflict; else a difference counts where one side is generic."""
    a, b = (F.when(F.coalesce(x, F.lit("")) == "", "outros").otherwise(F.lower(x)) for x in (a, b))
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return F.when(pair.isin(["|".join(sorted(p)) for p in CONFLICTS]), item("category_conflict", "medium", 0.5)).when((a != b) & (a.isin(*GENERIC) | b.isin(*GENERIC)), item("category_conflict", "low", 0.3))


def risk_pattern(entry_amount: Column, bank_type: Column, entry_type: Column, date: Column) -> Column:
    """Size of the ledger entry, type mismatch, weekend and round thousands add up, to 0.9 at most."""
    x = F.abs(entry_amount).cast("double")
    mismatch = ((bank_type != "credit") & (entry_type == "income")) | ((bank_type != "debit") & (entry_type == "expense"))
    when = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = F.when(x > 10_000, 0.3).when(x > 5_000, 0.1).otherwise(0.0) + when(mismatch, 0.4) + when(F.weekday(date) >= 5, 0.2) + when((x > 1000) & (x % 1000 == 0), 0.1)
    return F.when(score > 0, item("unusual_pattern", F.when(score > 0.5, "high").when(score > 0.3, "medium").otherwise("low"), F.least(score, F.lit(0.9))))


def duplicate_match(others: Column) -> Column:
    """Other open records of the same amount within a week."""
    return F.when(F.coalesce(others, F.lit(0)) > 0, item("duplicate_match", "medium", 0.6))


def recommendations(anomalies: Column, severity: Column) -> Column:
    """The distinct advice on each anomaly and on the overall severity, sorted."""
    def advice(x: Column) -> Column:
        said = F.when(x["type"] == "amount_mismatch", F.when(x["severity"].isin("critical", "high"), AMOUNT_ADVICE[0]).otherwise(AMOUNT_ADVICE[1]))
        for kind, words in ADVICE.items():
            said = said.when(x["type"] == kind, words)
        return said

    overall = F.when(severity == "critical", SEVERITY_ADVICE["critical"]).when(severity == "high", SEVERITY_ADVICE["high"])
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(anomalies, advice), F.array(overall)))))


def weight(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), severity)


def analyze(pairs: DataFrame, records: DataFrame | None = None, tx: DataFrame | None = None, b: str = "bank_", e: str = "entry_") -> DataFrame:
    """D7-D13 over enriched pairs: the list of anomalies D1 to D6, the weighted total (1 at most), severity, confidence, review, priority, primary type and advice.

    Severity and priority come from the total before its cap. With records and bank rows, D6 looks for other
    records of the same amount (column `id` names the pair's record); without them, no pair has duplicates.
    """
    c = F.col
    if records is not None:
        pairs = pairs.join(duplicate_match_join(records, tx).select("id", F.col("n").alias("_others")), "id", "left")
    else:
        pairs = pairs.withColumn("_others", F.lit(0))
    found = F.array_compact(F.array(
        amount_mismatch(c(f"{b}amount"), c(f"{e}amount")).cast(ITEM), date_discrepancy(c(f"{b}date"), c(f"{e}date")).cast(ITEM),
        description_mismatch(c(f"{b}description"), c(f"{e}description")).cast(ITEM), category_conflict(c(f"{b}category"), c(f"{e}category")).cast(ITEM),
        risk_pattern(c(f"{e}amount"), c(f"{b}type"), c(f"{e}type"), c(f"{b}date")).cast(ITEM), duplicate_match(c("_others")).cast(ITEM),
    ))
    rows = pairs.withColumn("anomalies", found).drop("_others")
    full = F.round(F.aggregate("anomalies", F.lit(0.0), lambda acc, x: acc + x["score"] * weight(x["severity"])), 6)
    n = F.size("anomalies")
    rows = rows.withColumns({"n_anomalies": n, "_full": full})
    full = F.col("_full")
    overall = F.when((full >= 0.95) | (n >= 3), "critical").when(full >= 0.8, "high").when(full >= 0.6, "medium").otherwise("low")
    rows = rows.withColumn("severity", overall)
    confidence = F.when(n == 0, "high").when((F.col("match_score") > 0.8) & (full > 0.6), "high").when((F.col("match_score") > 0.6) & (full > 0.3), "medium").otherwise("low")
    review = F.col("severity").isin("critical", "high") | (n >= 2) | F.exists("anomalies", lambda x: x["type"].isin("amount_mismatch", "duplicate_match", "compliance_risk"))
    times = F.when(F.col("severity") == "critical", 3.0).when(F.col("severity") == "high", 2.0).when(F.col("severity") == "medium", 1.5).otherwise(1.0)
    primary = F.array_max(F.transform("anomalies", lambda x: F.struct(weight(x["severity"]).alias("w"), x["score"].alias("score"), x["type"].alias("type"))))["type"]
    return rows.withColumns({
        "total": F.least(full, F.lit(1.0)), "confidence": confidence, "review": review, "priority": F.least(F.lit(10.0), full * times * (1 + 0.2 * n)), "primary_type": primary,
        "advice": recommendations(F.col("anomalies"), F.col("severity")),
    }).drop("_full")
