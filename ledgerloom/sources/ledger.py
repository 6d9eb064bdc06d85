"""Tabular ledgers: headers, sheets, typed entries, and what a file looks like."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import coerce
from ledgerloom.functions.text import ACCENTED, PLAIN, default_category, fold_text
from ledgerloom.operators.quality import validate_ledger

#: Other names of a column, in order, by its canonical name.
HEADERS = {
    "data": ["data", "date", "dia"], "description": ["descricao", "description", "histórico", "historico"], "valor": ["valor", "amount", "value"], "category": ["categoria", "category"],
    "cost_center": ["centro de custo", "cost center"], "department": ["departamento", "department"], "project": ["projeto", "project"], "tipo": ["tipo", "type", "transaction type"],
    "observations": ["observações", "observations", "obs"], "monthly_report_value": ["valor para relat mensal", "valor para relatório mensal", "monthly report value"],
}
REQUIRED = ("data", "valor", "description")
#: Words of income, expense and refund, and categories that say a type by themselves; all folded.
INCOME_WORDS = "receita|venda|vendas|recebimento|recebido|deposito|aporte|salario|pro labore|prolabore|reembolso recebido|cashback|juros recebidos"
EXPENSE_WORDS = "tarifa|tarifas|taxa|juros|multa|pagamento|compra|fatura|boleto|pix tarifa|mensalidade|assinatura|debito|saque|cobranca|transferencia enviada"
REFUND_WORDS = "reembolso|estorno|chargeback|reversao"
INCOME_CATEGORIES = ("salario", "receitas", "vendas", "investimento", "aporte")
EXPENSE_CATEGORIES = ("tarifas_bancarias", "impostos", "fornecedores", "marketing", "assinaturas_saas", "contabilidade")


def normalize_header(name: str) -> str:
    """Lower case, no accents, no punctuation, single spaces."""
    plain = name.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", plain)).strip()


def map_headers(names: list[str]) -> dict[str, str]:
    """Each header's canonical name: that of the first group with a name inside the header, or around it; others keep
    their normalised name, and later ones of the same get _1, _2 and so on."""
    found, seen = {}, {}
    for name in names:
        plain = normalize_header(name)
        target = next((k for k, others in HEADERS.items() if any(x in plain or plain in x for x in {normalize_header(o) for o in [*others, k]})), plain)
        seen[target] = seen.get(target, -1) + 1
        found[name] = f"{target}_{seen[target]}" if seen[target] else target
    return found


def canonical(df: DataFrame) -> DataFrame:
    """Df under canonical names."""
    return df.toDF(*map_headers(df.columns).values())


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """The sheets that have date, value and description, under canonical names, as one bag; without any, the first sheet."""
    named = [canonical(s) for s in sheets]
    fit = [s for s in named if len(s.columns) >= 2 and set(REQUIRED) <= set(s.columns)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fit or named[:1])


def ledger_entries(rows: DataFrame) -> DataFrame:
    """Typed entries of text rows under canonical names, with `errors` and `is_valid` (F7); rows that speak of a balance are left out."""
    c = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    label = F.trim(fold_text(F.coalesce(c("tipo"), F.lit(""))))
    amount = coerce.coerce_amount(c("valor"))
    typed = rows.select(
        *[x for x in rows.columns if x not in (*HEADERS, "amount", "date")], coerce.coerce_date(c("data")).alias("date"), coerce.coerce_description(c("description")).alias("description"), amount.alias("amount"),
        default_category(c("tipo")).alias("category"), *[F.coalesce(c(x), F.lit("")).alias(x) for x in ("cost_center", "department", "project", "observations")],
        coerce.entry_type(amount, label).alias("transaction_type"), coerce.label_to_type(label).alias("label_type"), coerce.type_conflict(amount, label).alias("type_conflict"),
    )
    return validate_ledger(typed.filter(~F.lower("description").contains("saldo")))


def import_quality(entries: DataFrame) -> DataFrame:
    """How many entries, the share of valid ones, and whether it is under a half."""
    g = entries.agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_valid").cast("double")), 4).alias("valid_share"))
    return g.withColumn("warning", F.coalesce(F.col("valid_share") < 0.5, F.lit(True)))


def infer_entry_type(description: Column, category: Column, kind: Column) -> dict[str, Column]:
    """Type, confidence and reasons by words of the folded texts, else by the category."""
    fold = lambda x: F.trim(fold_text(F.coalesce(x, F.lit(""))))
    text, cat = F.concat_ws(" ", fold(description), fold(category), fold(kind)), fold(category)
    income, expense, refund = text.rlike(INCOME_WORDS), text.rlike(EXPENSE_WORDS), text.rlike(REFUND_WORDS)
    by_income, by_expense = cat.isin(*INCOME_CATEGORIES), cat.isin(*EXPENSE_CATEGORIES)
    said = income | expense | refund
    return {
        "type_ai": F.when(income, "income").when(expense, "expense").when(~said & by_income, "income").when(~said & by_expense, "expense"),
        "confidence": F.when(income & expense, "low").when(said, "high").when(by_income | by_expense, "medium").otherwise("low"),
        "reason": F.concat_ws(" ", F.when(income, "keywords_income"), F.when(expense, "keywords_expense"), F.when(refund, "refund_terms")),
    }


def column_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, missing and their share, distinct share, the type that over half of its values have, and whether
    currency signs, percents or parentheses occur. One aggregation, turned to long form; distinct counts are approximate."""
    def facts(name: str) -> Column:
        t = F.trim(F.col(name).cast("string"))
        known = F.count(F.when(t != "", 1))
        share = lambda cond: F.try_divide(F.count(F.when((t != "") & cond, 1)), known)
        is_date, is_number = F.coalesce(coerce.coerce_date(t).isNotNull(), F.lit(False)), F.coalesce(coerce.try_number(F.translate(t, ",", ".")).isNotNull(), F.lit(False))
        is_word = F.lower(t).isin("true", "false", "sim", "nao", "não", "yes", "no")
        kind = F.when(known == 0, "empty").when(share(is_date) > 0.5, "date").when(share(is_number) > 0.5, "numeric").when(share(is_word) > 0.5, "boolean").otherwise("text")
        has = lambda p: F.coalesce(F.max(t.rlike(p)), F.lit(False))
        return F.struct(
            F.lit(name).alias("column_name"), F.count("*").alias("n"), (F.count("*") - known).alias("missing"), F.round(F.try_divide(F.count("*") - known, F.count("*")), 4).alias("missing_share"),
            F.round(F.least(F.try_divide(F.approx_count_distinct(t), known), F.lit(1.0)), 1).alias("distinct_share"), kind.alias("kind"), has(r"R\$|[$€£]").alias("currency"), has("%").alias("percent"), has(r"^\(.*\)$").alias("parentheses"),
        )

    return df.agg(F.array(*[facts(c) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: Words in headers that speak for a bank statement or for company data, for balances and for categories.
BANK_HEADERS = ["saldo", "balance", "extrato", "statement", "banco", "bank", "agencia", "agency", "conta", "account", "transacao", "transaction", "credito", "debito", "credit", "debit", "transferencia", "transfer"]
COMPANY_HEADERS = ["categoria", "category", "centro de custo", "cost center", "departamento", "department", "projeto", "project", "tipo", "type", "observacoes", "observations", "relatorio", "report"]
BALANCE_HEADERS = ["saldo", "balance"]
CATEGORY_HEADERS = ["categoria", "tipo", "departamento", "projeto"]


def classify_file(df: DataFrame) -> DataFrame:
    """One row: `Bank Statement`, `Company Financial Data` or `Unknown`, with both scores.

    Each header counts once a side; balances and categories count two more, and amounts of both signs among the first three numeric
    columns one for the bank. A tie is decided by a balance beside two numeric columns, then by categories beside a date. Types of columns and
    signs come from one aggregation each over all rows, not from the first ones.
    """
    names = [c.lower() for c in df.columns]
    hits = lambda words: [c for c in names if any(w in c for w in words)]
    bank, company = len(hits(BANK_HEADERS)) + 2 * bool(hits(BALANCE_HEADERS)), len(hits(COMPANY_HEADERS)) + 2 * bool(hits(CATEGORY_HEADERS))
    kinds = {r.column_name: r.kind for r in column_patterns(df, df.columns).collect()} if df.columns else {}  # one row per column
    numeric, dated = [c for c in df.columns if kinds.get(c) == "numeric"], [c for c in df.columns if kinds.get(c) == "date"]
    value = lambda c: F.translate(F.trim(F.col(c).cast("string")), ",", ".").try_cast("double")
    sign = lambda cond: F.greatest(*[F.max(F.coalesce(cond(value(c)), F.lit(False))) for c in numeric[:3]], F.lit(False))
    signs = df.agg(F.coalesce(sign(lambda x: x > 0) & sign(lambda x: x < 0), F.lit(False)).cast("int").alias("both"))
    scored = signs.select((F.lit(bank) + F.col("both")).alias("bank_score"), F.lit(company).alias("company_score"))
    tie = "Bank Statement" if hits(BALANCE_HEADERS) and len(numeric) >= 2 else "Company Financial Data" if hits(CATEGORY_HEADERS) and dated else "Unknown"
    kind = F.when(F.col("bank_score") > F.col("company_score"), "Bank Statement").when(F.col("company_score") > F.col("bank_score"), "Company Financial Data").otherwise(tie)
    return scored.withColumn("file_type", kind)
