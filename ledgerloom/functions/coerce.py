"""Amount, date, description and type coercion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bank words that clean_description strips once.
LEADS = "TED|DOC|PIX|TRANSF|SAQUE|DEPOSITO|DEPÓSITO|COMPRA"

#: Forms of dates, in order.
DATE_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy.MM.dd")
#: Labels that mean a type, folded; the label with capitals never matches a folded one.
EXPENSE_LABELS = (
    "despesa", "expense", "debito", "retirada socio", "impostos / tributos", "impostos", "tributos", "tarifas bancarias", "Juros/Multa",
    "juros", "multa", "seguro", "emprestimo", "pagamento", "compra", "fatura", "taxa", "tarifa", "saque",
)
INCOME_LABELS = ("reembolso", "receita", "income", "credito", "deposito", "aporte", "venda", "vendas", "recebimento", "salario")


def parse_amount_text(c: Column) -> Column:
    """Unsigned amount of a Brazilian or US text; null where nothing parses."""
    t = F.regexp_replace(c, r"(?i)[R$]|\s+", "")
    last = lambda sep: F.length(t) - F.instr(F.reverse(t), sep)
    both, comma = t.contains(",") & t.contains("."), t.contains(",")
    fixed = (
        F.when(both & (last(",") > last(".")), F.translate(F.translate(t, ".", ""), ",", "."))
        .when(both, F.translate(t, ",", ""))
        .when(comma & t.rlike(r"^[^,]*,[^,]{2}$"), F.translate(t, ",", "."))
        .when(comma, F.translate(t, ",", ""))
        .otherwise(t)
    )
    return F.regexp_replace(fixed, r"[^\d.]", "").try_cast("double")


def coerce_amount(c: Column) -> Column:
    """X11: signed amount; parentheses are negative; null and failures are 0."""
    t = F.regexp_replace(F.trim(c), r"[R$\s]", "")
    fixed = (
        F.when(t.contains(",") & t.contains("."), F.translate(F.translate(t, ".", ""), ",", "."))
        .when(t.rlike(r"^[^,]*,[^,]{0,2}$"), F.translate(t, ",", "."))
        .otherwise(F.translate(t, ",", ""))
    )
    signed = F.when(fixed.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(fixed, r"[()]", ""))).otherwise(fixed)
    return F.coalesce(signed.try_cast("double"), F.lit(0.0))


def parse_date_text(c: Column) -> Column:
    """The first of DD/MM/YYYY, YYYY-MM-DD, DD-MM-YYYY, DD.MM.YYYY in the text that is a valid date."""
    part = lambda p, i: F.regexp_extract(c, p, i)
    tries = []
    for p, (y, m, d) in ((r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1)), (r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"(\d{2})-(\d{2})-(\d{4})", (3, 2, 1)), (r"(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1))):
        tries.append(F.try_to_date(F.concat_ws("-", part(p, y), part(p, m), part(p, d)), "yyyy-MM-dd"))
    return F.coalesce(*tries)


def coerce_date(c: Column) -> Column:
    """The first of DATE_FORMS that gives a date; null where none does. A form is only tried on numbers between its signs, as a failed trial costs an exception."""
    t = F.trim(c)
    shaped = t.rlike(r"^[+-]?\d+([-/.])\d+\1\d+$")
    sign = lambda form: form.strip("yMd")[0]
    return F.when(shaped, F.coalesce(*[F.when(t.contains(sign(f)), F.try_to_date(t, f)) for f in DATE_FORMS]))


def try_number(c: Column) -> Column:
    """c as a double or null, as try_cast gives it, which is only asked where c begins and goes on like a number."""
    return F.when(c.rlike(r"^[\x00-\x20]*[+-]?(?:[0-9.]|(?i:nan|inf))[0-9A-Za-z.+\-\x00-\x20]*$"), c.try_cast("double"))


def coerce_description(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, 500)


def clean_description(c: Column) -> Column:
    """An empty text becomes a fixed one; white space is collapsed and one leading bank word stripped, with a dash or colon behind it."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    dash = r"(?:\s*[-:\u2013\u2014]\s*)?"
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Transação sem descrição")).otherwise(F.regexp_replace(t, rf"(?iu)^(?:{LEADS})\b" + dash, ""))


def clean_transaction(description: Column, amount: Column, date: Column) -> dict[str, Column]:
    """A blank description becomes the fixed text, then X14; text amounts with a decimal comma, failures 0; ISO dates."""
    blank = F.trim(F.coalesce(description, F.lit(""))) == ""
    return {
        "description": clean_description(F.when(blank, F.lit("Transação sem descrição")).otherwise(description)),
        "amount": F.coalesce(F.translate(amount, ",", ".").try_cast("double"), F.lit(0.0)),
        "date": F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd"),
    }


def extract_amounts(c: Column) -> Column:
    """Amounts of Brazilian, then US, then whole-number form, each as X9 reads it; overlapping hits and zeros as they are, but zeros go."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(\d+(?:\.\d{3})*,\d{2})", r"(\d+(?:,\d{3})*\.\d{2})", r"(\d+)")])
    return F.filter(F.transform(found, parse_amount_text), lambda x: x.isNotNull() & (x != 0))


def extract_dates(c: Column) -> Column:
    """ISO texts of all day-first and ISO dates, form by form, with day to 31, month to 12 and year 1900 to 2100."""
    forms = ((r"\d{2}/\d{2}/\d{4}", (7, 4, 1)), (r"\d{4}-\d{2}-\d{2}", (1, 6, 9)), (r"\d{2}-\d{2}-\d{4}", (7, 4, 1)), (r"\d{2}\.\d{2}\.\d{4}", (7, 4, 1)))

    def iso(at: tuple[int, int, int]):
        y, m, d = at
        return lambda x: F.concat_ws("-", F.substring(x, y, 4), F.substring(x, m, 2), F.substring(x, d, 2))

    found = F.concat(*[F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), iso(at)) for p, at in forms])
    part = lambda x, i, n: F.substring(x, i, n).cast("int")
    return F.filter(found, lambda x: part(x, 9, 2).between(1, 31) & part(x, 6, 2).between(1, 12) & part(x, 1, 4).between(1900, 2100))


def label_to_type(folded: Column) -> Column:
    """Expense, income or an empty text by the folded label."""
    return F.when(folded.isin(*EXPENSE_LABELS), "expense").when(folded.isin(*INCOME_LABELS), "income").otherwise("")


def entry_type(amount: Column, folded_label: Column) -> Column:
    """X16 of ledgers: by sign, else by label, else expense."""
    label = label_to_type(folded_label)
    return F.when(amount < 0, "expense").when(amount > 0, "income").when(label != "", label).otherwise("expense")


def type_conflict(amount: Column, folded_label: Column) -> Column:
    """Sign and label both say a type, and not the same."""
    label = label_to_type(folded_label)
    return ((amount < 0) & (label == "income")) | ((amount > 0) & (label == "expense"))


def convert_currency(amount: Column, rate: Column) -> Column:
    """Amount over rate in cents, half up; null where the rate is null or 0."""
    return F.round(amount.cast("decimal(28,6)") / F.when(rate != 0, rate).cast("decimal(18,6)"), 2).cast("decimal(18,2)")


def bank_type(amount: Column) -> Column:
    return F.when(amount > 0, F.lit("credit")).otherwise(F.lit("debit"))


def ledger_type(amount: Column) -> Column:
    return F.when(amount > 0, F.lit("income")).otherwise(F.lit("expense"))
