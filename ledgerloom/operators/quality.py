"""Searches, validation and security scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import default_category


def search_transactions(tx: DataFrame, bank=None, category=None, kind=None, start=None, end=None, text=None) -> DataFrame:
    """AND of the given predicates; text is looked for in description or category, case-insensitively. A null never matches."""
    if start and end and start > end:
        raise ValueError("start is after end")
    out = tx
    for column, value in (("bank_name", bank), ("category", category), ("transaction_type", kind)):
        out = out.filter(F.col(column) == value) if value else out
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    if text:
        out = out.filter(F.lower("description").contains(text.lower()) | F.lower("category").contains(text.lower()))
    return out


def paginate(df: DataFrame, page: int, per_page: int, newest: str = "date") -> DataFrame:
    """one page, newest first, ties by id."""
    if page < 1 or not 1 <= per_page <= 1000:
        raise ValueError("page from 1, per_page from 1 to 1000")
    return df.orderBy(F.col(newest).desc(), "id").offset((page - 1) * per_page).limit(per_page)


def search_ledger(entries: DataFrame, kind=None, category=None, start=None, end=None) -> DataFrame:
    """as F1, on ledger rows; kind `all` is none."""
    rows = search_transactions(entries, category=category, kind=None if kind == "all" else kind, start=start, end=end)
    return rows


def adjusted_flag(note: Column) -> Column:
    """whether the note has more than blanks."""
    return F.length(F.trim(F.coalesce(note, F.lit("")))) > 0


def list_pending(records: DataFrame) -> DataFrame:
    """F15."""
    return records.filter("status = 'pending'")


def list_anomalies(records: DataFrame, severity=None, resolved=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """F16: anomalies, newest first, with `total_count` of all that fit and `has_more` behind the page."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit from 1 to 100, offset from 0")
    rows = records.filter("is_anomaly")
    rows = rows.filter(F.col("anomaly_severity") == severity) if severity else rows
    if resolved is not None:
        rows = rows.filter(F.col("anomaly_action").isNotNull() if resolved else F.col("anomaly_action").isNull())
    total = rows.agg(F.count("*").alias("total_count"))
    page = rows.orderBy(F.col("anomaly_detected_at").desc(), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_count") > offset + limit)


def messages(*rules: tuple[Column, str]) -> Column:
    """the messages of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))


def required(c: Column, name: str) -> tuple[Column, str]:
    return c.isNull() | (c.cast("string") == ""), f"{name} missing"


def text_rules(c: Column, name: str, least: int = 0, most: int | None = None, pattern: str | None = None, allowed: list[str] | None = None) -> list[tuple[Column, str]]:
    """rules on a trimmed text; null breaks none of them."""
    t = F.trim(c)
    rules = [(F.length(t) < least, f"{name} too short")] if least else []
    rules += [(F.length(t) > most, f"{name} too long")] if most is not None else []
    rules += [(~t.rlike(pattern), f"{name} has wrong form")] if pattern else []
    return rules + ([(~t.isin(allowed), f"{name} not allowed")] if allowed else [])


def number_rules(c: Column, name: str, least=None, most=None, decimals: int | None = None) -> list[tuple[Column, str]]:
    """rules on a number or a text of one, in which a comma is a decimal point."""
    n = F.translate(c.cast("string"), ",", ".").try_cast("decimal(38,10)")
    rules = [(c.isNotNull() & n.isNull(), f"{name} is no number")]
    rules += [(n < least, f"{name} too small")] if least is not None else []
    rules += [(n > most, f"{name} too large")] if most is not None else []
    return rules + ([(n != F.round(n, decimals), f"{name} has too many decimals")] if decimals is not None else [])


def date_rules(c: Column, name: str, first: str | None = None, last: str | None = None) -> list[tuple[Column, str]]:
    """rules on a date or a text of one."""
    d = F.try_to_date(c.cast("string"), "yyyy-MM-dd")
    rules = [(c.isNotNull() & d.isNull(), f"{name} is no date")]
    rules += [(d < F.lit(first).cast("date"), f"{name} too early")] if first else []
    return rules + ([(d > F.lit(last).cast("date"), f"{name} too late")] if last else [])


#: Banks known by name, and standard ledger categories.
KNOWN_BANKS = ["caixa", "sicoob", "nubank", "itau", "bradesco", "santander", "bb", "banco do brasil", "unknown"]
STANDARD_CATEGORIES = ["office_supplies", "travel", "meals", "utilities", "rent", "salaries", "taxes", "insurance", "marketing", "equipment", "software", "consulting", "legal", "accounting", "other"]
#: Descriptions to be looked at, lower-cased.
SUSPICIOUS = (r"\b(test|teste|debug)\b", r"\b(hack|exploit|inject)\b", r"^[0-9]+$", r"^[a-z]$", r"(.)\1{10,}")


def validate_transactions(tx: DataFrame, today: str) -> DataFrame:
    """`errors`, `warnings` and `is_valid` of each row: required fields, range, decimals, dates to today, length."""
    amount, date, text = F.col("amount"), F.col("date"), F.col("description")
    errors = messages(
        required(amount, "amount"), required(date, "date"), required(F.trim(F.coalesce(text, F.lit(""))), "description"),
        *number_rules(amount, "amount", -999_999_999, 999_999_999, 2), *date_rules(date, "date", "1900-01-01", today), *text_rules(text, "description", most=500),
    )
    return tx.withColumns({"errors": errors, "warnings": messages((amount == 0, "amount is zero"))}).withColumn("is_valid", F.size("errors") == 0)


def transaction_rules(tx: DataFrame, today: str) -> DataFrame:
    """F8: limits to the cent, dates to 30 days ahead; warnings for large round amounts, suspicious descriptions and unknown banks."""
    amount, text = F.col("amount").cast("decimal(28,6)"), F.lower("description")
    ahead = F.date_add(F.lit(today).cast("date"), 30)
    errors = messages((amount > F.lit("999999999.99").cast("decimal(18,2)"), "amount over limit"), (amount < F.lit("-999999999.99").cast("decimal(18,2)"), "amount under limit"), (F.col("date") < F.lit("1900-01-01").cast("date"), "date too early"), (F.col("date") > ahead, "date too late"))
    odd = reduce(lambda a, b: a | b, [text.rlike(p) for p in SUSPICIOUS])
    warnings = messages(((amount > 100_000) & (amount % 1000 == 0), "large round amount"), (odd, "suspicious description"), ((F.col("bank_name") != "") & ~F.lower("bank_name").isin(KNOWN_BANKS), "unknown bank"))
    return tx.withColumns({"errors": errors, "warnings": warnings}).withColumn("is_valid", F.size("errors") == 0)


def validate_ledger(entries: DataFrame) -> DataFrame:
    """`errors`, `warnings`, `is_valid`; where a required field is missing, nothing else is looked at."""
    c = F.col
    gone = messages(*[(c(x).isNull(), f"{x} missing") for x in ("amount", "date", "description", "transaction_type", "category")])
    rest = messages(
        *number_rules(c("amount"), "amount", decimals=2), *date_rules(c("date"), "date", "1900-01-01"), *text_rules(c("description"), "description", 1, 500),
        *text_rules(c("transaction_type"), "transaction_type", allowed=["income", "expense"]), *text_rules(c("category"), "category", 1, 100),
    )
    warnings = messages(((c("transaction_type") == "expense") & (c("amount") > 0), "positive expense"), ((c("transaction_type") == "income") & (c("amount") < 0), "negative income"))
    found = entries.withColumns({"errors": F.when(F.size(gone) > 0, gone).otherwise(rest), "warnings": F.when(F.size(gone) > 0, F.array().cast("array<string>")).otherwise(warnings)})
    return found.withColumn("is_valid", F.size("errors") == 0)


def ledger_rules(entries: DataFrame) -> DataFrame:
    """F7, and warnings for signs, amounts over a million and categories that are not standard."""
    c = F.col
    known = F.replace(F.lower("category"), F.lit(" "), F.lit("_")).isin(STANDARD_CATEGORIES)
    more = messages(
        ((c("transaction_type") == "expense") & (c("amount") > 0), "expense with positive amount"), ((c("transaction_type") == "income") & (c("amount") < 0), "income with negative amount"),
        (F.abs("amount") > 1_000_000, "unusually large amount"), ((c("category") != "") & ~known, "non-standard category"),
    )
    return validate_ledger(entries).withColumn("warnings", F.concat("warnings", more))


def ingest_corrections(stored: DataFrame, corrected: DataFrame) -> DataFrame:
    """corrected rows with date and description join the stored ones; type, amount and category have defaults."""
    rows = corrected.filter("date is not null and trim(coalesce(description, '')) <> ''")
    kind = F.coalesce(F.when(F.trim("transaction_type") != "", F.trim("transaction_type")), F.lit("expense"))
    rows = rows.withColumns({"transaction_type": kind, "amount": F.coalesce("amount", F.lit(0)), "category": default_category(F.col("category"))})
    return stored.unionByName(rows, allowMissingColumns=True)


def import_status(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """incomplete, duplicate of a stored row, or imported."""
    keys = stored.select(F.col("date").alias("sd"), F.col("amount").alias("sa"), F.col("description").alias("st")).distinct()
    hit = rows.join(keys, (F.col("date") == F.col("sd")) & (F.col("amount") == F.col("sa")) & (F.col("description") == F.col("st")), "left")
    return hit.withColumn("status", F.when(F.col("date").isNull() | (F.trim("description") == ""), "incomplete").when(F.col("sd").isNotNull(), "duplicate").otherwise("imported")).drop("sd", "sa", "st")


#: Marks of cross-site scripting; a dot is any character.
XSS = (
    r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe[^>]*>.*?</iframe>", r"<object[^>]*>.*?</object>", r"<embed[^>]*>.*?</embed>", r"<link[^>]*>",
    r"<meta[^>]*>", r"<style[^>]*>.*?</style>", r"expression\s*\(", r"url\s*\(", r"@import", r"vbscript:", r"data:text/html",
)
#: Whole words, calls, beginnings and other marks of SQL.
SQL_WORDS = "SELECT INSERT UPDATE DELETE DROP CREATE ALTER EXEC UNION SCRIPT HAVING LIMIT OFFSET SYS MYSQL".split()
SQL_CALLS = "EXEC CAST CONVERT CHAR ASCII SUBSTRING LEN LENGTH COUNT SUM AVG MIN MAX LOAD_FILE BENCHMARK SLEEP pg_sleep extractvalue updatexml xmltype".split()
SQL_STARTS = (r"xp_\w+", r"sp_\w+", "INFORMATION_SCHEMA", "PERFORMANCE_SCHEMA", "PG_", "POSTGRES", "SQLITE_", "ORACLE", "MSSQL", "SQLSERVER")
SQL_PHRASES = (
    r"GROUP\s+BY", r"ORDER\s+BY", r"INTO\s+OUTFILE", r"INTO\s+DUMPFILE", r"WAITFOR\s+DELAY", r"dbms_pipe\.receive_message", r"dbms_lock\.sleep", r"UTL_INADDR\.get_host_name",
    r"UTL_HTTP\.request", r"DBMS_XMLQUERY\.newcontext", r"(?:OR|AND)\s+\d+\s*=\s*\d+", r"""(?:OR|AND)\s+['"]?\w+['"]?\s*=\s*['"]?\w+['"]?""",
)
SQL_INJECTION = (rf"\b(?:{'|'.join(SQL_WORDS)})\b", rf"\b(?:{'|'.join(SQL_CALLS)})\s*\(", rf"\b(?:{'|'.join(SQL_STARTS)})", rf"\b(?:{'|'.join(SQL_PHRASES)})", r"--|#|/\*|\*/")
#: Steps out of a folder, plain and encoded.
TRAVERSAL = (r"\.\./", r"\.\.\\", "%2e%2e%2f", "%2e%2e%5c", "%252e%252e%252f", "%252e%252e%255c", r"\.\.%2f", r"\.\.%5c", "%2e%2e/", r"%2e%2e\\", "..%c0%af", "..%c1%9c")
#: Signs and words of shells.
SHELL_WORDS = "cat ls dir type copy move del rm mkdir rmdir cd pwd whoami id ps kill chmod chown su sudo passwd crontab at batch nohup screen tmux".split()
COMMAND = (r"[;&|`$()]", rf"\b(?:{'|'.join(SHELL_WORDS)})\b", r"[<>]", r"\b(?:eval|exec|system|shell_exec|passthru|popen)\b")


def has_any(text: Column, patterns: tuple[str, ...], flags: str = "i") -> Column:
    """Whether a pattern is found. A word ends at all but ASCII letters, digits and underscores, on any Java: what `\b` means there hangs on its version."""
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return F.coalesce(text.rlike(f"(?{flags})" + "|".join(patterns).replace(r"\b", edge)), F.lit(False))


def scan_injection(df: DataFrame, text: Column) -> DataFrame:
    """a flag per class of attack, case-insensitive, over the whole text; null has none."""
    flags = {"has_xss": has_any(text, XSS, "is"), "has_sql": has_any(text, SQL_INJECTION), "has_traversal": has_any(text, TRAVERSAL), "has_command": has_any(text, COMMAND)}
    return df.withColumns(flags)


def scan_urls(df: DataFrame, url: Column, most: int = 2048) -> DataFrame:
    """too_long, and marks of scripting or SQL in the decoded path, or in a decoded query value other than of limit, page and per_page."""
    bad = lambda t: has_any(t, XSS, "is") | has_any(t, SQL_INJECTION)
    decoded = lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    path = decoded(F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x.contains("=") & ~F.lower(F.substring_index(x, "=", 1)).isin("limit", "page", "per_page"))
    values = F.transform(query, lambda x: decoded(F.replace(F.regexp_extract(x, r"=(.*)$", 1), F.lit("+"), F.lit(" "))))
    return df.withColumns({"too_long": F.length(url) > most, "bad_path": bad(path), "bad_query": F.exists(values, bad)})


def sanitize_text(c: Column) -> Column:
    """control characters out, the five markup characters escaped."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


#: Marks of scripts.
SCRIPTS = ("<script", "javascript:", "vbscript:", "onload=", "onerror=", "eval(", "document.", "window.", "alert(", "confirm(")


def scan_scripts(text: Column, first: int | None = None) -> Column:
    """whether the lower-cased text holds a mark of scripts; `first` looks at so many characters only (8192 for files)."""
    t = F.lower(text if first is None else F.substring(text, 1, first))
    return reduce(lambda a, b: a | b, [t.contains(m) for m in SCRIPTS])


def drop_balance_rows(df: DataFrame) -> DataFrame:
    """rows that speak of a balance go."""
    return df.filter(~F.lower("description").contains("saldo"))
