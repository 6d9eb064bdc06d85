"""Statement files: reading, repairing, gating and writing OFX text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.coerce import bank_type, clean_description
from ledgerloom.functions.similar import bound


def decode_fallback(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1, which never fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def structure_ok(text: Column) -> Column:
    """S3: has a header mark and a statement mark."""
    def marked(t: Column) -> Column:
        has = lambda marks: F.greatest(*[t.contains(m) for m in marks])
        return has(["OFXHEADER:", "<OFX>", "DATA:OFXSGML", "VERSION:"]) & has(["<BANKMSGSRSV1>", "<STMTRS>", "<BANKTRANLIST>"])

    return bound(marked, F.upper(text))


def repair(text: Column) -> Column:
    """Byte order mark and unprintable characters out, a missing end tag (in either case) added."""
    ended = lambda t: F.when(F.upper(t).contains("</OFX>"), t).otherwise(F.concat(t, F.lit("</OFX>")))
    return bound(ended, F.regexp_replace(text, "\ufeff|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))


def tag(block: Column, name: str) -> Column:
    """Value of a tag, closed or not; null where absent or empty."""
    value = F.trim(F.regexp_extract(block, rf"(?i)<{name}>([^<\r\n]*)", 1))
    return F.when(value != "", value)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, decoded and repaired."""
    return spark.read.format("binaryFile").load(path).select("path", repair(decode_fallback(F.col("content"))).alias("text"))


def account_header(statements: DataFrame) -> DataFrame:
    """S6."""
    t = F.col("text")
    return statements.select("path", tag(t, "BANKID").alias("bank_id"), tag(t, "ACCTID").alias("account_id"), tag(t, "ACCTTYPE").alias("account_type"), tag(t, "BALAMT").try_cast("decimal(18,2)").alias("balance"))


def statement_rows(statements: DataFrame) -> DataFrame:
    """One row per transaction block of (path, text); files that fail the gate give none.

    Amounts that don't parse are null, dates take the first 8 or 14 digits, the description is MEMO
    or else NAME, cleaned. Null text gives no rows.
    """
    blocks = F.posexplode(F.regexp_extract_all("text", F.lit("(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|$)"), F.lit(1))).alias("seq", "block")
    rows = statements.filter(structure_ok(F.col("text"))).select("path", tag(F.col("text"), "ACCTID").alias("account_id"), tag(F.col("text"), "BALAMT").try_cast("decimal(18,2)").alias("balance"), blocks)
    b = F.col("block")
    posted = F.regexp_extract(tag(b, "DTPOSTED"), r"^(\d{14}|\d{8})", 1)
    amount = F.regexp_replace(tag(b, "TRNAMT"), ",", ".").try_cast("decimal(18,2)")
    return rows.select(
        "path", "account_id", "seq", tag(b, "FITID").alias("transaction_id"),
        F.coalesce(F.try_to_timestamp(posted, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(posted, F.lit("yyyyMMdd"))).alias("timestamp"),
        amount.alias("amount"), clean_description(F.coalesce(tag(b, "MEMO"), tag(b, "NAME"))).alias("description"), bank_type(amount).alias("transaction_type"), "balance",
    )


def statement_summary(rows: DataFrame) -> DataFrame:
    """Per statement, count, credits, absolute debits and balance."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return rows.groupBy("path").agg(F.count("*").alias("n"), s(F.when(F.col("amount") > 0, F.col("amount"))).alias("credits"), F.abs(s(F.when(F.col("amount") <= 0, F.col("amount")))).alias("debits"), F.max("balance").cast("double").alias("balance"))


def statement_texts(tx: DataFrame) -> DataFrame:
    """(path, text), one OFX statement per account and month, blocks in order of date and id."""
    block = F.concat(F.lit("<STMTTRN><TRNTYPE>"), F.upper("transaction_type"), F.lit("<DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000[-3:BRT]<TRNAMT>"), F.col("amount").cast("string"), F.lit("<FITID>"), F.col("transaction_id"), F.lit("<MEMO>"), F.col("description"), F.lit("</STMTTRN>\n"))
    rows = tx.select("account_id", F.date_format("date", "yyyyMM").alias("month"), F.col("amount").alias("amount"), F.struct("date", "id", block.alias("block")).alias("x"))
    g = rows.groupBy("account_id", "month").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.sum("amount").alias("balance"))  # a statement is one file
    text = F.concat(F.lit("OFXHEADER:100\nDATA:OFXSGML\n<OFX><BANKMSGSRSV1><STMTRS><BANKACCTFROM><BANKID>104<ACCTID>"), F.col("account_id"), F.lit("\n</BANKACCTFROM><BANKTRANLIST>\n"), F.array_join(F.transform("xs", lambda x: x["block"]), ""), F.lit("</BANKTRANLIST><LEDGERBAL><BALAMT>"), F.col("balance").cast("string"), F.lit("</LEDGERBAL></STMTRS></BANKMSGSRSV1></OFX>"))
    return g.select(F.concat_ws("/", "account_id", "month").alias("path"), text.alias("text"))


def skip_seen_files(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """Files (path, text) whose SHA-256 is not in uploads.file_hash."""
    return files.withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256)).join(uploads.select("file_hash"), "file_hash", "left_anti")


#: Marks of banks in order; numbers match anywhere in the text.
BANK_MARKS = {
    "caixa": ["caixa", "cef", "economica", "104"],
    "sicoob": ["sicoob", "sicob", "756"],
    "nubank": ["nubank", "nu bank", "nu pagamentos", "260"],
    "itau": ["itau", "itaú", "banco itau", "341"],
    "bradesco": ["bradesco", "237"],
    "santander": ["santander", "033"],
    "bb": ["banco do brasil", "001"],
}


def identify_bank(text: Column) -> Column:
    """The first bank with a mark in the lower-cased text, else `unknown`; null text is unknown."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.rlike("|".join(marks)), F.lit(bank)) for bank, marks in BANK_MARKS.items()], F.lit("unknown"))
