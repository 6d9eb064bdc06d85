"""Files on their way in: the gate (S21), repair and quarantine (S2-S4), the log of uploads (S13), statements as a table function (U4)."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ledgerloom.functions.coerce import LEADS
from ledgerloom.sources import ofx

#: By type of file, extensions, most bytes, and marks of which the first 2048 bytes hold one.
FILE_RULES = {"ofx": (["ofx", "qfx"], 16 << 20, ["<OFX>", "OFXHEADER"]), "xlsx": (["xlsx"], 10 << 20, None)}
HEAD = 2048
LOG = "path string, file_hash string, bank_name string, total_entries long, transactions_count long, duplicate_entries_count long, status string, run string"


def file_gate(files: DataFrame, kind: str) -> DataFrame:
    """Files (path, length, content) with `reason`, null for those that pass: extension, size, then what the head holds.

    Only the head of a file is looked at. Content that is null doesn't pass the last rule.
    """
    extensions, most, marks = FILE_RULES[kind]
    extension = F.lower(F.regexp_extract(F.lower("path"), r"\.([^./]*)$", 1))
    head = F.upper(F.decode(F.substring("content", 1, HEAD), "ISO-8859-1"))
    odd = ~F.coalesce(F.greatest(*[head.contains(m) for m in marks]), F.lit(False)) if marks else F.lit(False)
    reason = F.when(~extension.isin(extensions), "extension").when(F.col("length") > most, "size").when(odd, "content")
    return files.withColumn("reason", reason)


def admitted(files: DataFrame, kind: str = "ofx") -> tuple[DataFrame, DataFrame]:
    """(statements, quarantine) of files (path, length, content): decoded and repaired texts of those that pass the gate and have
    a statement's structure, and (path, reason) of the others. Every file is in one of the two."""
    gated = file_gate(files, kind).withColumn("text", ofx.repair(ofx.decode_fallback(F.col("content"))))
    judged = gated.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(ofx.structure_ok(F.col("text")), F.lit(False)), "structure")))
    return judged.filter("reason is null").select("path", "text"), judged.filter("reason is not null").select("path", "reason")


def upload_log(files: DataFrame, path: str, run: str) -> DataFrame:
    """Append one row per file (path, text) of a run to the log under path, and return the run's rows.

    A file whose SHA-256 the log has is a `duplicate` of which nothing is saved, one that fails the gate is `invalid`, of the rest
    what is new by (account, transaction id) within the run is saved. Of files of a run with equal content the first by path counts.
    """
    spark = files.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    seen = spark.read.schema(LOG).parquet(path).select("file_hash").distinct() if exists else spark.createDataFrame([], "file_hash string")
    hashed = files.withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256))
    firsts = hashed.groupBy("file_hash").agg(F.min("path").alias("first"))
    known = hashed.select("path", "text", "file_hash").join(firsts, "file_hash").join(seen.withColumn("seen", F.lit(True)), "file_hash", "left")
    status = F.when(F.col("seen") | (F.col("path") != F.col("first")), "duplicate").when(~F.coalesce(ofx.structure_ok(F.col("text")), F.lit(False)), "invalid").otherwise("success")
    judged = known.select("path", "text", "file_hash", F.coalesce(status, F.when(F.col("path") != F.col("first"), "duplicate").otherwise("success")).alias("status"))
    rows = ofx.statement_rows(judged.select("path", "text")).join(judged.select("path", "status"), "path")
    news = rows.filter("status = 'success'").groupBy("account_id", "transaction_id").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    saved = news.groupBy("path").agg(F.count("*").alias("saved"))
    total = rows.groupBy("path").agg(F.count("*").alias("total"))
    out = judged.join(total, "path", "left").join(saved, "path", "left").select(
        "path", "file_hash", ofx.identify_bank(F.col("text")).alias("bank_name"), F.coalesce("total", F.lit(0)).alias("total_entries"), F.coalesce("saved", F.lit(0)).alias("transactions_count"),
        (F.coalesce("total", F.lit(0)) - F.coalesce("saved", F.lit(0))).alias("duplicate_entries_count"), "status", F.lit(run).alias("run"))
    out.write.mode("append").parquet(path)
    return spark.read.schema(LOG).parquet(path).filter(F.col("run") == run)


def value(block: str, name: str) -> str | None:
    found = re.search(rf"<{name}>([^<\r\n]*)", block, re.IGNORECASE)
    return (found[1].strip() or None) if found else None


@udtf(returnType="seq int, transaction_id string, timestamp timestamp, amount decimal(18,2), description string, transaction_type string")
class OfxRows:
    """One row per transaction block of a statement's text."""

    def eval(self, text: str):
        upper = (text or "").upper()
        if not (any(m in upper for m in ("OFXHEADER:", "<OFX>", "DATA:OFXSGML", "VERSION:")) and any(m in upper for m in ("<BANKMSGSRSV1>", "<STMTRS>", "<BANKTRANLIST>"))):
            return
        for seq, block in enumerate(re.findall(r"(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|$)", text)):
            posted = re.match(r"\d{14}|\d{8}", value(block, "DTPOSTED") or "")
            try:
                when = datetime.datetime.strptime(posted[0].ljust(14, "0"), "%Y%m%d%H%M%S") if posted else None
            except ValueError:
                when = None
            try:
                amount = Decimal((value(block, "TRNAMT") or "").replace(",", ".")).quantize(Decimal("0.01"))
            except InvalidOperation:
                amount = None
            said = value(block, "MEMO") or value(block, "NAME")
            said = re.sub(rf"^(?:{LEADS})\b(?:\s*[-:–—]\s*)?", "", re.sub(r"\s+", " ", said).strip(), flags=re.IGNORECASE) if said else "Transação sem descrição"
            yield seq, value(block, "FITID"), when, amount, said, "credit" if amount is not None and amount > 0 else "debit"


def register_ofx_rows(spark: SparkSession, name: str = "ofx_rows") -> None:
    """U4: SELECT ... FROM files, LATERAL ofx_rows(files.text): statements as a table function of ad-hoc SQL; statement_rows is the way for many files."""
    spark.udtf.register(name, OfxRows)


