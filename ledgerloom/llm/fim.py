"""Fill-in-middle: cuts at line boundaries, found by a learned rank index of each text's boundary offsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from ledgerloom.llm.common import modest_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A segment's line is never further than this from a boundary; a residual and its sign fit one byte.
BOUND = 100
INDEX = StructType().add("n", LongType()).add("first", ArrayType(LongType())).add("base", ArrayType(LongType())).add("slope", ArrayType(DoubleType())).add("residual", BinaryType())


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets of 0 and of the end of each line, lines being runs up to and with a line feed."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    if len(raw) and raw[-1] != 10:
        ends = np.append(ends, len(raw) - 1)
    if len(raw) != len(text):  # bytes that continue a code point aren't counted
        ends = np.cumsum((raw & 0xC0) != 0x80)[ends] - 1
    return np.concatenate(([0], ends + 1)).astype(np.int64)


def fit_segments(y: np.ndarray, bound: int = BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, offset there, slope) of the segments of a piecewise-linear fit of offsets y over their ranks.

    A segment goes on while some slope through its first point passes all its points within `bound`:
    the cone of such slopes shrinks with each point, and where it closes the next segment begins.
    """
    first, base, slope, at = [], [], [], 0
    while at < len(y):
        low, high, end, step = -np.inf, np.inf, at + 1, 64
        while end < len(y):
            stop = min(len(y), end + step)
            ranks, rise = np.arange(end - at, stop - at), y[end:stop] - y[at]
            lows = np.maximum(np.maximum.accumulate((rise - bound) / ranks), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / ranks), high)
            good = int(np.argmax(lows > highs)) if (lows > highs).any() else len(ranks)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            end, step = end + good, step * 2
            if good < len(ranks):
                break
        first.append(at)
        base.append(int(y[at]))
        slope.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    return np.array(first, dtype=np.int64), np.array(base, dtype=np.int64), np.array(slope)


def residuals(y: np.ndarray, first: np.ndarray, base: np.ndarray, slope: np.ndarray) -> bytes:
    """For each boundary its offset less the index's prediction, plus 128, in one byte."""
    rank = np.arange(len(y))
    seg = np.searchsorted(first, rank, side="right") - 1
    left = y - (base[seg] + np.floor(slope[seg] * (rank - first[seg])).astype(np.int64))
    return (left + 128).astype(np.uint8).tobytes()


@pandas_udf(INDEX)
def line_index(texts: pd.Series) -> pd.DataFrame:
    found = []
    for text in texts:
        y = boundaries(text or "")
        fit = fit_segments(y)
        found.append((len(y) - 1, *fit, residuals(y, *fit)))
    return pd.DataFrame(found, columns=["n", "first", "base", "slope", "residual"])


def cut(index: Column, rank: Column) -> Column:
    """The code-point offset of boundary `rank`: its segment's prediction, corrected by the stored residual."""
    seg = F.size(F.filter(index["first"], lambda f: f <= rank))
    at = lambda field: F.element_at(index[field], seg)
    guess = at("base") + F.floor(at("slope") * (rank - at("first")))
    return guess + F.conv(F.hex(F.substring(index["residual"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long") - 128


def draws(id_: Column, salt: str) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the SHA-256 of salt, colon and id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    after = lambda mark: F.locate(mark, output) + len(mark)
    between = lambda a, b: F.substring(output, after(a), F.locate(b, output) - after(a))
    rest = F.substring(output, after(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, salt: str = "7", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, index) of each row of docs.

    `rate` of 100 texts are cut in three at line boundaries drawn by hashes of the id, `spm_rate` of 100 of those
    in suffix-first form. Each text's index holds the segments fitted to all its boundary offsets and one residual byte a
    boundary; the two cuts are predicted from the segments and corrected by residuals, without a look at the text.
    One pass over the rows, no shuffle: rows go through Python in batches bounded in bytes.

    Null text is empty text: plain, no lines. A text that holds a mark stays plain, so that restored() is exact.
    A null id draws as the empty id; rows that share id and text give equal results, each its own row. Empty
    input: empty result. Other columns of docs are not read.
    """
    modest_batches(docs.sparkSession)
    text, (h1, h2, h3, h4) = F.coalesce(F.col(text_col), F.lit("")), draws(F.col(id_col), salt)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"), line_index(text).alias("index"))
    units = F.col("index.n") + 1
    marked = F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE)
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    one, two = F.col("h1") % units, F.col("h2") % units
    rows = rows.select("doc_id", "t", "index", form.alias("form"), cut(F.col("index"), F.least(one, two)).cast("int").alias("a"), cut(F.col("index"), F.greatest(one, two)).cast("int").alias("b"))
    part = lambda start, size: F.substring(F.col("t"), start + 1, size)
    prefix, middle, suffix = part(F.lit(0), F.col("a")), part(F.col("a"), F.col("b") - F.col("a")), part(F.col("b"), F.length("t"))
    mark = {m: F.lit(m) for m in (PREFIX, SUFFIX, MIDDLE)}
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    cutting = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("index.n").alias("n"), "form", F.when(cutting, F.col("a").cast("long")).alias("prefix_chars"), F.when(cutting, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t")).alias("output"), "index",
    )


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), u AS (
  SELECT *, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(length(t), coalesce(list_sum(list_transform(parts[1:least(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x) + 1)), 0)) AS a,
    least(length(t), coalesce(list_sum(list_transform(parts[1:greatest(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x) + 1)), 0)) AS b FROM u
), o AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] WHEN 'spm' THEN '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] ELSE t END AS output FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
