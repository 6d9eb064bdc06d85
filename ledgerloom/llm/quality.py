"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import durable, modest_batches
from ledgerloom.llm.textvec import code_points, gram_buckets

BITS, SIZES = 14, (2, 3)


@dataclass
class QualityModel:
    ratio: np.ndarray  # log target probability over raw probability of each bucket
    least: float  # mean log ratio from which a text counts as target-like


def buckets_of(text: str) -> np.ndarray:
    return gram_buckets(code_points(text), SIZES, BITS)


def log_weight(ratio: np.ndarray, text: str | None) -> tuple[float, int]:
    """Log importance weight of a text, the sum of its n-grams' log ratios, and how many n-grams it has; (0, 0) for none, of which the models say nothing."""
    grams = buckets_of(text or "")
    return float(ratio[grams].sum(dtype=np.float64)), len(grams)


def cut_between(scores: np.ndarray, good: np.ndarray, care: float = 4.0) -> float:
    """The middle of the gap that best splits good from bad, a lost good row weighing `care` times a bad one kept; -inf without both classes."""
    if not len(scores) or good.all() or not good.any():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost, caught = np.concatenate(([0], np.cumsum(g))) / g.sum(), np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    gain = caught - care * lost
    edges = np.concatenate(([s[0] - 1.0], s, [s[-1] + 1.0]))
    gaps = edges[1:] - edges[:-1]
    best = max(range(len(gain)), key=lambda i: (round(gain[i], 9), gaps[i]))
    return float((edges[best] + edges[best + 1]) / 2)


def labelled_sample(labels: DataFrame, rows: int = 4000) -> DataFrame:
    """At most `rows` labelled ids by hash order, one row each, with good = quality 1: the documented bound for fitting."""
    labels = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    return labels.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "good").limit(rows).dropDuplicates(["doc_id"])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 4000, smooth: float = 1.0) -> QualityModel:
    """Raw model from all of docs, target model from sampled good rows; the cut from the same sample.

    Counts are summed in each partition and then by bucket: 16,384 sums reach the driver, whatever the input.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    sample = durable(labelled_sample(labels, rows))
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "good")

    def count(batches):
        raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch["text"], batch["good"], strict=True):
                if text:
                    found = np.bincount(buckets_of(text), minlength=1 << BITS)
                    raw += found
                    if good is True or good == 1:
                        target += found
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used.astype("int32"), "raw": raw[used], "target": target[used]})

    sums = marked.mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return QualityModel(np.zeros(1 << BITS, dtype=np.float32), float("-inf"))
    p, q = (target + smooth) / (target + smooth).sum(), (raw + smooth) / (raw + smooth).sum()
    ratio = np.log(p / q).astype(np.float32)
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "good", quality_weight(docs, ratio).alias("w"))
    seen = seen.select("doc_id", "good", (F.col("w.weight") / F.greatest(F.col("w.grams"), F.lit(1))).alias("mean"))
    seen = seen.groupBy("doc_id", "good").agg(F.min("mean").alias("mean")).toPandas()  # one row per id, so at most `rows`
    return QualityModel(ratio, cut_between(seen["mean"].to_numpy(float), seen["good"].to_numpy(bool)))


def quality_weight(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> Column:
    """struct(weight, grams): the log importance weight of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @pandas_udf("struct<weight:double,grams:long>")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([log_weight(shared.value, t) for t in texts], columns=["weight", "grams"])

    return weigh(F.col(text_col))


def gumbel_key(weight: Column, id_col: str, temperature: float) -> Column:
    """Log weight plus Gumbel noise from a hash of the id: the largest k keys are a sample without replacement by weight."""
    u = (F.pmod(F.xxhash64(F.lit("gumbel"), F.col(id_col).cast("string")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return weight - temperature * F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 2048):
    """(value, rows above it) of the k-th largest of a numeric column; None with fewer than k rows.

    Histograms narrow down to one value: only `bins` counts a round reach the driver, however many rows or ties there are.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while low is not None:
        if low == high:
            return (low, above) if k <= above + keys.filter(F.col(column) == F.lit(low)).count() else None
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = keys.filter((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high))).withColumn("_at", at)
        found = inside.groupBy("_at").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["_at"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        else:
            return None
    return None


@dataclass
class Draw:
    """The k largest (key, then smaller tie), as a comparison with two constants."""

    key: float
    tie: int

    def keeps(self, key: Column, tie: Column) -> Column:
        return (key > F.lit(self.key)) | ((key == F.lit(self.key)) & (tie <= F.lit(self.tie)))


def draw_largest(keys: DataFrame, k: int) -> Draw:
    """The draw of k rows of keys (key, tie), all if there are no more."""
    if k < 1:
        return Draw(float("inf"), -1)
    cut = kth_largest(keys, "key", k)
    if cut is None:
        return Draw(float("-inf"), -1)
    value, above = cut
    last = kth_largest(keys.filter(F.col("key") == F.lit(value)).select((-F.col("tie")).alias("tie")), "tie", k - above)
    return Draw(value, -last[0])


def quality_key(weight: Column, id_col: str, temperature: float) -> tuple[Column, Column]:
    """(Gumbel key, tie) of a log weight and an id."""
    return gumbel_key(weight, id_col, temperature), F.pmod(F.xxhash64(F.lit("tie"), F.col(id_col).cast("string")), F.lit(1 << 52))


def draw_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, temperature: float = 1.0, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, QualityModel, Draw]:
    """A durable table (id, weight, key, tie) of all rows, the model, and the draw of k rows, as resample_quality says."""
    model = fit_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, rows)
    scored = docs.select(F.col(id_col).alias("id"), quality_weight(docs, model.ratio, text_col).alias("w"))
    key, tie = quality_key(F.col("weight"), "id", temperature)
    keys = durable(scored.select("id", "w.weight", "w.grams").select("id", "weight", "grams", key.alias("key"), tie.alias("tie")))
    if share is not None:
        k = round(share * keys.count())
    elif k is None:
        good = keys if model.least == float("-inf") else keys.filter(F.col("weight") >= F.lit(model.least) * F.col("grams"))
        k = good.count()
    return keys, model, draw_largest(keys, k)


def resample_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, temperature: float = 1.0, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `quality_score`, `quality_key` and `quality_kept`: the k rows that Gumbel top-k draws.

    The importance weight of a text is the ratio of its probabilities under the target and the raw
    model; its log is the sum over all n-grams. k is given, or a `share` of all rows, or by default the
    number of rows whose mean log ratio reaches the cut fitted on labelled rows: the estimated number of
    target-like texts. Gumbel noise at temperature 1 makes the k largest keys a draw without replacement
    by weight: noise decides among texts whose weights differ by a few units, as short ones do. Equal keys are
    drawn by a hash of the id. The cut-off comes from histograms, not from sorting all rows in one place.

    Null and empty texts have weight 0, as the models say nothing of them. Rows with the same id and
    text get one decision. Without labelled rows of both classes all rows stay. Empty input: empty result.
    """
    keys, model, draw = draw_quality(docs, labels, k, share, temperature, rows, id_col, text_col)
    names = [c for c in docs.columns if c not in ("quality_score", "quality_key", "quality_kept")]
    # The decision is a comparison with constants, so texts needn't meet the table of keys.
    scored = docs.select(*names, quality_weight(docs, model.ratio, text_col)["weight"].alias("quality_score"))
    key, tie = quality_key(F.col("quality_score"), id_col, temperature)
    return scored.withColumn("quality_key", key).withColumn("quality_kept", draw.keeps(F.col("quality_key"), tie))


def op5_quality_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keys, _, draw = draw_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keys.select(F.col("id").alias("doc_id"), F.col("weight").alias("quality_score"), F.col("key").alias("quality_key"), draw.keeps(F.col("key"), F.col("tie")).alias("kept"))
