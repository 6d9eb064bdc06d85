"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import modest_batches
from ledgerloom.llm.textvec import gram_buckets, letters_only

BITS, SIZES = 14, (1, 2, 3)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def counts_of(text: str) -> np.ndarray:
    return np.bincount(gram_buckets(letters_only(text), SIZES, BITS), minlength=1 << BITS)


def _soft(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _tfidf(index: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(value) * idf[index]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001) -> LanguageModel | None:
    """rows: (language, buckets, counts). FTRL-proximal with L1 and L2; each fifth row is held back to fit the temperature."""
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return None
    df = np.zeros(1 << BITS)
    for _, index, _ in rows:
        df[index] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = [(langs.index(lang), index, _tfidf(index, value, idf)) for lang, index, value in rows if len(index)]
    fit = [x for i, x in enumerate(data) if i % 5] or data
    held = [x for i, x in enumerate(data) if i % 5 == 0]
    z, n = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))

    def proximal(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            y, index, x = fit[i]
            w, b = proximal(z[index], n[index]), proximal(zb, nb)
            p = _soft(x @ w + b)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    weights, bias = proximal(z, n), proximal(zb, nb)
    logits = np.array([x @ weights[index] + bias for _, index, x in held]) if held else np.zeros((0, len(langs)))
    truth = np.array([y for y, _, _ in held], dtype=int)

    def loss(t):
        return -np.log(np.maximum(_soft(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    temperature = min(np.geomspace(0.005, 5, 61), key=loss) if len(truth) else 1.0
    return LanguageModel(langs, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), float(temperature))


def predict(model: LanguageModel | None, text: str | None) -> tuple[str, float]:
    """(language, calibrated probability); ("und", 0.0) without a letter or a model. Ties go to the first language."""
    if model is None or not text:
        return "und", 0.0
    counts = counts_of(text)
    index = np.flatnonzero(counts)
    if not len(index):
        return "und", 0.0
    x = _tfidf(index, counts[index], model.idf)
    p = _soft((x @ model.weights[index] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.langs[best], float(min(1.0, p[best]))


def fit_languages(labelled: DataFrame, per_lang: int = 250, langs: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Train on about `per_lang` ids of each language, chosen by a hash of the id: the documented bound of the sample.

    The `langs` languages with the most rows are learned (ties by name), so that a dirty column can't grow the model.
    An id that has many rows in a language counts once there, by its first text in order.
    Whole texts are counted on the executors; the driver gets the sampled rows' bucket counts only.
    """
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    often = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    counts = {r["lang"]: r["n"] for r in often.collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_lang / n))])

    @pandas_udf("struct<b:array<int>,c:array<int>>")
    def grams(texts: pd.Series) -> pd.DataFrame:
        found = [counts_of(t) for t in texts]
        return pd.DataFrame({"b": [np.flatnonzero(c).astype("int32") for c in found], "c": [c[c > 0].astype("int32") for c in found]})

    chance = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col).cast("string")), F.lit(1_000_000)) / 1e6
    chosen = labelled.filter(chance < F.try_element_at(rate, F.col(lang_col)))
    chosen = chosen.groupBy(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("order")).agg(F.min(text_col).alias("text"))
    chosen = chosen.select("lang", "order", grams(F.col("text")).alias("g"))
    rows = sorted(chosen.collect(), key=lambda r: (r["order"], r["lang"]))
    return train([(r["lang"], np.array(r["g"]["b"], dtype=int), np.array(r["g"]["c"], dtype=float)) for r in rows])


def identify_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score` from the whole text; nothing but the text is looked at.

    `und` with score 0 where the text is null or has no letter, or where there was nothing to learn.
    Each row is judged alone: repeated rows agree, empty input gives an empty result. Columns of docs with
    the new names give way.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("struct<lang_pred:string,score:double>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(shared.value, t) for t in texts], columns=["lang_pred", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "_lang")]
    return docs.select(*names, judged(F.col(text_col)).alias("_lang")).select(*names, "_lang.lang_pred", "_lang.score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # A row without id is never learned from.
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    model = fit_languages(docs.filter(~held))
    return identify_languages(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
