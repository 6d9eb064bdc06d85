"""Learned operators: outliers by isolation (L1), a categoriser trained on labelled rows (L2-L5), batches of categories."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ledgerloom.functions import text as T
from ledgerloom.operators.reports import quantiles
from ledgerloom.operators.tables import written

#: Categories that clusters without a rule are given, in order.
CLUSTER_CATEGORIES = [
    "impostos", "fornecedores", "contabilidade", "marketing", "logistica", "ti", "assinaturas_saas", "tarifas_bancarias", "manutencao", "juridico", "seguros",
    "equipamentos", "escritorio", "limpeza", "folha_pagamento", "alimentacao", "transporte", "servicos", "saude", "lazer", "vestuario", "educacao", "investimento", "transferencia", "saque",
]
#: Rows that training needs, before and after those without a usable description are left out.
LEAST_ROWS, LEAST_VALID = 10, 5
#: A label domain larger than this is no set of categories, and isn't taken to the driver.
MOST_LABELS = 1_000


def usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    more = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))


@dataclass(frozen=True)
class IsolationForest:
    """Trees in heap order: node i's children are 2i+1 (value <= cut) and 2i+2; `feature` is -1 at leaves, which hold the path length."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path) of each row: near 1 for rows that few cuts isolate."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / max(float(usual_path(self.sample)), 1e-12))

    @property
    def depth(self) -> int:
        return int(math.log2(self.feature.shape[1] + 1)) - 1


def grow_forest(pool: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
    """Each tree cuts its own `sample` rows of the pool at random features and values until they are alone, or log2(sample) deep."""
    sample = min(sample, len(pool))
    depth = math.ceil(math.log2(max(2, sample)))
    size = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        todo = [(0, 0, pool[rng.choice(len(pool), sample, replace=False)])]
        while todo:
            node, level, rows = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            varied = np.flatnonzero(high > low)
            if level == depth or len(rows) <= 1 or not len(varied):
                length[t, node] = level + float(usual_path(len(rows)))
                continue
            f = feature[t, node] = rng.choice(varied)
            cut[t, node] = rng.uniform(low[f], high[f])
            left = rows[:, f] <= cut[t, node]
            todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return IsolationForest(feature, cut, length, sample)


def outlier_features(amount: Column, date: Column, ts: Column) -> list[Column]:
    """Size of the amount, weekday (Monday 0), hour; 0 where unknown."""
    return [F.coalesce(F.abs(amount).cast("double"), F.lit(0.0)), F.coalesce(F.weekday(date), F.lit(0)).cast("double"), F.coalesce(F.hour(ts), F.lit(0)).cast("double")]


def isolation_outliers(rows: DataFrame, key: str = "id", trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42, least: int = 10) -> DataFrame:
    """L1: rows (amount, date, ts) with outlier_score and is_anomaly, true for scores over the exact (1 - contamination) quantile of all rows.

    The trees learn from at most trees * sample rows, those of smallest seeded hash of the key: a bounded sample that
    doesn't depend on how the table is partitioned, so reruns agree. Trees are broadcast (some MB, whatever the input);
    rows are scored where they stand, written once, and the quantile is counted without ordering all rows.
    Under `least` rows nothing is flagged (score null). Equal rows score alike, so ties at the cut are flagged together or not at all.
    """
    total = rows.count()
    if total < least:
        return rows.withColumn("outlier_score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    features, draw = outlier_features(F.col("amount"), F.col("date"), F.col("ts")), F.xxhash64(F.lit(seed), F.col(key))
    most = trees * sample
    narrow = rows.select(draw.alias("draw"), *[f.alias(f"f{i}") for i, f in enumerate(features)])
    share = 2.0 * most / total  # twice as many as are wanted pass; which of them are taken, their order says
    if share < 1:
        narrow = narrow.filter(F.col("draw") < int((share - 0.5) * 2**64))
    pool = narrow.orderBy("draw", "f0", "f1", "f2").limit(most).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(grow_forest(pool[["f0", "f1", "f2"]].to_numpy(), trees, sample, seed))

    @pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack([a, b, c], axis=1)))

    scored = written(rows.withColumn("outlier_score", F.round(score(*features), 9)))
    cut = quantiles(scored, "outlier_score", [1 - contamination], digits=9)[0]
    return scored.withColumn("is_anomaly", F.col("outlier_score") > F.lit(cut + 5e-10))


@dataclass
class Categorizer:
    """A trained categoriser: `labels` in the order of predicted numbers, or clusters where there was one category only."""

    labels: list[str]
    algorithm: str
    features: PipelineModel
    classifier: object | None
    metrics: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame, description: str) -> DataFrame:
        """rows with `predicted`, the number of a label or cluster."""
        told = self.features.transform(rows.withColumn("_text", F.trim(F.coalesce(F.col(description), F.lit("")))))
        if self.classifier is None:
            found = told.withColumn("predicted", F.lit(0))
        else:
            found = self.classifier.transform(told).withColumn("predicted", F.col("_predicted").cast("int"))
        return found.select(*rows.columns, "predicted")


def text_features(texts: DataFrame, rows: int) -> PipelineModel:
    """TF-IDF of words of two or more characters, of length 1, over texts (_text, weight) where each stands for `weight` of all `rows`.

    The vocabulary is at most min(5000, max(500, 5 * rows)) words, the most frequent of those in 95 % of the rows or fewer.
    """
    tokens = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"(?U)\b\w\w+\b", gaps=False)
    words = tokens.transform(texts).select("weight", F.explode(F.array_distinct("_tokens")).alias("w"), "_tokens")
    words = words.groupBy("w").agg(F.sum("weight").alias("df"), F.sum(F.col("weight") * F.size(F.filter("_tokens", lambda t: t == F.col("w")))).alias("tf"))
    known = words.filter(F.col("df") <= 0.95 * rows).orderBy(F.desc("tf"), "w").limit(min(5000, max(500, 5 * rows))).collect()
    known = known or words.orderBy("w").limit(1).collect()  # each word is in nearly all rows
    counts = CountVectorizerModel.from_vocabulary([r.w for r in known] or [""], inputCol="_tokens", outputCol="_counts")
    weigh = ElementwiseProduct(inputCol="_counts", outputCol="_weighed", scalingVec=Vectors.dense([math.log((1 + rows) / (1 + r.df)) + 1 for r in known] or [1.0]))
    return PipelineModel([tokens, counts, weigh, Normalizer(inputCol="_weighed", outputCol="_features")])


def train_categorizer(rows: DataFrame, key: str = "id", description: str = "description", category: str = "category", seed: int = 42) -> Categorizer:
    """L2: learn categories from described rows, or clusters where there is one category or few rows.

    Rows with a description of three characters or more count; a category that is null or empty is `outros`. Rows are
    grouped by (description, category) first, so training handles each different text once, with a weight. A fifth of the rows
    (15 % of under 30) are held out by a seeded hash of the key and give the metrics. Labels are at most MOST_LABELS.
    Raises ValueError under 10 rows, or under 5 that count.
    """
    if (given := rows.limit(LEAST_ROWS).count()) < LEAST_ROWS:
        raise ValueError(f"training needs {LEAST_ROWS} rows, there are {given}")
    label = F.when(F.coalesce(F.col(category), F.lit("")) == "", "outros").otherwise(F.col(category))
    valid = rows.select(F.trim(F.col(description)).alias("_text"), label.alias("label"), F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)).alias("draw")).filter(F.length("_text") >= 3)
    total = valid.count()
    if total < LEAST_VALID:
        raise ValueError(f"training needs {LEAST_VALID} rows with a description, there are {total}")
    held = F.col("draw") < (200_000 if total >= 30 else 150_000)
    groups = written(valid.groupBy("_text", "label", held.alias("held")).agg(F.count("*").cast("double").alias("weight")))
    labels = sorted(r[0] for r in groups.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} categories")
    features = text_features(groups.groupBy("_text").agg(F.sum("weight").alias("weight")), total)
    if len(labels) >= 2 and total >= 10:
        train = groups.filter("not held")
        seen = sorted(r[0] for r in train.select("label").distinct().collect())
        if len(seen) < 2:
            train, seen = groups, labels
        number = F.array_position(F.array(*map(F.lit, seen)), F.col("label")) - 1
        # Texts are few once grouped; small partitions would make each of the many steps of training a job of many tiny tasks.
        parts = 1 + groups.count() // 20_000
        told = features.transform(train.withColumn("y", number.cast("double"))).select("_features", "y", "weight").coalesce(parts).cache()
        svm = LinearSVC(maxIter=50, regParam=1.0 / total)
        classifier = OneVsRest(classifier=svm, featuresCol="_features", labelCol="y", weightCol="weight", predictionCol="_predicted", parallelism=4).fit(told)
        told.unpersist()
        model = Categorizer(seen, "LinearSVC", features, classifier)
        judged = model.predict(groups.filter("held"), "_text").withColumn("guess", F.element_at(F.array(*map(F.lit, seen)), F.col("predicted") + 1))
    else:
        k = max(1, min(10, len(labels), total // 2))
        told = features.transform(groups).select("_features", "weight")
        classifier = KMeans(k=k, seed=seed, featuresCol="_features", weightCol="weight", predictionCol="_predicted").fit(told) if k > 1 else None
        model = Categorizer(labels, "KMeans", features, classifier)
        judged = majority_labels(model.predict(groups, "_text"), "predicted", "label", "weight")
    found = evaluate_model(judged, "guess", "label", "weight").collect()
    model.metrics = {"rows": total, "validation_rows": int(sum(r.n for r in found)), "accuracy": found[0].accuracy if found else None, "precision": {r.category: r.precision for r in found}, "per_category": {r.category: r.hit_rate for r in found}}
    return model


def majority_labels(rows: DataFrame, cluster: str, label: str, weight: str | None = None) -> DataFrame:
    """rows with `guess`: the label most frequent in the row's cluster, of equally frequent ones the first by name.

    Counts are combined before the shuffle, and a cluster's label is joined by broadcast where Spark finds the
    table of clusters small, as it is one row per cluster.
    """
    w = F.col(weight) if weight else F.lit(1)
    counts = rows.groupBy(F.col(cluster).alias("_cluster"), F.col(label).alias("_label")).agg(F.sum(w).alias("_n"))
    best = counts.groupBy("_cluster").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("label"))).alias("_best"))
    return rows.join(best, F.col(cluster).eqNullSafe(F.col("_cluster"))).withColumn("guess", F.col("_best.label")).drop("_cluster", "_best")


def evaluate_model(rows: DataFrame, guess: str, label: str, weight: str | None = None) -> DataFrame:
    """(category, n, predicted, correct, precision, hit_rate, accuracy) of each category guessed or true; accuracy is over all rows."""
    w = F.col(weight) if weight else F.lit(1)
    cells = rows.groupBy(F.col(guess).alias("g"), F.col(label).alias("y")).agg(F.sum(w).alias("w"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("category"), F.col("w").alias("n"), F.lit(0).cast("double").alias("p"), F.when(F.col("g") == F.col("y"), F.col("w")).otherwise(0).cast("double").alias("c")),
                                           F.struct(F.col("g").alias("category"), F.lit(0).cast("double").alias("n"), F.col("w").cast("double").alias("p"), F.lit(0).cast("double").alias("c")))).alias("s")).select("s.*")
    each = sides.groupBy("category").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    whole = each.agg(F.sum("n").alias("_n"), F.sum("c").alias("_c"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return each.crossJoin(F.broadcast(whole)).select("category", F.col("n").cast("long").alias("n"), F.col("p").cast("long").alias("predicted"), F.col("c").cast("long").alias("correct"),
                                                     ratio(F.col("c"), F.col("p")).alias("precision"), ratio(F.col("c"), F.col("n")).alias("hit_rate"), ratio(F.col("_c"), F.col("_n")).alias("accuracy"))


def cluster_to_category(cluster: Column, description: Column) -> Column:
    """L4: the rules' category, or where they have none the cluster's place in a fixed list that repeats."""
    ruled = T.categorize(description)
    return F.when(ruled != "outros", ruled).otherwise(F.element_at(F.array(*map(F.lit, CLUSTER_CATEGORIES)), (F.abs(cluster) % len(CLUSTER_CATEGORIES) + 1).cast("int")))


def predict_category(rows: DataFrame, model: Categorizer | None, description: str = "description") -> DataFrame:
    """L3: rows with `predicted_category`: the model's, but that of an override rule where training has never seen it; without a
    model the rules'; `outros` for blank descriptions."""
    said = F.trim(F.coalesce(F.col(description), F.lit("")))
    if model is None:
        found, learned = rows, T.categorize(F.col(description))
    elif model.algorithm == "KMeans":
        found = model.predict(rows, description)
        learned = cluster_to_category(F.col("predicted"), said)
    else:
        found = model.predict(rows, description)
        rule = T.rule_override(said)
        learned = F.when(rule.isNotNull() & ~rule.isin(model.labels), rule).otherwise(F.element_at(F.array(*map(F.lit, model.labels)), F.col("predicted") + 1))
    return found.withColumn("predicted_category", F.when(said == "", "outros").otherwise(learned)).select(*rows.columns, "predicted_category")


def categorize_batch(rows: DataFrame, model: Categorizer | None = None) -> DataFrame:
    """Rows (amount, description) with `category` by the model or the rules, then held against the amount's sign."""
    named = predict_category(rows, model)
    return named.withColumn("category", T.category_by_sign(F.col("amount"), F.col("predicted_category"), F.coalesce(F.col("description"), F.lit("")))).drop("predicted_category")
