"""Queries of the learned operators, over the derived bank rows, with their oracle SQL where the result doesn't hang on a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import models
from ledgerloom.plans.adapters import FOLD
from ledgerloom.plans.registry import SQL, Views, _ex, _in, _over, reg

reg("L1_isolation_outliers", lambda v: models.isolation_outliers(v.bank().select("id", "amount", "date", "ts")).select("id", "is_anomaly"))


def _own_labels(v: Views) -> DataFrame:
    """Bank rows with a company's own categories, one to each wording."""
    return v.bank().select("id", "description", F.concat(F.lit("cat_"), (F.col("id") % 12).cast("string")).alias("category"))


def _metrics(v: Views) -> DataFrame:
    model = models.train_categorizer(_own_labels(v))
    rows = [(model.algorithm, k, float(p), model.metrics["accuracy"]) for k, p in model.metrics["precision"].items()]
    return v.spark.createDataFrame(rows, "algorithm string, category string, precision double, accuracy double")


reg("L2_train_categorizer", _metrics)
reg("L3_predict_category", lambda v: models.predict_category(_own_labels(v), models.train_categorizer(_own_labels(v))).select("id", "predicted_category"),
    f"SELECT id, CASE WHEN description = '' THEN 'outros' ELSE coalesce(CASE {_over} END, 'cat_' || id % 12) END AS predicted_category FROM (SELECT *, {FOLD.format('description')} AS f FROM bank_tx)")
_list = ", ".join(f"'{c}'" for c in models.CLUSTER_CATEGORIES)
reg("L4_cluster_to_category", lambda v: v.bank().select("id", models.cluster_to_category(F.col("id") % 60, F.col("description")).alias("c")),
    f"SELECT id, CASE WHEN category <> 'outros' THEN category ELSE [{_list}][CAST(id % 60 % 25 + 1 AS INTEGER)] END AS c FROM bank_tx")
reg("L5_evaluate_model", lambda v: models.evaluate_model(models.majority_labels(v.bank().withColumn("cluster", F.col("id") % 18), "cluster", "category"), "guess", "category"))
SQL["L5_evaluate_model"] = SQL["L4_cluster_to_category"].split("SELECT id, CASE WHEN category <> 'outros' THEN category ELSE")[0].rstrip() + """, c AS (SELECT id % 18 AS cluster, category, count(*) AS n FROM bank_tx GROUP BY 1, 2),
    g AS (SELECT cluster, category AS guess FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) = 1), x AS (SELECT guess, category, n FROM c JOIN g USING (cluster)),
    k AS (SELECT guess AS category FROM x UNION SELECT category FROM x), t AS (SELECT k.category, (SELECT coalesce(sum(n), 0) FROM x WHERE x.category = k.category)::BIGINT AS n,
      (SELECT coalesce(sum(n), 0) FROM x WHERE x.guess = k.category)::BIGINT AS predicted, (SELECT coalesce(sum(n), 0) FROM x WHERE x.guess = k.category AND x.category = k.category)::BIGINT AS correct FROM k)
    SELECT category, n, predicted, correct, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0::DOUBLE END AS precision, CASE WHEN n > 0 THEN correct / n ELSE 0.0::DOUBLE END AS hit_rate, (SELECT sum(correct) / sum(n) FROM t) AS accuracy FROM t"""
reg("X23_categorize_batch", lambda v: models.categorize_batch(v.bank().withColumn("description", F.when(F.col("id") % 11 != 0, F.col("description"))).drop("category")).select("id", "category"),
    f"""SELECT id, CASE WHEN amount < 0 AND lower(c) IN ({_in}) THEN CASE WHEN back IN ({_in}) THEN 'outros' ELSE back END WHEN amount > 0 AND lower(c) IN ({_ex}) THEN CASE WHEN lower(back) IN ({_ex}) THEN 'receitas' ELSE back END ELSE c END AS category
    FROM (SELECT id, amount, c, coalesce(CASE {_over} END, c) AS back FROM (SELECT id, amount, CASE WHEN id % 11 = 0 THEN 'outros' ELSE category END AS c, CASE WHEN id % 11 = 0 THEN '' ELSE {FOLD.format('description')} END AS f FROM bank_tx))""")
