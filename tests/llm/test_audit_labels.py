"""op11's labels never go through the driver when they are many, however small their file is."""

from ledgerloom.llm import audit
from pyspark.sql import functions as F


def test_many_labels_are_not_broadcast(spark, tmp_path):
    marks = spark.range(1000).select(F.col("id").alias("label_id"), (F.col("id") % 2 == 0).alias("good"), (F.col("id") % 3 == 0).alias("toxic"))
    marks.write.parquet(str(tmp_path / "marks"))
    spark.range(3000).withColumn("id", F.when(F.col("id") % 7 > 0, F.col("id"))).write.parquet(str(tmp_path / "rows"))
    marks, rows = (spark.read.parquet(str(tmp_path / n)) for n in ("marks", "rows"))
    told = audit.with_labels(rows, marks, False)
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    listed = lambda df: sorted(map(str, df.select("id", "good", "toxic").collect()))
    assert listed(told) == listed(audit.with_labels(rows, marks, True)) and told.filter("good").count() > 300
