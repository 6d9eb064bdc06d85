"""Tables written once in the folder that the cluster shares, to cut lineage that must outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many narrow rows (some tens of MB).
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint to meet others by a sorted shuffle. A written table of repeated texts is a hundredth of its rows in memory: by
    the size of its files Spark would broadcast millions of rows through the driver."""
    return df.hint("merge")


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is cheap to read, with a broadcast hint if it is small, else met by a shuffle."""
    return F.broadcast(df) if few(df, rows) else shuffled(df)
