"""What the operators of this subpackage share: durable tables, size-checked broadcasts, word rules."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same rule for a split: runs of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: A side is broadcast only up to this many narrow rows (some tens of MB); beyond, a shuffled join.
BROADCAST_ROWS = 200_000
#: Spark's setting by which the shuffle files of an execution go at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); only where unset, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: cut lineage that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Durable tables of one operator's run: save() writes them, clear() deletes those whose readers are done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/ledgerloom-{uuid.uuid4().hex}", 0
        self.saved: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        """df as a table. Spark deletes the shuffle files of the write once it is done: nothing reads them again, as the table is read instead."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.saved.append((found, path))
        return found

    def free(self, *tables: DataFrame) -> None:
        """Deletes the given tables of save() before clear(): what is built on them must be saved by then."""
        for path in [path for df, path in self.saved if any(df is x for x in tables)]:
            self._delete(path)
        self.saved = [(df, path) for df, path in self.saved if not any(df is x for x in tables)]

    def clear(self) -> None:
        self._delete(self.path)
        self.saved = []

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, hot: int = 50_000) -> DataFrame:
    """rows inner-joined on `key` with groups, one row per key that says in `count` how many of `total` rows it has.

    A key with over 1/hot of all rows is met by broadcast: there are fewer than `hot` such keys,
    whatever the input. The rest is a shuffled join in which no key has more than that share, so a
    key with a third of all rows stays spread over all tasks. Pass tables that are cheap to read, as both are read twice.
    """
    least = max(1_000, total // hot)
    rare = groups.filter(F.col(count) <= least)
    if total <= least:
        return rows.join(rare, key)
    often = groups.filter(F.col(count) > least)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(rare, key))


def join_salted(rows: DataFrame, keys: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """rows inner-joined with keys on `key`: by broadcast where keys are few (counted), else shuffled with each key dealt to `salts` tasks."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key)
    dealt = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.floor(F.rand(17) * salts).cast("int")
    return rows.withColumn("_salt", salt).join(dealt, [key, "_salt"]).drop("_salt")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted), else unchanged: Spark then shuffles the join.

    Pass a durable or narrow df, as counting runs it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession, rows: int = 1024, size: int = 32 << 20) -> None:
    """Arrow batches of few rows and bytes for the rest of the session, so that long texts don't fill a worker's memory."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        set_ = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if set_ is None or not 0 < int(set_.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row; else each call of a lambda inside `use` computes it again."""
    return F.element_at(F.transform(F.array(value), use), 1)
