"""Structured Streaming forms: ingest with matching (T1), dedup (T2), metrics (T3), late and expired events (T7), routing with retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.coerce import clean_description
from ledgerloom.operators import matching
from ledgerloom.operators.tables import written

Handler = Callable[[DataFrame, int], DataFrame | None]


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events files as a stream; the schema is that of the table, never inferred from data."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first row of a key within the watermark; state is dropped behind it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_metrics(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counts per minute and type, emitted once the watermark passes a window (append mode)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "60 seconds"), "event_type").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what there is, into Parquet under path (on the shared store), and read the result."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(stream: DataFrame, path: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch, mode: str = "append") -> DataFrame:
    """Run a stream over what there is; work(batch) is written under the batch's id, so a batch that is run again replaces itself.

    Returns all that batches wrote, with their id in `batch`. Without a batch there is no row.
    """
    spark, schemas = stream.sparkSession, []

    def write(batch: DataFrame, batch_id: int) -> None:
        done = work(batch)
        schemas.append(done.schema)
        done.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode(mode).start()
    query.awaitTermination()
    # Work on no rows can cost as much as on a batch, if it prepares other tables: it only tells the schema where no batch did.
    schema = (schemas[:1] or [work(spark.createDataFrame([], stream.schema)).schema])[0].add("batch", "long")
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*") if query.recentProgress and _made(spark, f"{path}/out") else empty


def _made(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stream_ingest(uploads: DataFrame, ledger: DataFrame, path: str, config: matching.MatchConfig | None = None) -> DataFrame:
    """Bank rows as they are uploaded, cleaned (X14) and matched (M20) against a ledger, batch by batch.

    A row's matches hang on it and the ledger only, so the union of batches is what one run over all rows gives. The ledger is
    written once before the stream starts, so that each batch meets the same one.
    """
    fixed = written(ledger)
    args = (config,) if config else ()

    def match(batch: DataFrame) -> DataFrame:
        return matching.find_matches(batch.withColumn("description", clean_description(F.col("description"))), fixed, *args)

    return run_batches(uploads, path, match)


def late_and_expired(events: DataFrame, path: str, as_of: str, delay: str = "1 hour") -> tuple[DataFrame, dict[str, int]]:
    """A stream's events (event_id, ts, expires_at, ...) that are neither late nor expired, and how many were either.

    Expired is what has expires_at at or before as_of; null never expires. Late is what stands behind the watermark when its
    batch is read: it is dropped by the dedup on event_id, which counts it row by row. Dedup state goes `delay` after its event.
    """
    expired = F.coalesce(F.col("expires_at") <= F.lit(as_of).cast("timestamp"), F.lit(False))
    counted = events.observe("expiry", F.count_if(expired).alias("expired"))
    fresh = counted.filter(~expired).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    query = fresh.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    counts = {"late": 0, "expired": 0}
    for progress in query.recentProgress:
        counts["late"] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        seen = progress.observedMetrics.get("expiry")
        counts["expired"] += (seen["expired"] or 0) if seen else 0
    return events.sparkSession.read.schema(fresh.schema).parquet(f"{path}/out"), counts


class Router:
    """A foreachBatch function that gives each event type's rows to its handler, retries what fails, and keeps dead letters.

    A handler returns the rows that failed (None or no rows: all went well), or raises, which fails all it was given. What failed is
    given again with retry_count one higher, until it has been tried `tries` times; then it goes to the dead letters with the
    last error. Types without a handler go nowhere. Batches, attempts and dead letters are written under the batch's id, so a
    batch that is run again replaces its own; handlers that write under the id they get are then idempotent too.
    """

    ATTEMPTS = "event_type string, attempt int, given long, failed long, error string"

    def __init__(self, handlers: dict[str, Handler], path: str, tries: int = 3) -> None:
        self.handlers, self.path, self.tries = handlers, path, tries

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "retry_count" not in batch.columns:
            batch = batch.withColumn("retry_count", F.lit(0))
        at = f"{self.path}/in/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)  # read by each handler, computed once
        rows, log, dead = spark.read.schema(batch.schema).parquet(at), [], None
        for kind, handler in self.handlers.items():
            left = rows.filter(F.col("event_type") == kind)
            for attempt in range(1, self.tries + 1):
                given, error = left.count(), None
                if not given:
                    break
                try:
                    failed = handler(left, batch_id)
                except Exception as problem:  # a failing handler must not stop the others
                    failed, error = left, f"{type(problem).__name__}: {problem}"
                again = 0
                if failed is not None:
                    failed = written(failed.select(*rows.columns).withColumn("retry_count", (F.col("retry_count") + 1).cast("int")))
                    again = failed.count()
                log.append((kind, attempt, given, again, error))
                if not again:
                    break
                left = failed
            else:
                letters = left.withColumn("error", F.lit(error or "rows failed"))
                dead = letters if dead is None else dead.unionByName(letters)
        if dead is None:
            dead = rows.limit(0).withColumn("error", F.lit("").cast("string"))
        dead.write.mode("overwrite").parquet(f"{self.path}/dead/batch={batch_id}")
        spark.createDataFrame(log, self.ATTEMPTS).write.mode("overwrite").parquet(f"{self.path}/attempts/batch={batch_id}")

    def run(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Route all that the stream holds; returns (dead letters, attempts). An empty stream gives two empty tables."""
        spark = events.sparkSession
        query = events.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        kept = [c for c in events.schema if c.name != "retry_count"]
        letters = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in kept), "retry_count int", "error string"])
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{self.path}/{name}/batch=*") if _made(spark, f"{self.path}/{name}") else spark.createDataFrame([], schema)
        return read("dead", letters), read("attempts", self.ATTEMPTS)


def routed_copy(folder: str) -> Handler:
    """A handler that writes its rows under folder and the batch's id."""
    def handle(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return handle


