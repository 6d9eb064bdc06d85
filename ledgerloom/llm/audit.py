"""Filter interaction audit: part counters of failure masks, kept by a stream that retracts masks as smaller ids arrive."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, SPACE, Scratch, durable, table

#: A counter's key.
CELL = ["part", "mask", "good", "toxic"]
DELTA = "part string, mask int, good boolean, toxic boolean, n long"
STATE = "digest string, no_id boolean, id long, mask int, parts array<struct<part string, good boolean, toxic boolean, n long>>, batch long"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A under 200 words, B half of its words or more repeated, C over 3 % capitals, D a sign of markup."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 3 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def label_marks(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic) of ids with either mark: true if any of the id's label rows says so."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)")
    return marked.groupBy(F.col("doc_id").alias("label_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def with_labels(rows: DataFrame, marks: DataFrame, few: bool, salts: int = 16) -> DataFrame:
    """rows with `good` and `toxic` of their id.

    Few marks are broadcast. Else each marked id is dealt to `salts` tasks and each row asks one of them, so
    an id that a third of all rows share is met in parts; rows without id meet nothing and are spread. That join is
    hinted to be sorted: by the size of their file, before they are dealt, Spark would broadcast millions of marks through the driver.
    """
    if few:
        joined = rows.join(F.broadcast(marks), F.col("id") == F.col("label_id"), "left")
    else:
        dealt = marks.withColumn("label_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = F.when(F.col("id").isNull(), F.floor(F.rand(13) * (1 << 20)) + salts).otherwise(F.floor(F.rand(11) * salts)).cast("int")
        joined = rows.withColumn("salt", spread).join(dealt.hint("merge"), (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})


def least_rows(rows: DataFrame, batch_id: int) -> DataFrame:
    """STATE rows of a batch: for each (text, id) the parts of its rows and their number, combined before each shuffle."""
    counted = rows.groupBy("digest", "id", "mask", "part", "good", "toxic").agg(F.count("*").alias("n"))
    packed = counted.groupBy("digest", "id", "mask").agg(F.array_sort(F.collect_list(F.struct("part", "good", "toxic", "n"))).alias("parts"))  # as many as parts
    return packed.select("digest", F.col("id").isNull().alias("no_id"), "id", "mask", "parts", F.lit(batch_id).cast("long").alias("batch"))


def merged(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """(digest, old, new) of all texts of both: the smallest id before, and that of the batch, with its parts."""
    key = F.struct("no_id", "id", (-F.col("batch")).alias("age"), "mask", "parts")
    both = state.select("digest", F.lit(False).alias("now"), key.alias("x")).union(fresh.select("digest", F.lit(True).alias("now"), key.alias("x")))
    return both.groupBy("digest").agg(F.min(F.when(~F.col("now"), F.col("x"))).alias("old"), F.min(F.when(F.col("now"), F.col("x"))).alias("new")).filter("new is not null")


class RetractingCounters:
    """The keyed state of the audit and its counters, as tables under one folder of the shared store.

    raw/i       narrow rows of micro-batch i: text digest, id, part, mask of A to D; rows/i has labels too
    state/i     the texts whose smallest id batch i changed, with what stands at it; the newest smallest row of a text holds
    deltas/i    what batch i adds to the counters, retractions as negative numbers
    Each batch overwrites its own folders only, so one that is run again after a failure changes nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, marks: DataFrame, names: list[str]) -> None:
        self.spark, self.path, self.marks, self.dup, self.batches = spark, path, marks, 1 << (len(names) - 1), 0
        self.few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def earlier(self, kind: str, schema: str, before: int) -> DataFrame:
        paths = [f"{self.path}/{kind}/{i}" for i in range(before)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, kind: str, batch_id: int) -> DataFrame:
        path = f"{self.path}/{kind}/{batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Every row of the batch is first counted as a copy of an earlier text; then, for texts whose smallest
        id the batch lowers, what stood at the old one is counted back to copies and what stands at the new one is taken from them."""
        narrow = self.write(batch, "raw", batch_id)
        rows = self.write(with_labels(narrow, self.marks, self.few).select("digest", "id", *CELL), "rows", batch_id)
        moves = self.write(merged(self.earlier("state", STATE, batch_id), least_rows(rows, batch_id)), "moves", batch_id)
        first = F.col("old").isNull()
        same = F.col("old.id").eqNullSafe(F.col("new.id"))
        lower = ~first & ~same & ((F.col("old.no_id") & ~F.col("new.no_id")) | (~F.col("old.no_id") & ~F.col("new.no_id") & (F.col("new.id") < F.col("old.id"))))
        changed = moves.filter(first | same | lower)
        parts = F.when(first | lower, F.col("new.parts")).otherwise(F.concat("old.parts", "new.parts"))
        self.write(changed.select("digest", F.col("new.no_id").alias("no_id"), F.col("new.id").alias("id"), F.col("new.mask").alias("mask"), parts.alias("parts"), F.lit(batch_id).cast("long").alias("batch")), "state", batch_id)
        copies = rows.groupBy("part", (F.col("mask") + self.dup).alias("mask"), "good", "toxic").agg(F.count("*").alias("n"))
        enter = changed.select(F.col("new.mask").alias("mask"), F.explode("new.parts").alias("p"), F.lit(1).alias("sign"))
        leave = moves.filter(lower).select(F.col("old.mask").alias("mask"), F.explode("old.parts").alias("p"), F.lit(-1).alias("sign"))
        passing = enter.union(leave).groupBy(F.col("p.part").alias("part"), "mask", F.col("p.good").alias("good"), F.col("p.toxic").alias("toxic")).agg(F.sum(F.col("sign") * F.col("p.n")).alias("n"))
        deltas = copies.union(passing).union(passing.select("part", (F.col("mask") + self.dup).alias("mask"), "good", "toxic", (-F.col("n")).alias("n")))
        self.write(deltas.select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic", F.col("n").cast("long").alias("n")), "deltas", batch_id)
        self.batches = batch_id + 1

    def counters(self) -> DataFrame:
        return self.earlier("deltas", DELTA, self.batches).groupBy(*CELL).agg(F.sum("n").alias("n")).filter("n <> 0")


def interaction_report(counters: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the counters of failure masks alone.

    Counters are at most 4 * 2^filters a part, and each meets a fixed list of orders and steps, so nothing here
    grows with the documents.
    """
    steps = [("".join(o), k + 1, 1 << names.index(o[k]), sum(1 << names.index(x) for x in o[:k])) for o in permutations(names) for k in range(len(o))]
    listed = F.array(*[F.struct(F.lit(o).alias("order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(done).alias("done")) for o, k, bit, done in steps])
    each = counters.select("*", F.explode(listed).alias("s")).select(*CELL, "n", "s.*")
    reached, fails = F.col("mask").bitwiseAND(F.col("done")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    report = each.groupBy("part", "order", "step", "bit").agg(
        total(reached & ~fails, "kept"), total(reached & fails, "removed"), total(~reached & fails, "redundant"), total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(reached & fails & F.col("good"), "good_lost"), total(reached & fails & F.col("toxic"), "toxic_lost"))
    shares = report.groupBy(F.col("part").alias("share_part"), F.col("bit").alias("share_bit")).agg(F.sum("removed").alias("shapley"))
    return report.join(shares, (F.col("part") == F.col("share_part")) & (F.col("bit") == F.col("share_bit"))).select(
        "part", F.col("order").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "lang", batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How text filters and the copy filter (the last letter, E) overlap, for every order of them, per part of the Parquet table at `path`.

    The table's files are a stream, taken in about `batches` micro-batches of whole files until none is left (available
    now). State is keyed by the text's SHA-256: its smallest id so far and what stands there. A batch whose
    id is smaller retracts the earlier row's mask from the counters. Rows are narrowed before anything is shuffled;
    a text that a third of all rows share is combined before each shuffle. `batches` is fixed, as each reads the
    narrow state of those before it.

    Result: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    Null text is empty text, a null part the empty string. A null id comes after all others: such a row is a copy if
    its text has any id, and rows without id are no copies of each other. Rows that share id and text are no copies
    of each other either: no id is smaller. Label rows of one id count once, nulls as 0. An empty table gives no rows.
    Columns of other names are not read; `filters` are expressions over the table's own columns.
    """
    source = spark.read.parquet(path)
    scratch = Scratch(spark)
    filters = filters or text_filters(F.col(text_col))
    names = [*filters, "E"]
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    files = max(1, math.ceil(len(source.inputFiles()) / batches))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern of this one name: a stream takes a single file by pattern only
    narrow = stream.select(digest.alias("digest"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"))
    state = RetractingCounters(spark, f"{scratch.path}/audit", scratch.save(label_marks(labels)), names)
    query = narrow.writeStream.foreachBatch(state.update).option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    report = durable(interaction_report(state.counters(), names))
    scratch.clear()
    return report


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), lab AS (SELECT doc_id AS lid, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) OR (doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN lab ON doc_id = lid
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM d GROUP BY ALL
), l(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS done FROM o, range(1, 6) r(k)
), r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER ((mask & done) = 0 AND (mask & bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((mask & done) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & done) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER ((mask & done) = 0 AND (mask & bit) <> 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER ((mask & done) = 0 AND (mask & bit) <> 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
