"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, Scratch, durable, join_salted, let, small


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.array_remove(F.split(trimmed, SPACE), "")


def runs(words: Column, size: Column | int, of: Callable[[Column], Column]) -> Column:
    """of(run) of all runs of `size` words, in order; none for fewer words."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: of(F.slice(words, i, size))))


def as_text(run: Column) -> Column:
    return F.array_join(run, " ")


def item_sketches(items: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, part, n, need, all, sketch, hits): distinct shingles of each item, and its bottom-k MinHash sketch.

    Shingles are runs of `width` words: `size`, or all words of an item that has fewer. Items are
    partitioned by their number of shingles n into powers of two, and each part has one sketch size:
    that of its largest items. A text that holds `need` = ceil(threshold*n) of an item's shingles misses
    n - need at most, so it holds at least k - (n - need) = `hits` of any k of them, and k is such that
    this is 1 or more: the search loses no match whatever the document's length (bands over whole
    documents would: 50 shingles in 20,000 are a similarity of 0.002).
    """
    worded = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(size))
    rows = worded.select("item_id", width.alias("width"), F.array_distinct(runs(F.col("words"), width, as_text)).alias("all"))
    need = lambda n: F.ceil(n * F.lit(threshold) - 1e-9).cast("int")
    rows = rows.withColumn("n", F.size("all")).withColumn("part", F.floor(F.log2("n")).cast("int")).withColumn("need", need(F.col("n")))
    most = F.pow(F.lit(2), F.col("part") + 1).cast("int") - 1
    rows = rows.withColumn("k", F.least(F.col("n"), most - need(most) + 1))
    hashes = F.array_sort(F.array_distinct(F.transform("all", lambda x: F.xxhash64(F.split(x, " ")))))
    return rows.select("item_id", "width", "part", "n", "need", "all", F.slice(hashes, F.lit(1), F.col("k")).alias("sketch"), (F.col("k") - (F.col("n") - F.col("need"))).alias("hits"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, matched, containment) of each document that holds at least `threshold` of an item's shingles.

    Search: hashes of all shingles of all documents meet the sketches, those of items that the document
    is long enough for (all its rows together), and enough of a sketch must be there. Verification: only candidate documents
    are read again, and their shingles, as words, are compared with all of an item's. Sketches, items and
    candidates are broadcast up to a counted size, else joined by shuffles with each key dealt to several tasks.

    An item of fewer than `size` words is one shingle, of all its words, looked for as it is. Items without
    words and null texts match nothing. Rows that share a doc_id count as one document; rows without id are
    not reported. Repeated items each get their rows. Empty tables give an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.save(item_sketches(items, threshold, size))
    widths = sorted(r[0] for r in sketches.select("width").distinct().collect())  # `size` values at most
    read = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def shingled(rows: DataFrame, of: Callable[[Column], Column], name: str) -> DataFrame:
        """(doc_id, width, size, name): the runs of each wanted width, in one pass; `size` is how many there are."""
        each = lambda words: F.array(*[F.struct(F.lit(w).alias("width"), runs(words, w, of).alias("sh")) for w in widths or [size]])
        # Outer explodes, as of a plain one Spark infers a filter on the array, computes it twice and before the semi-join.
        cut = rows.select("doc_id", F.explode_outer(let(words_of(F.col("text")), each)).alias("x"))
        return cut.select("doc_id", "x.width", F.size("x.sh").alias("size"), F.explode_outer("x.sh").alias(name))

    keys = scratch.save(sketches.select("item_id", F.col("width").alias("w"), "need", "hits", F.explode("sketch").alias("h")))
    met = join_salted(shingled(read, lambda run: F.xxhash64(run), "h"), keys, "h").filter("width = w")
    met = met.groupBy("doc_id", "item_id", "need", "hits", "h").agg(F.max("size").alias("size"))
    able = met.groupBy("doc_id", "item_id", "need", "hits").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n >= hits")
    able = scratch.save(able.select("doc_id", "item_id", (F.col("size") >= F.col("need")).alias("long")))
    # A row too short for the item counts only where its document has more rows.
    short = scratch.save(able.filter("not long").select("doc_id").distinct())
    several = docs.select(F.col(id_col).alias("doc_id")).join(small(short), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    candidates = scratch.save(able.filter("long").union(able.filter("not long").join(several, "doc_id", "left_semi")).select("doc_id", "item_id"))
    again = read.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    whole = scratch.save(sketches.select("item_id", F.col("width").alias("w"), "n", "need", F.explode("all").alias("shingle")))
    hits = join_salted(shingled(again, as_text, "shingle"), whole, "shingle").filter("width = w").select("doc_id", "item_id", "n", "need", "shingle").distinct()
    hits = hits.groupBy("doc_id", "item_id", "n", "need").agg(F.count("*").cast("int").alias("matched")).filter("matched >= need")
    found = durable(hits.join(candidates, ["doc_id", "item_id"], "left_semi").select(
        "doc_id", "item_id", F.col("n").alias("n_shingles"), "matched", (F.col("matched") / F.col("n")).alias("containment")
    ))
    scratch.clear()
    return found


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0
), ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM b)),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM b),
n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_shingles FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS matched FROM ds JOIN bs USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, matched, CAST(matched AS DOUBLE) / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE matched >= ceil(n_shingles * 0.8 - 1e-9)
"""
