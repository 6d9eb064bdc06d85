"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch

CELLS = 1 << 16


def ring_points(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Sorted positions (32 bit) of all virtual nodes, and the shard of each."""
    points = sorted((int.from_bytes(hashlib.sha256(f"shard-{s}/{v}".encode()).digest()[:4], "big"), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def place_cells(cells: pd.DataFrame, shards: int, vnodes: int = 128, slack: float = 0.0005) -> pd.DataFrame:
    """cells (cell, bytes, n) -> the same with `shard`, each load at most (1 + slack) times the mean where cells fit.

    A cell goes to the first virtual node clockwise of its position whose shard has room; heavy cells
    choose first, as they have fewer places. For one that fits nowhere the bound is raised to the least that
    some shard can keep.
    """
    points, owner = ring_points(shards, vnodes)
    cells = cells.sort_values(["bytes", "cell"], ascending=[False, True], kind="stable").reset_index(drop=True)
    cap = (1 + slack) * float(cells["bytes"].sum()) / shards
    loads, placed = [0.0] * shards, []
    for cell, size in zip(cells["cell"], cells["bytes"], strict=True):
        at, bound = bisect.bisect_left(points, int(cell) % CELLS * ((1 << 32) // CELLS)), max(cap, min(loads) + size)
        chosen = next(s for step in range(len(points)) if loads[s := owner[(at + step) % len(points)]] + size <= bound)
        loads[chosen] += size
        placed.append(chosen)
    return cells.assign(shard=np.array(placed, dtype="int32"))


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 128, slack: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs, law `bytes`: loads near equal.

    Each id hashes to one of 65,536 cells on a ring; cells, not rows, are placed under the load bound,
    so what the driver holds is at most twice 65,536 sums whatever the input's size, and a change of shards
    moves only cells that a new node takes or that overflow (5 in 100 from 40 to 41 shards, 2.4 at best). Slots number the rows of a shard without
    gaps: the cell's offset plus the row's rank in its cell, so no task orders a whole shard.

    Null text has size 16 and crc32 0, as empty text. Rows without id are placed by size and crc32. A cell of
    over 64 rows and 16 times the mean, as of an id that is repeated very often, is split
    over the ring by its rows' places in the table. Repeated rows each get a slot of their own, ordered by id, size and
    crc32. Empty input: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size, crc = (F.octet_length(raw) + 16).cast("long"), F.crc32(raw)
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("no id"), size, crc)).otherwise(F.xxhash64(F.lit("ring"), F.col(id_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), F.pmod(place, F.lit(CELLS)).cast("int").alias("cell"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows)
    sums = lambda rows: rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()  # noqa: E731  65,536 rows at most
    cells = sums(rows)
    heavy = cells[cells["n"] > max(64, 16 * cells["n"].mean())]
    if len(heavy):
        split = F.broadcast(spark.createDataFrame([(int(c),) for c in heavy["cell"]], "cell int").withColumn("split", F.lit(True)))
        apart = F.when(F.col("split"), CELLS + F.pmod(F.xxhash64("cell", "row"), F.lit(CELLS)).cast("int")).otherwise(F.col("cell"))
        rows = scratch.save(rows.join(split, "cell", "left").select("id", "size", "text_crc32", apart.alias("cell"), "row"))
        cells = sums(rows)
    cells = place_cells(cells, shards, vnodes, slack).sort_values(["shard", "cell"])
    cells["offset"] = cells.groupby("shard")["n"].cumsum() - cells["n"]
    placed = spark.createDataFrame(cells[["cell", "shard", "offset"]].astype({"cell": "int32", "shard": "int32", "offset": "int64"}), "cell int, shard int, offset long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("id", "size", "text_crc32"))
    return rows.withColumn("rank", rank).join(F.broadcast(placed), "cell").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot")
    )


def op10_ring_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
