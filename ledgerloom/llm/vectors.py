"""Near-dedup of embeddings: randomised-rotation binary codes with stored correction factors choose what is computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, durable, join_counted, modest_batches, small
from ledgerloom.llm.minhash import components
from ledgerloom.llm.textvec import mix64

#: A bucket of more rows is cut in blocks of at most about this many, and blocks meet in pairs.
BLOCK = 1024
#: Standard deviations of the estimate's error that are allowed for: about 1 link in 100,000 lies outside.
SURE = 4.5
#: Numbers of either side's vectors that a task gathers at a time, for as many pairs as they make.
CHUNK = 1 << 22


@cache
def rotations(dim: int, count: int) -> np.ndarray:
    """count random orthogonal matrices, the same on every machine."""
    rng = np.random.default_rng([dim, 20240607])
    found = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        found.append(q * np.sign(np.diag(r)))
    return np.stack(found)


def plan_bands(largest: int, threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """(bits of a band, bands): as many bits as keep chance meetings of the largest label's rows few per band, whatever
    its size, and as many bands as leave a pair just at the threshold without one with probability `miss`."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(6, math.ceil(math.log2(max(2, largest)))))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits))))


def encode(x: np.ndarray, label: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows x: band keys (n x bands), codes of two rotations (n x 2 x bytes) and their factors (n x 2).

    A code is the signs of the rotated vector; its factor is the inner product of the vector with the unit
    vector that the signs stand for. The bands' bits are taken from as many rotations as they need.
    """
    n, dim = x.shape
    turned = np.matmul(x[None], rotations(dim, max(2, -(-bits * bands // dim))).transpose(0, 2, 1)).transpose(1, 0, 2)
    signs = turned >= 0
    factors = np.abs(turned[:, :2]).sum(axis=2) / math.sqrt(dim)
    used = signs.reshape(n, -1)[:, : bits * bands].reshape(n, bands, bits)
    keys = (used * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    salt = mix64(label.view(np.uint64)[:, None] + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
    return mix64(keys * np.uint64(0xFF51AFD7ED558CCD) + salt).view(np.int64), np.packbits(signs[:, :2], axis=2), factors


def decode(codes: np.ndarray, factors: np.ndarray, dim: int) -> np.ndarray:
    """n x 2 x dim: of each code the vector whose inner product with any vector estimates that of the coded one, without bias."""
    signs = np.unpackbits(codes, axis=2, count=dim).astype(np.float32) * 2 - 1
    back = np.matmul(signs.transpose(1, 0, 2), rotations(dim, 2).astype(np.float32)).transpose(1, 0, 2)
    return back / np.float32(math.sqrt(dim)) / factors[:, :, None].astype(np.float32)


def lowest_estimate(factors: np.ndarray, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row the two terms of the bound: a pair at the threshold is estimated above
    threshold - SURE * sqrt(a_i + a_j + b_i * b_j) but for the tail that SURE leaves.

    The error of a decoded vector is orthogonal to it, of length sqrt(1 / factor**2 - 1) and random direction: against the other
    vector it counts by that one's part orthogonal to the first, against the other's error by both lengths. Errors of one
    rotation are taken as fully correlated, which is the worst case.
    """
    slack = np.maximum(1 / np.maximum(factors, 1e-9) ** 2 - 1, 0)
    free = max(dim - 1, 1)
    return slack.sum(axis=1) * (1 - threshold**2) / (2 * free), slack.mean(axis=1) / math.sqrt(free)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys, as tables of whole runs of equal keys: some thousand rows of short runs at a time, or one long run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 4 * BLOCK:
            continue
        rows = pa.Table.from_batches(held)
        at = np.stack([rows.column(k).to_numpy() for k in keys])
        new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        if len(new):
            yield rows.slice(0, new[-1])
            held = rows.slice(new[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def partners(rows: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows of the same run, in bounded portions; in a run of two blocks only across them."""
    at = np.stack([rows.column(k).to_numpy() for k in ("key", "one", "two")])
    side = rows.column("side").to_numpy()
    starts = np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0)))
    last = np.append(np.flatnonzero(starts)[1:], len(starts))[np.cumsum(starts) - 1]
    many = last - np.arange(len(starts)) - 1
    begin, upto, portion = 0, np.cumsum(many), max(1, CHUNK // dim)
    while begin < len(many):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + portion, side="right")))
        i = np.repeat(np.arange(begin, end), many[begin:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[begin:end] - many[begin:end] - done, many[begin:end])
        across = (at[1][i] == at[2][i]) | (side[i] != side[j])
        if across.any():
            yield i[across], j[across]
        begin = end


def lists(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def dims(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each vector length in rows with the places of its rows; a run that mixes lengths is a chance meeting of keys."""
    d = rows.column("dim").to_numpy()
    for dim in np.unique(d):
        yield int(dim), np.flatnonzero(d == dim)


def encoder(bits: int, bands: int):
    """rid, label_hash, vector -> keys, code, factors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for dim, at in dims(rows):
                part = rows.take(at)
                x = lists(part.column("vector"), float)
                x = x / np.abs(x).max(axis=1)[:, None]
                keys, codes, factors = encode(x / np.linalg.norm(x, axis=1)[:, None], part.column("label_hash").to_numpy(), bits, bands)
                yield pa.RecordBatch.from_pydict({
                    "rid": part.column("rid").combine_chunks(), "dim": part.column("dim").combine_chunks(), "keys": pa.array(list(keys), pa.list_(pa.int64())),
                    "code": pa.array([c.tobytes() for c in codes], pa.binary()), "factors": pa.array(list(factors), pa.list_(pa.float64()))})

    return work


def sieve(threshold: float):
    """Bucket rows with codes -> the rows that have a partner which the estimate's upper bound doesn't exclude."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, ["key", "one", "two"]):
            for dim, at in dims(whole):
                rows = whole.take(at)
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.uint8).reshape(len(at), 2, -1)
                factors = lists(rows.column("factors"), float)
                x, (a, b) = decode(codes, factors, dim), lowest_estimate(factors, dim, threshold)
                wanted = np.zeros(len(at), dtype=bool)
                for i, j in partners(rows, dim):
                    guess = (np.einsum("nd,nd->n", x[i, 0], x[j, 1]) + np.einsum("nd,nd->n", x[i, 1], x[j, 0])) / 2
                    near = guess >= threshold - SURE * np.sqrt(a[i] + a[j] + b[i] * b[j])
                    wanted[i[near]] = True
                    wanted[j[near]] = True
                if wanted.any():
                    yield from rows.select(["key", "one", "two", "side", "rid"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    return work


def exact(threshold: float):
    """Bucket rows with vectors -> for each row that is linked here: weight of its partners, and the smallest row it is connected with.

    A pair is counted in the first band that it shares, as its stored keys tell, so once in all.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, ["key", "one", "two"]):
            for dim, at in dims(whole):
                rows = whole.take(at)
                rid, weight, label = rows.column("rid").to_numpy(), rows.column("n").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
                x, keys, key = lists(rows.column("vector"), float), lists(rows.column("keys"), np.int64), rows.column("key").to_numpy()
                x = x / np.abs(x).max(axis=1)[:, None]  # so that no square overflows or vanishes
                norm = np.sqrt(np.einsum("nd,nd->n", x, x))
                band = (keys == key[:, None]).argmax(axis=1)
                links, root = np.zeros(len(rid), dtype=np.int64), np.arange(len(rid))
                for i, j in partners(rows, dim):
                    linked = (np.einsum("nd,nd->n", x[i], x[j]) / (norm[i] * norm[j]) >= threshold) & (label[i] == label[j]).astype(bool)
                    i, j = i[linked], j[linked]
                    first = (keys[i] == keys[j]).argmax(axis=1) == band[i]
                    i, j = i[first], j[first]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    join_roots(root, i, j)
                has = np.flatnonzero(links)
                if len(has):
                    yield pa.RecordBatch.from_pydict({"rid": rid[has], "links": links[has], "other": rid[root[has]]})

    return work


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make root[k] the smallest place that pairs (i, j), and those joined before, connect k with."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: how many other rows of its label have cosine >= threshold with it, the
    smallest id that such links lead to, and whether that is its own.

    1. Equal vectors of a label are one representative with a weight.
    2. Representatives get sign codes of random rotations, correction factors and band keys, stored with them.
       A pair at the threshold shares none of its bands with probability `miss`; closer ones rarer still.
    3. Rows that share a band key are compared by codes alone: the unbiased estimate of their cosine plus its confidence
       bound must reach the threshold. Only rows with such a partner have their vectors fetched, and
       are compared exactly, in double precision, where both meet. No pair leaves a task: a row leaves with a sum and one neighbour.
    4. Connected components of those neighbours.
    Buckets of more than BLOCK rows are cut in blocks that meet in pairs, so a group of near copies of any size is shared out, and
    every pair of it is compared once. Thresholds under 0.9 need many bands; the method is meant for near copies.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, have no links and are their
    own component, kept. Vectors of different length never link. Rows that share an id are rows of their own, and count as
    others. Rows without id count as partners; a component of such rows only has id null, its rows are kept. Empty
    input: empty result. Other columns aren't read.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    scratch = Scratch(spark)
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    sound = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0) & F.col("label").isNotNull(), F.lit(False))
    same = F.concat(F.hex(F.xxhash64("label", "vector")), F.lit(":"), F.hex(F.xxhash64(F.lit("second"), "vector", "label")))
    rows = scratch.save(given.select("vec_id", F.when(sound, same).alias("same")))
    total = rows.count()
    groups = rows.filter("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    groups = scratch.save(groups.select("*", F.monotonically_increasing_id().alias("rid")))
    firsts = given.filter(sound).select(same.alias("same"), "label", "vector")
    single = firsts.groupBy("same").agg(F.min(F.struct("label", "vector")).alias("x"))
    reps = scratch.save(groups.join(single, "same").select("rid", "n", "x.label", "x.vector", F.size("x.vector").alias("dim"), F.xxhash64("x.label").alias("label_hash")))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("c")).agg(F.max("c").alias("c")).first()["c"]
    if sizes is None:
        out = durable(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
        scratch.clear()
        return out
    bits, bands = plan_bands(sizes, threshold, miss)
    codes = reps.select("rid", "dim", "label_hash", "vector").mapInArrow(encoder(bits, bands), "rid long, dim int, keys array<long>, code binary, factors array<double>")
    codes = scratch.save(codes)
    flat = codes.select(F.explode("keys").alias("key"), "rid", "dim", "code", "factors")
    counts = codes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    large = small(scratch.save(counts.filter(F.col("c") > BLOCK)).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    met = flat.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "with").cast("int").alias("one"), F.greatest("block", "with").cast("int").alias("two"), (F.col("block") > F.col("with")).cast("int").alias("side"), "rid", "dim", "code", "factors")
    place = "key long, one int, two int, side int, rid long"
    sorted_ = lambda df: df.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    wanted = scratch.save(sorted_(met).mapInArrow(sieve(threshold), place))
    whole = reps.join(codes.select("rid", "keys"), "rid").select("rid", "n", "label", "dim", "vector", "keys")
    asked = wanted.groupBy("rid").agg(F.count("*").alias("asked"))
    fetched = join_counted(wanted, scratch.save(scratch.save(asked).join(whole, "rid")), "rid", "asked", wanted.count())
    linked = scratch.save(sorted_(fetched.select("key", "one", "two", "side", "rid", "n", "label", "dim", "vector", "keys")).mapInArrow(exact(threshold), "rid long, links long, other long"))
    sums = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    edges = linked.filter("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")).distinct()
    group = components(edges, scratch).select(F.col("doc").alias("rid"), F.col("label").alias("group"))
    named = scratch.save(groups.join(sums, "rid", "left").join(group, "rid", "left").select("same", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("group", "rid").alias("group")))
    heads = scratch.save(named.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    result = join_counted(named, heads, "group", "members", groups.count()).select("same", "n", "n_links", "component_id")
    found = join_counted(rows.filter("same is not null"), scratch.save(result), "same", "n", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("same is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = durable(found.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
    scratch.clear()
    return out


def op13_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
