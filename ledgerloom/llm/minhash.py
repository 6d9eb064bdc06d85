"""Near-dedup: ProbMinHash signatures of word shingle sets, banding, exact verification, connected classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ledgerloom.llm.common import Scratch, durable, join_counted, modest_batches, small
from ledgerloom.llm.textvec import mix64, shingle_hashes, word_hashes

#: 32 bands of 5 registers: a pair of similarity 0.8 shares a band with probability 0.999997, one of 0.3 with 0.08.
#: This holds as every shingle of a set has weight 1: the signatures' probability Jaccard then is the set Jaccard that decides.
BANDS, ROWS = 32, 5


def probminhash(elements: np.ndarray, doc: np.ndarray, weights: np.ndarray, docs: int, m: int) -> np.ndarray:
    """docs x m registers. Each element's arrivals are a Poisson process of its weight's rate, the same in every
    document up to that rate; an arrival hits one random register, and each register keeps its earliest.

    All documents advance together, an arrival of each live element a round; an element stops once its
    next arrival is later than all of its document's registers (early termination).
    """
    time, kept = np.full(docs * m, np.inf), np.zeros(docs * m, dtype=np.uint64)
    t = np.zeros(len(elements))
    j = 0
    while len(elements):
        j += 1
        r = mix64(elements + np.uint64((j * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weights
        at = doc * m + (mix64(r ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, at, t)
        won = time[at] == t
        kept[at[won]] = elements[won]
        live = np.unique(doc)
        latest = np.zeros(docs)
        latest[live] = time.reshape(docs, m)[live].max(axis=1)
        go = t < latest[doc]
        elements, doc, weights, t = elements[go], doc[go], weights[go], t[go]
    return kept.reshape(docs, m)


def band_keys(texts: list[str | None]) -> list[np.ndarray]:
    """The BANDS keys of each text; none for a text without words."""
    parts, weights, owner, full = [], [], [], []
    keys: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    for i, t in enumerate(texts):
        s = shingle_hashes(word_hashes(t)) if t else np.zeros(0, dtype=np.uint64)
        if len(s):
            e = np.unique(s)
            parts.append(e)
            weights.append(np.ones(len(e)))
            owner.append(np.full(len(e), len(full), dtype=np.int64))
            full.append(i)
    if full:
        registers = probminhash(np.concatenate(parts), np.concatenate(owner), np.concatenate(weights), len(full), BANDS * ROWS)
        grouped = registers.reshape(len(full), BANDS, ROWS)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()
        for k in range(ROWS):
            h = mix64((h ^ grouped[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k))
        for row, i in enumerate(full):
            keys[i] = h[row].view(np.int64)
    return keys


@pandas_udf(ArrayType(LongType()))
def bands_of(texts: pd.Series) -> pd.Series:
    found, at, size, start = [], 0, 0, 0
    texts = list(texts)
    for at, t in enumerate(texts):  # a few MB of text at a time, however long the texts are
        size += len(t or "")
        if size > 2_000_000:
            found += band_keys(texts[start : at + 1])
            start, size = at + 1, 0
    return pd.Series(found + band_keys(texts[start:]), dtype=object)


@pandas_udf(ArrayType(LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(word_hashes(t or ""))).view(np.int64) for t in texts], dtype=object)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact Jaccard similarity `j` on shingle sets, the largest where an id has several texts."""
    x = sets.select(F.col("doc").alias("a"), F.col("sh").alias("sa"))
    y = sets.select(F.col("doc").alias("b"), F.col("sh").alias("sb"))
    both = pairs.join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    judged = both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("j"))
    return judged.groupBy("a", "b").agg(F.max("j").alias("j"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, label) of all ends of links (a, b): the smallest id that links lead to. Rounds of least neighbour label,
    then the label of the label, until nothing changes; each round is a durable table."""
    edges = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(edges.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("least"))
        step = labels.select("doc", "label").join(near, "doc").select("doc", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("doc").alias("label"), F.col("label").alias("further"))
        fresh = scratch.save(step.join(jump, "label", "left").select("doc", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        scratch.free(labels)
        if fresh.filter("label <> old").limit(1).count() == 0:
            scratch.free(edges)
            return fresh.select("doc", "label")
        labels = fresh


def compare_with_leaders(members: DataFrame, company: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc, leader, j) of each bucket member but the leader: its similarity to its bucket's leader, the member with the most company."""
    known = scratch.save(members.join(company, "doc").select("key", "doc", (-F.col("c")).alias("c")))
    heads = scratch.save(known.groupBy("key").agg(F.min(F.struct("c", "doc")).alias("l"), F.count("*").alias("n")).select("key", F.col("l.doc").alias("leader"), "n"))
    asked = scratch.save(join_counted(known, heads, "key", "n", known.count()).filter("doc <> leader").select("key", "doc", "leader"))
    pairs = scratch.save(verified(asked.select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), sets))
    tried = scratch.save(asked.join(pairs, (F.col("doc") == F.col("a")) & (F.col("leader") == F.col("b"))).select("key", "doc", "leader", "j"))
    scratch.free(known, heads, asked, pairs)
    return tried


def prefix_rows(sets: DataFrame, label: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(key, doc, n, p, label): the shingles under which a document can meet one similar enough, rarest first, and its label, or itself where it has none.

    n is the size of the document's set and p the shingle's place in it, in one order for all
    documents, by how many have it. Of two sets of similarity t or more, the first shingle that both
    have leaves n - p + 1 >= t*n places in either: what stands later is no key. Shingles of one document
    only stand first and are no key at all, so a document with more than 1 - t of its shingles to itself has none.
    """
    numbered = sets.select("doc", F.monotonically_increasing_id().alias("set"), F.size("sh").alias("n"), "sh")
    flat = scratch.save(numbered.select("doc", "set", "n", F.explode("sh").alias("key")))
    counts = scratch.save(flat.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = join_counted(flat, counts, "key", "df", flat.count())
    ordered = shared.groupBy("doc", "set", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("x"))  # of one text each
    place = ordered.select("doc", "n", (F.col("n") - F.size("x")).alias("alone"), F.posexplode(F.transform("x", lambda y: y["key"])).alias("at", "key"))
    prefix = place.select("key", "doc", "n", (F.col("alone") + F.col("at") + 1).alias("p")).filter(F.col("n") - F.col("p") + 1 >= F.lit(threshold) * F.col("n") - 1e-9)
    rows = scratch.save(prefix.join(label, "doc", "left").select("key", "doc", "n", "p", F.coalesce("label", "doc").alias("label")))
    scratch.free(flat, counts)
    return rows


def links_between_classes(sets: DataFrame, label: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b) of all pairs of sets similar enough that have different labels.

    Two sets meet under the keys of prefix_rows. Under the first key that both have, they share at most
    n - p + 1 shingles on either side, and similarity t asks for t/(1+t) of both sizes: pairs whose places
    and sizes can't do that are never made. In each bucket, rows of its largest class ask no one, as
    every pair of classes has another side; those that ask first meet the (n, p) that the bucket holds, counted
    out before, and then only rows of those that can do. So a bucket of n copies and few others makes few
    pairs, whatever n is, and none is lost.
    """
    rows = prefix_rows(sets, label, threshold, scratch)
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("classes"), F.sum("c").alias("rows"))
    mixed = scratch.save(parts.filter("classes > 1").select("key", F.col("most.label").alias("home"), "rows"))
    known = scratch.save(join_counted(rows, mixed, "key", "rows", rows.count()).select("key", "doc", "n", "p", "label", (F.col("label") == F.col("home")).alias("at_home")))
    scratch.free(rows, mixed)
    asking = known.filter(~F.col("at_home")).select("key", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("label").alias("la"))
    cells = known.groupBy("key", "n", "p").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("n")) - 1e-9
    fits = F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("p")) + 1 >= need
    able = scratch.save(asking.join(cells, "key").filter(fits & ((F.col("low") != F.col("la")) | (F.col("high") != F.col("la")))).select("key", "a", "la", "n", "p"))
    met = able.join(known, ["key", "n", "p"]).filter((F.col("label") != F.col("la")) & (F.col("at_home") | (F.col("a") < F.col("doc"))))
    pairs = scratch.save(met.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct())
    scratch.free(known, able)
    links = scratch.save(verified(pairs, sets).filter(F.col("j") >= threshold).select("a", "b"))
    scratch.free(pairs)
    return links


def near_classes(docs: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(doc, label) of all texts that verified links connect, the label being the smallest doc of a class.

    A band bucket's members are compared with one leader, the member with the most company in all its
    buckets: a group of n copies costs n comparisons, not n squared. Where all of a bucket pass, they are
    connected. The members of buckets in which some fail (texts that share a passage fill large ones) are
    searched once more, by exact prefixes, for all links between classes that are still apart. `texts`, a table of
    scratch, and the tables made on the way are deleted as soon as nothing reads them.
    """
    buckets = texts.select("doc", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = scratch.save(sizes)
    members = scratch.save(join_counted(buckets, sizes, "key", "n", texts.count() * BANDS))
    company = scratch.save(members.groupBy("doc").agg(F.sum("n").alias("c")))
    ids = scratch.save(company.select("doc").join(texts.select("doc", "th"), "doc"))
    scratch.free(sizes, texts)
    found = docs.select(F.col("doc_id").alias("doc"), F.md5("text").alias("th"), "text").join(small(ids), ["doc", "th"], "left_semi")
    sets = scratch.save(found.select("doc", "th", shingle_set("text").alias("sh")).dropDuplicates(["doc", "th"]).select("doc", "sh"))
    scratch.free(ids)
    tried = compare_with_leaders(members.select("key", "doc"), company, sets, scratch)
    scratch.free(company)
    label = components(tried.filter(F.col("j") >= threshold).select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), scratch)
    failed = tried.filter(F.col("j") < threshold).select("key").distinct()
    unsure = scratch.save(members.join(failed, "key", "left_semi").select("doc").distinct())
    scratch.free(members, tried)
    if unsure.limit(1).count() == 0:
        return label
    asked = scratch.save(sets.join(unsure, "doc", "left_semi"))
    scratch.free(sets, unsure)
    late = links_between_classes(asked, label, threshold, scratch)
    if late.limit(1).count() == 0:
        return label
    side = lambda end: label.select(F.col("doc").alias(end), F.col("label").alias(f"label_{end}"))
    named = late.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    merged = components(named.distinct(), scratch).select(F.col("doc").alias("label"), F.col("label").alias("whole"))
    alone = late.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(label, "doc", "left_anti").select("doc", F.col("doc").alias("label"))
    return scratch.save(label.union(alone).join(merged, "label", "left").select("doc", F.coalesce("whole", "label").alias("label")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, kept, text_md5) for each row of docs.

    Equal texts are one node, under the smallest id. Nodes are linked where the Jaccard similarity of
    their sets of five-word shingles (lower-cased; a text of fewer words is one shingle) is at least
    `threshold`; candidates share a band of their ProbMinHash signatures, in which a shingle weighs
    the same however often a text repeats it. A class is what links connect; its id is its smallest doc_id, and that
    document is kept. Texts are never shuffled, shingle sets of bucket members only; what else moves
    are ids and keys. Ids may be of any type that has an order.

    Null texts and texts without words are similar to nothing: classes of their own. Rows without id
    have class null and are kept. Rows that share an id are judged each by its own text. Empty input: empty result.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.save(docs.select("doc_id", F.md5("text").alias("th"), bands_of("text").alias("bands")))
    wordy = rows.filter("doc_id is not null and size(bands) > 0")  # bands, the most of what is written here, go once texts have them
    texts = scratch.save(wordy.groupBy("th").agg(F.min(F.struct("doc_id", "bands")).alias("x"), F.count("*").alias("rows")).select("th", F.col("x.doc_id").alias("doc"), F.col("x.bands").alias("bands"), "rows"))
    narrow = scratch.save(rows.select("doc_id", "th", (F.col("doc_id").isNotNull() & (F.size("bands") > 0)).alias("wordy")))
    scratch.free(rows)
    nodes = scratch.save(texts.select("th", "doc", "rows"))
    label = near_classes(docs, texts, threshold, scratch)
    classes = scratch.save(nodes.join(label, "doc", "left").select("th", F.coalesce("label", "doc").alias("class_id"), "rows"))
    sizes = scratch.save(classes.groupBy("class_id").agg(F.sum("rows").alias("class_size")))
    total = narrow.count()
    sized = scratch.save(join_counted(classes, sizes, "class_id", "class_size", total))
    known = join_counted(narrow.filter("wordy").select("doc_id", "th"), sized, "th", "rows", total)
    alone = narrow.filter("not wordy").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "th")
    out = known.select("doc_id", "class_id", "class_size", "th").union(alone)
    out = durable(out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("th").alias("text_md5")))
    scratch.clear()
    return out


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, and all rows without id; all columns as they were.

    Where rows share an id, those whose own text is in another document's class go, and of equal ones one stays.
    """
    found = near_duplicates(docs, threshold, id_col, text_col)
    keys = lambda df: df.select(F.col("doc_id").alias("_near_id"), F.col("text_md5").alias("_near_md5"))
    same = F.col(id_col).eqNullSafe(F.col("_near_id")) & F.md5(text_col).eqNullSafe(F.col("_near_md5"))
    left = docs.join(small(keys(found.filter(~F.col("kept"))).distinct()), same, "left_anti")
    stay = found.filter("kept and doc_id is not null")
    if stay.groupBy("class_id").count().filter("count > 1").limit(1).count() == 0:
        return left
    marked = left.join(small(keys(stay).distinct()), same, "left_semi").dropDuplicates([id_col])
    return marked.unionByName(left.filter(F.col(id_col).isNull()))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_md5")
