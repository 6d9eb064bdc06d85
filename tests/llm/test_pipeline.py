"""The pipeline's stages, each on its own input, and the registered queries."""

import random
import re

import corpus_pipeline
import test_operators as ops
from ledgerloom.llm import quality, queries
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        if name != "shard":
            assert docs.columns == names, name
        docs = docs.cache()
        assert 0 < docs.count() <= 3 * rows
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(tuple, docs.collect()))


def test_each_stage_against_brute_force(spark, tmp_path):
    """On rows with nulls, repeated ids, ties, long texts and columns whose names the stages use inside."""
    rng = random.Random(12)
    bench = [ops.sentence(rng, 30) for _ in range(4)]
    texts = [*ops.ODD, *[ops.sentence(rng, rng.randint(6, 60)) for _ in range(60)], *[ops.sentence(rng, 20) + " " + b for b in bench], "word " * 5000]
    texts += [ops.near(rng, t, 1) for t in texts[40:60]] + [" ".join(w.upper() + "!!" for w in ops.sentence(rng, 30).split()) for _ in range(12)]
    docs = ops.docs_of(spark, texts, [rng.choice(["a", "b", None, "c"]) for _ in texts])
    docs = docs.withColumns({c: F.lit("clash") for c in ("class_id", "th", "cell", "row", "sid", "weight", "kept", "block")})
    docs = docs.union(docs.filter("doc_id in (20, 21)")).union(docs.filter("doc_id = 22").withColumn("doc_id", F.lit(None).cast("long"))).cache()
    spark.createDataFrame([(i, int(i < len(texts) - 12), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, stages, names = docs.collect(), dict(corpus_pipeline.STAGES), docs.columns
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    ids = lambda found: sorted(str(r.doc_id) for r in found)
    # Quality: the k largest keys, k being the rows over the cut.
    keys, model, _ = quality.draw_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    keyed = keys.collect()
    for r in keyed:
        assert r.grams >= 0 and (r.grams > 0 or r.weight == 0)
    k = sum(r.weight >= model.least * r.grams for r in keyed)
    best = {(r.key, r.tie) for r in sorted(keyed, key=lambda r: (-r.key, r.tie))[:k]}
    assert ids(run("quality").collect()) == sorted(str(r.id) for r in keyed if (r.key, r.tie) in best)
    # Near copies: one document of each class, the smallest id; rows without id all stay.
    classes = ops.brute_classes(texts)
    assert ids(run("near_dedup").collect()) == sorted([*map(str, set(classes)), "None"])
    # Leaks: documents that hold an item go.
    leaks = {i for i, _ in ops.brute_contained(texts, bench)}
    assert len(leaks) >= 4 and ids(run("decontaminate").collect()) == ids(r for r in rows if r.doc_id not in leaks)
    # Mix: as often as the words taken say.
    mixed = {}
    for r in corpus_pipeline.mix_sources(docs).collect():
        mixed[r.doc_id] = max(mixed.get(r.doc_id, 0), int(r.taken / r["size"] + 0.5) if r["size"] else 0)
    assert ids(run("mix").collect()) == sorted(str(r.doc_id) for r in rows for _ in range(mixed[r.doc_id]))
    # Shards: every row once, sizes and slots right, loads as bounded.
    shards = run("shard").collect()
    assert sorted(r["size"] for r in shards) == sorted(len((r.text or "").encode()) + 16 for r in rows)
    for s in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))
    for name in stages:
        assert name == "shard" or run(name).columns == names, name


def test_stages_of_no_documents(spark):
    empty = spark.read.parquet(f"{DIR}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def test_all_operators_and_the_pipeline_are_registered():
    found = queries.queries()
    assert {int(m[1]) for q in found if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14)) and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(found)
