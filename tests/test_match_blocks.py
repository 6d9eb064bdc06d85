"""Blocks of matching against all pairs, by either way for texts to meet, and the plan that scores their pairs."""

import pytest
from ledgerloom.operators import matching, stores, suggestions
from ledgerloom.plans import adapters
from ledgerloom.streaming import jobs
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def every_pair(bank, entries, cfg):
    """All pairs of all rows that J1 lets meet, with their final score: equal amounts, one day, or amounts within tolerance up to 3 days apart."""
    b, e = matching.prepared(bank, "b", ["category", "transaction_id"]), matching.prepared(entries, "e", ["category", "cost_center"])
    days, cents = F.abs(F.datediff("b_date", "e_date")), [F.abs(F.col(f"{s}_amount")) for s in "be"]
    meet = (cents[0] == cents[1]) | (days == 0) | ((days <= 3) & (F.abs(cents[0] - cents[1]) <= F.lit(cfg.tolerance).cast("decimal(4,2)") * cents[0]))
    pairs = b.crossJoin(e).filter(meet).withColumns(matching.base_score(cfg)).withColumns(matching.quality_scores())
    base = F.least(F.lit(1.0), F.col("amount_score") + F.col("date_score") + cfg.text * F.col("text_similarity") + 0.1 * F.col("entity_bonus") + F.col("reference_bonus"))
    score = F.round(F.least(F.lit(1.0), 0.7 * F.least(F.lit(0.95), base) + 0.3 * (0.3 * F.col("data_quality") + 0.25 * F.col("outlier") + 0.2 * F.col("temporal"))), 6)
    return pairs.withColumn("score", score).filter(F.col("score") >= cfg.threshold).localCheckpoint()


def listed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("few_texts", [200_000, 0])
def test_blocks_and_rounds_hold_what_all_pairs_hold(spark, monkeypatch, few_texts):
    monkeypatch.setattr(matching, "FEW_TEXTS", few_texts)
    bank, entries, cfg = adapters.bank_tx(spark, DIR).filter("id < 300"), adapters.ledger(spark, DIR).filter("id < 600"), matching.MatchConfig(threshold=0.5)
    # Some of few days, so that amounts meet from near to far, some equal, so that ties are cut.
    bank = bank.withColumn("date", F.when(F.col("id") % 2 == 0, F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 3).cast("int"))).otherwise(F.col("date")))
    entries = entries.withColumn("date", F.when(F.col("id") % 2 == 0, F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 5).cast("int"))).otherwise(F.col("date")))
    entries = entries.unionByName(entries.withColumn("id", F.col("id") + 10_000))
    every = every_pair(bank, entries, cfg)
    assert listed(matching.pair_scores(bank, entries, cfg), "b_id", "e_id", "score") == listed(every, "b_id", "e_id", "score") and every.count() > 500
    assert listed(matching.pair_scores(bank, entries, cfg, fits=True), "b_id", "e_id", "score") == listed(every.filter(matching.valid(cfg)), "b_id", "e_id", "score")
    taken = every.filter("(b_id + e_id) % 4 = 0").select("b_id", "e_id")
    for k, only in ((3, None), (4, matching.valid(cfg))):
        want = matching.ranked(every if only is None else every.filter(only), k)
        assert listed(matching.best_pairs(bank, entries, k, cfg, only=only), "b_id", "e_id", "rank", "score") == listed(want, "b_id", "e_id", "rank", "score")
    want = matching.ranked(every.join(taken, ["b_id", "e_id"], "left_anti"), 3)
    assert listed(matching.best_pairs(bank, entries, 3, cfg, taken=taken), "b_id", "e_id", "rank", "score") == listed(want, "b_id", "e_id", "rank", "score")


def test_amounts_finer_than_cents_count_as_equal_below_a_cent(spark):
    """0.1000 and 0.1090 are more than the tolerance apart and no equal amounts, but M1 gives them its full score."""
    side = lambda rows: spark.createDataFrame(rows, "id long, amount string, date string").select("id", F.col("amount").cast("decimal(18,4)"), F.to_date("date").alias("date"), F.lit("TARIFA MENSAL").alias("description"), F.lit("x").alias("category"), F.lit("y").alias("cost_center"), F.lit("T-1").alias("transaction_id"))
    bank, entries = side([(1, "0.1000", "2024-01-02")]), side([(2, "0.1090", "2024-01-02"), (3, "0.1090", "2024-01-09"), (4, "0.1200", "2024-01-02")])
    cfg = matching.MatchConfig()
    want = listed(every_pair(bank, entries, cfg), "b_id", "e_id", "score")
    assert [x[:2] for x in want] == [(1, 2)] and listed(matching.pair_scores(bank, entries, cfg), "b_id", "e_id", "score") == want
    assert listed(matching.best_pairs(bank, entries, 3, cfg), "b_id", "e_id", "score") == want


def test_scores_are_not_made_in_conditions_of_joins(spark):
    """A filter on the score that Spark moves into a join makes each part of the score anew wherever it is mentioned."""
    bank, entries = adapters.bank_tx(spark, DIR), adapters.ledger(spark, DIR)
    plan = matching.pair_scores(bank, entries).select("b_id", "e_id", "score")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) >= 4 and not any("text_similarity" in line or "b_quality" in line for line in joins)


def test_batches_tell_their_schema(spark, tmp_path):
    """T1's work is not done once more on no rows, unless there was no batch."""
    spark.range(5).write.parquet(str(tmp_path / "in"))
    given = []

    def work(batch):
        given.append(batch.count())
        return batch.withColumn("twice", 2 * F.col("id"))

    read = lambda name: spark.readStream.schema("id long").parquet(str(tmp_path / name))
    assert sorted(r.twice for r in jobs.run_batches(read("in"), str(tmp_path / "a"), work).collect()) == [0, 2, 4, 6, 8] and given == [5]
    (tmp_path / "none").mkdir()
    nothing = jobs.run_batches(read("none"), str(tmp_path / "b"), work)
    assert nothing.columns == ["id", "twice", "batch"] and nothing.count() == 0


def test_history_finds_the_best_without_all_valid_pairs(spark, monkeypatch):
    """The best by classes are the best of all valid candidates, and these are not made where texts are few."""
    bank, entries = adapters.bank_tx(spark, DIR).filter("id < 400"), adapters.ledger(spark, DIR).filter("id < 800")
    entries = entries.unionByName(entries.withColumn("id", F.col("id") + 10_000).withColumn("date", F.date_add("date", (F.col("id") % 40).cast("int"))))
    kinds = [("amount", "close", 50, 0.5), ("amount", "exact", 30, 0.3), ("date", "extended", 40, 0.9), ("date", "same_day", 40, 0.2), ("description", "tarifa bancaria mensal||tarifa mensal", 9, 0.09), ("supplier", "ltda", 9, 0.1), ("time", "hour_9", 9, 0.1)]
    patterns = spark.createDataFrame([(*x, "high") for x in kinds], stores.PATTERNS)
    cols = ["b_id", "e_id", "rank", "score", "patterns_used", "recommendation", "severity"]
    for cfg in (matching.MatchConfig(threshold=0.6), matching.MatchConfig(threshold=0.5, top=2)):
        monkeypatch.setattr(matching, "FEW_TEXTS", 0)
        want = listed(suggestions.find_matches_learned(bank, entries, patterns, 9, cfg=cfg), *cols)
        with monkeypatch.context() as none:
            none.setattr(matching, "FEW_TEXTS", 200_000)
            none.setattr(suggestions, "valid_candidates", None)
            assert listed(suggestions.find_matches_learned(bank, entries, patterns, 9, cfg=cfg), *cols) == want and len(want) > 50
