"""Rules at their edges: classes of amounts, words next to letters beyond ASCII."""

from ledgerloom.functions import coerce
from ledgerloom.operators import context, matching, quality, stores, suggestions, tables
from ledgerloom.streaming.workflow import Workflow
from pyspark.sql import Row
from pyspark.sql import functions as F


def test_amounts_exactly_five_percent_apart_are_not_close(spark):
    rows = spark.createDataFrame([("1.40", "1.33"), ("-1.40", "1.34"), ("2.00", "-2.00"), ("1.33", "1.40")], "a string, b string")
    for kind in ("decimal(18,2)", "double"):
        got = rows.select(context.amount_class(F.col("a").cast(kind), F.col("b").cast(kind))).collect()
        assert [r[0] for r in got] == ["variable", "close", "exact", "variable"]


def test_words_end_at_letters_beyond_ascii(spark):
    rows = spark.createDataFrame([("que delñaróción", True, False), ("que delaroción", False, False), ("DEL x", True, False), ("ñselectñ", False, True), ("a_select_b", False, False)], "t string, command boolean, sql boolean")
    got = quality.scan_injection(rows, F.col("t")).collect()
    assert [(r.has_command, r.has_sql) for r in got] == [(r.command, r.sql) for r in got]


def test_sides_of_matching_are_never_broadcast(spark):
    bank = spark.createDataFrame([(i, f"T{i}", "10.00", "PIX CLIENTE SILVA") for i in range(5)], "id long, transaction_id string, amount string, description string")
    bank = bank.withColumns({"date": F.lit("2024-01-02").cast("date"), "amount": F.col("amount").cast("decimal(18,2)"), "category": F.lit("x"), "cost_center": F.lit("y"), "transaction_type": F.lit("credit")})
    patterns = spark.createDataFrame([], stores.PATTERNS)
    found = [matching.scored_pairs(bank, bank), suggestions.learned_pairs(bank, bank, patterns, 9)]
    for pairs in found:
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [b_id" in plan and "BroadcastHashJoin [b_id" not in plan and "BroadcastHashJoin [e_id" not in plan
        assert pairs.count() == 25
    b, e = (tables.shuffled(tables.written(matching.prepared(bank, s, []))) for s in "be")
    met = [matching.candidate_pairs(b, e, matching.MatchConfig()), suggestions.valid_candidates(*(tables.shuffled(suggestions.tokens(x, s, patterns)) for x, s in ((b, "b"), (e, "e"))), matching.MatchConfig(), "balanced")]
    assert all("BroadcastHashJoin [cents" not in p._jdf.queryExecution().executedPlan().toString() for p in met)


def test_rows_meet_only_where_their_texts_say_enough(spark):
    """One day of 400 rows a side whose amounts are apart: only texts alike enough meet, and pairs are neither shuffled nor joined in one task."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("PIX CLIENTE SILVA", "PIX FORNECEDOR ALFA", "PIX TARIFA MENSAL", "PIX ALUGUEL LOJA")]), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(400).select("id", text.alias("description"), F.lit("2024-01-02").cast("date").alias("date"), F.lit("x").alias("category"), F.lit("y").alias("cost_center"), F.concat(F.lit("T"), "id").alias("transaction_id"))
    bank, entries = rows.withColumn("amount", (100 + F.col("id")).cast("decimal(18,2)")), rows.withColumn("amount", (10_000 + 3 * F.col("id")).cast("decimal(18,2)"))
    b, e = matching.prepared_sides(bank, entries)
    met = matching.candidate_rows(b, e, matching.MatchConfig())
    assert met.count() == 4 * 100 * 100 and met.select("b_id", "e_id").distinct().count() == 40_000  # 160,000 share a day and a word
    plan = matching.pair_scores(bank, entries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 4 and "hashpartitioning(b_id" not in plan and "hashpartitioning(e_id" not in plan
    every = {(r.b_id, r.e_id) for r in matching.scored_pairs(bank, entries).select("b_id", "e_id").collect()}
    assert {(r.b_id, r.e_id) for r in matching.pair_scores(bank, entries).select("b_id", "e_id").collect()} == every


def test_dates_and_numbers_are_tried_where_they_can_be(spark):
    texts = ["2024-01-31", " 31/01/2024 ", "01/31/2024", "31-01-2024", "2024/01/31", "31.01.2024", "2024.01.31", "2024-02-30", "1/1/2024", "+12024-01-31", "-2024-01-31", "2024-01/31", "12.34", "31/01/2024 x", "31/01/2024\n", "٣١/٠١/٢٠٢٤", "", None, "sim"]
    texts += ["1e3", " 1.5 ", "+.5", "-5.", "NaN", "Infinity", "-inf", "inf", "1d", "2F", "0x1p3", "1_0", "R$ 5", "5%", "--1", "nao", "1 2", "\t7\n", "."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_date(F.trim("t"), f) for f in coerce.DATE_FORMS])
    got = rows.select("t", plain.eqNullSafe(coerce.coerce_date(F.col("t"))).alias("date"), F.col("t").try_cast("double").eqNullSafe(coerce.try_number(F.col("t"))).alias("number")).collect()
    assert [r.t for r in got if not (r.date and r.number)] == []
    plan = rows.select(coerce.coerce_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()  # a form is not tried on just any text


class Calls:
    """A state's handle that counts what it is asked."""

    def __init__(self, value=None):
        self.now, self.timers, self.asked = value, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.now

    def exists(self):
        self.asked += 1
        return self.now is not None

    def update(self, value):
        self.asked, self.now = self.asked + 1, value

    def listTimers(self):
        self.asked += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)


def test_workflow_state_asks_little_and_keeps_one_timer():
    held, work = Calls(), Workflow()
    work.init(held)
    minute = 60_000_000
    give = lambda at, action, role: list(work.handleInputRows((1,), iter([Row(at=at, seq=0, action=action, role=role)]), None))
    give(0, "submit_for_review", "operator")
    assert held.now[0] == "pending_review" and held.timers == {1440 * 60_000 + 1} and held.asked == 3
    give(minute, "nothing", "operator")
    assert held.timers == {1440 * 60_000 + 1} and held.asked == 5
    give(2 * minute, "approve_review", "reviewer")
    assert held.now[0] == "pending_approval" and held.timers == {2882 * 60_000 + 1} and held.asked == 9


def test_blocks_are_ranked_before_they_meet(spark, monkeypatch):
    """M21's and W2's plans hold no block's join, and what is taken makes room for the next best, however many pairs of a bank row are."""
    rows = spark.range(120).select("id", F.lit("PIX CLIENTE SILVA").alias("description"), F.date_add(F.lit("2024-01-02").cast("date"), (F.col("id") % 3).cast("int")).alias("date"), F.lit("x").alias("category"), F.lit("y").alias("cost_center"), F.concat(F.lit("T"), "id").alias("transaction_id"))
    rows = rows.withColumn("amount", (100 + F.col("id") % 40).cast("decimal(18,2)"))
    taken = spark.range(240).select((F.col("id") % 60).alias("b_id"), (F.col("id") % 60 + F.floor(F.col("id") / 60) * 3).alias("e_id"))
    pairs = matching.pair_scores(rows.limit(80), rows).select("b_id", "e_id", "score").localCheckpoint()
    listed = lambda df: sorted(tuple(r) for r in df.select("b_id", "e_id", "rank", "score").collect())
    want = listed(matching.ranked(pairs.join(taken, ["b_id", "e_id"], "left_anti"), 5))
    for most in (20, 3):
        monkeypatch.setattr(matching, "TAKEN", most)
        found = matching.best_pairs(rows.limit(80), rows, 5, taken=taken)
        assert listed(found) == want and want
        assert "REPARTITION_BY_NUM" not in found._jdf.queryExecution().executedPlan().toString()
