"""Reconciliation operators on literal rows, and each registered query against its SQL on the smallest tables."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import coerce, text
from ledgerloom.operators import anomaly, decisions, joins, matching, quality, reports, windows, workflow
from ledgerloom.plans import adapters, registry
from ledgerloom.sources import ledger, ofx

DIR = "/root/testdata/sf0.001"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_amount_texts(spark):
    rows = [(t,) for t in ("1.500,00", "1,500.00", "R$ 1.500,00", "1500", "1500,00", "-1500.00", None, "abc", "(12,5)")]
    got = values(spark, rows, "t string", coerce.parse_amount_text(F.col("t")), coerce.coerce_amount(F.col("t")))
    assert [g[0] for g in got] == [1500.0] * 6 + [None, None, 12.5]
    assert [got[i][1] for i in (0, 3, 4, 5, 6, 7, 8)] == [1500.0, 1500.0, 1500.0, -1500.0, 0.0, 0.0, -12.5]


def test_dates_and_descriptions(spark):
    rows = [("em 31/12/2024 pago", "PIX - Ana"), ("2024-02-30 ou 2024-03-01", None), (None, "TEDIO"), ("01.02.2024", "  compra  ")]
    got = values(spark, rows, "d string, t string", coerce.parse_date_text(F.col("d")), coerce.clean_description(F.col("t")))
    assert [g[0] for g in got] == [dt.date(2024, 12, 31), None, None, dt.date(2024, 2, 1)]
    assert [g[1] for g in got] == ["Ana", "Transação sem descrição", "TEDIO", ""]


def test_similarity_and_categories(spark):
    rows = [("Compra Loja", "compra loja", "x"), ("compra", "compra loja", "x"), ("abc", "xyz", "x"), ("", "a", "x")]
    got = values(spark, rows, "a string, b string, c string", text.simple_similarity(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.8, 0.8, 0.0, 0.0]
    rows = [("DARF simples",), ("Salário",), (None,), ("nada",), ("Farmácia central",)]
    assert [g[0] for g in values(spark, rows, "d string", text.categorize(F.col("d")))] == ["impostos", "salario", "outros", "outros", "saude"]


OFX = """OFXHEADER:100
DATA:OFXSGML
<OFX><BANKMSGSRSV1><STMTRS><BANKID>104<ACCTID>12345-6
<BANKTRANLIST><!-- note --><STMTTRN><TRNTYPE>DEBIT</TRNTYPE><DTPOSTED>20240802120000[-3:BRT]</DTPOSTED><TRNAMT>-200.0</TRNAMT><FITID>BRAD2024</FITID><MEMO>TED Fornecedor João LTDA</MEMO></STMTTRN>
<STMTTRN>
<TRNTYPE>OTHER
<DTPOSTED>20240803
<TRNAMT>424,93
<FITID>77
<NAME>Cliente
</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>2350.00</LEDGERBAL>"""


def test_statements(spark):
    files = spark.createDataFrame([("a", OFX), ("b", "not a statement"), ("c", None)], "path string, text string")
    got = [(r.account_id, r.transaction_id, r.timestamp.date().isoformat(), float(r.amount), r.description, r.transaction_type, float(r.balance)) for r in ofx.statement_rows(files).orderBy("seq").collect()]
    assert got == [("12345-6", "BRAD2024", "2024-08-02", -200.0, " Fornecedor João LTDA", "debit", 2350.0), ("12345-6", "77", "2024-08-03", 424.93, "Cliente", "credit", 2350.0)]
    assert spark.createDataFrame([(OFX,)], "t string").select(ofx.repair(F.col("t"))).first()[0].endswith("</OFX>")


def test_running_balance_and_duplicates(spark):
    rows = [(i, "a", dt.date(2024, 1, 1 + i), x, "d") for i, x in enumerate(("1000", "-250.50", "-100.25", "500"))] + [(9, "b", None, None, None), (10, "b", None, None, None)]
    tx = spark.createDataFrame(rows, "id long, account_id string, date date, amount string, description string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    assert {r.id: r.balance for r in windows.running_balance(tx.filter("account_id = 'a'")).collect()}[3] == 1149.25
    assert [tuple(r) for r in joins.batch_duplicates(tx).collect()] == [(10, 9)]


def test_blocks_hold_every_pair_that_can_match(spark):
    """Against all pairs of a few hundred rows: no pair that scores enough lies outside the blocks."""
    bank, entries = adapters.bank_tx(spark, DIR).filter("id < 240"), adapters.ledger(spark, DIR).filter("id < 360")
    cfg = matching.MatchConfig()
    got = {(r.b_id, r.e_id) for r in matching.scored_pairs(bank, entries, cfg).collect()}
    b, e = matching.prepared(bank, "b", ["category", "transaction_id"]), matching.prepared(entries, "e", ["category", "cost_center"])
    every = b.crossJoin(e).withColumns(matching.base_score(cfg)).withColumns(matching.quality_scores())
    base = F.least(F.lit(1.0), F.col("amount_score") + F.col("date_score") + 0.3 * F.col("text_similarity") + 0.1 * F.col("entity_bonus") + F.col("reference_bonus"))
    score = F.round(F.least(F.lit(1.0), 0.7 * F.least(F.lit(0.95), base) + 0.3 * (0.3 * F.col("data_quality") + 0.25 * F.col("outlier") + 0.2 * F.col("temporal"))), 6)
    assert got == {(r.b_id, r.e_id) for r in every.filter(score >= cfg.threshold).select("b_id", "e_id").collect()} and got


def test_config_is_checked():
    with pytest.raises(ValueError):
        matching.MatchConfig(threshold=1.5)
    with pytest.raises(ValueError):
        matching.MatchConfig().check_saved()
    matching.MatchConfig(exact=0.3, close=0.1, same_day=0.2, near_day=0.1, text=0.3).check_saved()


def test_anomalies_of_literal_pairs(spark):
    rows = [
        (1, 0.9, "100.00", "100.00", dt.date(2024, 1, 3), dt.date(2024, 1, 3), "Compra Loja", "Compra Loja", None, "outros", "debit", "expense"),
        (2, 0.9, "100.00", "12000.00", dt.date(2024, 1, 6), dt.date(2024, 6, 1), "abc", "xyz", "Alimentacao", "transporte", "credit", "expense"),
    ]
    pairs = spark.createDataFrame(rows, "id long, match_score double, ba string, ea string, bank_date date, entry_date date, bank_description string, entry_description string, bank_category string, entry_category string, bank_type string, entry_type string")
    pairs = pairs.withColumns({"bank_amount": F.col("ba").cast("decimal(18,2)"), "entry_amount": F.col("ea").cast("decimal(18,2)")})
    a, b = anomaly.analyze(pairs).orderBy("id").collect()
    assert (a.n_anomalies, a.total, a.severity, a.confidence, a.review, a.advice) == (0, 0.0, "low", "high", False, [])
    assert [x.type for x in b.anomalies] == ["amount_mismatch", "date_discrepancy", "description_mismatch", "category_conflict", "unusual_pattern"]
    assert (b.total, b.severity, b.primary_type, b.review) == (1.0, "critical", "amount_mismatch", True) and len(b.advice) == 6 and b.priority <= 10
    assert b.anomalies[4].severity == "high" and b.anomalies[4].score == 0.9 and b.anomalies[2].score == 0.8


def test_scans_and_validation(spark):
    texts = ["plain words", "<SCRIPT>x</script>", "a' OR 'b'='b", "..%2Fup", "x; ls", None]
    got = values(spark, [(t,) for t in texts], "t string", *[quality.has_any(F.col("t"), p, f) for p, f in ((quality.XSS, "is"), (quality.SQL_INJECTION, "i"), (quality.TRAVERSAL, "i"), (quality.COMMAND, "i"))])
    assert got == [(False,) * 4, (True, True, False, True), (False, True, False, False), (False, False, True, False), (False, False, False, True), (False,) * 4]
    urls = ["http://a.example/x?page=select", "http://a.example/x?q=1%20or%201%3D1", "http://a.example/%3Cscript%3E1%3C/script%3E", "http://a.example/fine?x=y"]
    got = quality.scan_urls(spark.createDataFrame([(u,) for u in urls], "u string"), F.col("u")).collect()
    assert [(r.bad_path, r.bad_query) for r in got] == [(False, False), (False, True), (True, False), (False, False)]
    tx = spark.createDataFrame([("contestação",), ("um teste",), ("aaaaaaaaaaaa",)], "description string").withColumns({"amount": F.lit(1).cast("decimal(18,2)"), "date": F.lit("2024-01-01").cast("date"), "bank_name": F.lit("Itau")})
    assert [r.warnings for r in quality.transaction_rules(tx, "2024-01-02").collect()] == [[], ["suspicious description"], ["suspicious description"]]


def test_ledger_headers_and_types():
    assert ledger.map_headers(["Data", "Histórico", "Valor (R$)", "Date", "foo bar!"]) == {"Data": "data", "Histórico": "description", "Valor (R$)": "valor", "Date": "data_1", "foo bar!": "foo bar"}


def test_decisions_in_turn_and_empty_reports(spark):
    records = spark.createDataFrame([(1, "pending"), (2, "confirmed"), (3, "rejected")], "id long, status string")
    asked = spark.createDataFrame([(1, 1, "reject"), (1, 2, "confirm"), (2, 1, "confirm"), (3, 1, "confirm"), (9, 1, "confirm"), (2, 2, "x")], "id long, seq long, action string")
    got = {(r.id, r.seq): (r.outcome, r.new_status) for r in decisions.apply_decisions(records, asked).collect()}
    assert got == {(1, 1): ("done", "rejected"), (1, 2): ("conflict", "rejected"), (2, 1): ("unchanged", "confirmed"), (3, 1): ("conflict", "rejected"), (9, 1): ("not found", None), (2, 2): ("unknown action", "confirmed")}
    assert decisions.decision_summary(decisions.apply_decisions(records, asked.filter("false"))).first().success_rate is None
    assert reports.recon_report(records.filter("false").withColumn("match_score", F.lit(1.0))).first().rate is None


def test_quantiles_equal_those_of_one_sort(spark):
    import numpy as np

    xs = np.round(np.random.default_rng(1).normal(0, 300, 3001), 2)
    rows = spark.createDataFrame([(str(x),) for x in xs], "a string").select(F.col("a").cast("decimal(18,2)").alias("amount"))
    assert np.allclose(reports.quantiles(rows, "amount", [0.0, 0.01, 0.5, 0.99, 1.0]), np.quantile(xs, [0.0, 0.01, 0.5, 0.99, 1.0]))
    assert reports.quantiles(rows.filter("false"), "amount", [0.5]) == []


def test_replay_leaves_invalid_moves_out(spark):
    log = spark.createDataFrame([(1, 1, "submit_for_review", "operator"), (1, 2, "approve_final", "approver"), (1, 3, "approve_review", "reviewer"), (2, 1, "cancel", "admin")], "record long, seq long, action string, role string")
    assert {r.record: (r.state, r.applied, r.invalid) for r in workflow.replay_workflow(log).collect()} == {1: ("pending_approval", 2, 1), 2: ("draft", 0, 1)}


def plain(x):
    return "~" if pd.isna(x) else repr(round(x, 8)) if isinstance(x, float) and not x.is_integer() else str(int(x)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "events documents pages benchmark labels orders lineitem customer".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
