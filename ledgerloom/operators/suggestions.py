"""Matching in the light of learned patterns: M20 with history and analysis, M22's suggestions, predictions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import ENTITIES, entity_list, entity_similarity, text_similarity
from ledgerloom.operators import anomaly
from ledgerloom.operators.context import MODES, amount_class, contextual, date_class
from ledgerloom.operators.decisions import score_explanations
from ledgerloom.functions.similar import reference_bonus
from ledgerloom.operators import matching
from ledgerloom.operators.matching import MatchConfig, base_score, completeness, finer_amounts, one_a_text, prepared, quality_scores, ranked, recommendation, row_scores, text_tokens, valid, with_base_scores
from ledgerloom.operators.tables import few, hinted, shuffled, written

#: Days of a date bucket of valid pairs.
SPAN = 31
#: Bank rows that are alike in these have the same suggestions.
GROUP = ["b_description", "b_cents", "b_date"]
#: Parts into which the groups that ask for one key are dealt.
SALTS = 8


def lowest_base(cfg: MatchConfig, mode: str) -> float:
    """The least base score with which a pair without a learned description pattern can reach the threshold, all else at its best."""
    w = MODES[mode]
    bonus = 0.2 * w["supplier"] + 0.2 * w["amount"] + 0.2 * w["date"] + 0.1 * w["time"]
    return (cfg.threshold - 0.3 * (0.3 + 0.25 * 0.4 + 0.25 + 0.2)) / 0.7 - bonus


def tokens(side: DataFrame, s: str, patterns: DataFrame) -> DataFrame:
    """A prepared side with `{s}_tokens`: its words, its entities, and the learned description patterns of which its text is this side.

    Each pattern has over 1 % of the records, so there are fewer than 100: they are broadcast.
    """
    ends = patterns.filter("type = 'description'").select(F.split_part("pattern", F.lit("||"), F.lit(1 if s == "b" else 2)).alias("_norm"), F.concat(F.lit("p:"), "pattern").alias("_p"))
    known = ends.groupBy("_norm").agg(F.collect_set("_p").alias("_patterns"))
    met = side.join(F.broadcast(known), F.col(f"{s}_norm") == F.col("_norm"), "left").drop("_norm")
    return met.withColumn(f"{s}_tokens", F.array_distinct(F.concat(text_tokens(s), F.coalesce("_patterns", F.array().cast("array<string>"))))).drop("_patterns")


def valid_candidates(b: DataFrame, e: DataFrame, cfg: MatchConfig, mode: str) -> DataFrame:
    """Distinct (b_id, e_id) of all pairs that J2 lets pass and that can reach the threshold with history.

    Amounts within tolerance share a logarithmic bucket or are one or two apart, dates a bucket of SPAN days or the next. Pairs whose
    amount and date alone, with a reference, can't do must share a token, or one text of one or two words must stand inside the other;
    they meet under their smallest common token. The others are pairs of equal cents within three days, unless the configuration
    gives more to close amounts: then its whole buckets are taken.
    """
    step = F.log(F.lit(1.0 + cfg.tolerance))
    bucket = lambda c: F.floor(F.log(F.abs(F.col(c)).cast("double")) / step)
    day = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / SPAN)
    reach = 1 if cfg.max_days <= SPAN else -(-cfg.max_days // SPAN)
    left = b.select("b_id", "b_amount", "b_date", "b_norm", "b_tokens", bucket("b_amount").alias("k"), day("b_date").alias("d"))
    right = e.select("e_id", "e_amount", "e_date", "e_norm", "e_tokens", F.explode(F.sequence(bucket("e_amount") - 2, bucket("e_amount") + 2)).alias("k"), day("e_date").alias("d0"))
    right = right.withColumn("d", F.explode(F.sequence(F.col("d0") - reach, F.col("d0") + reach))).drop("d0")
    fits, alone = valid(cfg), cfg.reference + 1e-9
    worded = lambda df, s: df.withColumn("token", F.explode(f"{s}_tokens"))
    parts = [worded(left, "b").join(worded(right, "e"), ["k", "d", "token"]).filter(fits & (F.col("token") == F.array_min(F.array_intersect("b_tokens", "e_tokens"))))]
    short = lambda s: (F.size(F.split(f"{s}_norm", " ")) <= 2) & (F.col(f"{s}_norm") != "")
    inside = F.col("e_norm").contains(F.col("b_norm")) | F.col("b_norm").contains(F.col("e_norm"))
    parts += [left.filter(short("b")).join(right.filter("e_norm <> ''"), ["k", "d"]).filter(fits & inside), right.filter(short("e")).join(left.filter(~short("b") & (F.col("b_norm") != "")), ["k", "d"]).filter(fits & inside)]
    least = lowest_base(cfg, mode)
    if cfg.close + cfg.same_day + alone >= least or cfg.exact + alone >= least:
        parts.append(left.join(right, ["k", "d"]).filter(fits))
    elif cfg.exact + max(cfg.same_day, cfg.near_day) + alone >= least:
        cents = right.select("e_id", "e_amount", "e_date").distinct().select("e_id", F.abs("e_amount").alias("cents"), F.explode(F.sequence(F.date_sub("e_date", 3), F.date_add("e_date", 3))).alias("day"))
        parts.append(left.select("b_id", F.abs("b_amount").alias("cents"), F.col("b_date").alias("day")).join(cents, ["cents", "day"]))
    return reduce(DataFrame.union, [p.select("b_id", "e_id") for p in parts]).distinct()


def learned_sides(bank: DataFrame, entries: DataFrame, patterns: DataFrame) -> list[DataFrame]:
    """Both prepared sides with tokens and completeness, written."""
    b = prepared(bank, "b", ["category", "transaction_id", "transaction_type"]).withColumn("b_quality", completeness("b"))
    e = prepared(entries, "e", ["category", "cost_center", "transaction_type"]).withColumn("e_quality", completeness("e"))
    return [shuffled(written(tokens(b, "b", patterns))), shuffled(written(tokens(e, "e", patterns)))]


def learned_final(pairs: DataFrame, cfg: MatchConfig, cap: float) -> DataFrame:
    """M11 with history over a pair's parts: C9's `contextual` of its base and total_bonus, and the final `score` where it reaches the threshold. A list of one keeps
    that filter above the making of the score, as in final_scores."""
    base = F.least(F.lit(1.0), F.col("amount_score") + F.col("date_score") + cfg.text * F.col("text_similarity") + 0.1 * F.col("entity_bonus") + F.col("reference_bonus"))
    trust = 0.3 * F.col("data_quality") + 0.25 * F.col("pattern_consistency") + 0.25 * F.col("outlier") + 0.2 * F.col("temporal")
    pairs = pairs.withColumn("contextual", F.least(base + F.col("total_bonus"), F.lit(cap)))
    pairs = pairs.withColumn("_final", F.least(F.lit(1.0), 0.7 * F.col("contextual") + 0.3 * trust)).withColumn("_final", F.explode(F.array("_final"))).filter(F.col("_final") >= cfg.threshold - 1e-6)
    return pairs.withColumn("score", F.explode(F.array(F.round("_final", 6)))).filter(F.col("score") >= cfg.threshold).drop("_final")


def learned_scores(met: DataFrame, b: DataFrame, e: DataFrame, patterns: DataFrame, hour: int, mode: str, cfg: MatchConfig) -> DataFrame:
    """Pairs (b_id, e_id) that reach the threshold, with M1 (M4 and near references included), C9 over it, M7 to M10 and the final `score`."""
    pairs = met.join(b.drop("b_tokens"), "b_id").join(e.drop("e_tokens"), "e_id")
    pairs = with_base_scores(pairs, b, e, cfg).withColumns(quality_scores())
    base = F.least(F.lit(1.0), F.col("amount_score") + F.col("date_score") + cfg.text * F.col("text_similarity") + 0.1 * F.col("entity_bonus") + F.col("reference_bonus"))
    return learned_final(contextual(pairs.withColumn("base", base), patterns, F.col("base"), hour, mode), cfg, MODES[mode]["cap"])


def learned_pairs(bank: DataFrame, entries: DataFrame, patterns: DataFrame, hour: int, mode: str = "balanced", cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """M11 in full: valid pairs that reach the threshold, with M1 (M4 and near references included), C9 over it, M7 to M10 and the final `score` (M12's parts are its columns)."""
    b, e = learned_sides(bank, entries, patterns)
    return learned_scores(written(valid_candidates(b, e, cfg, mode)), b, e, patterns, hour, mode, cfg)


def text_cells(b: DataFrame, e: DataFrame, patterns: DataFrame, hour: int, mode: str, cfg: MatchConfig) -> DataFrame:
    """Of all pairs of different texts (b_text, e_text) M1's parts and, by amount and date class (`amounts`, `dates`), what history adds: both hang on nothing else."""
    amount = lambda x: F.lit(x).cast("decimal(28,6)")
    said = {k: v for k, v in base_score(cfg).items() if k in ("text_similarity", "entity_bonus")}
    pairs = one_a_text(b, "b").crossJoin(F.broadcast(one_a_text(e, "e"))).withColumns(said)
    pairs = pairs.withColumns({"b_amount": amount(100), "b_date": F.lit("2024-01-01").cast("date"), "e_amount": F.explode(F.array(amount(100), amount(101)))})
    pairs = pairs.withColumn("e_date", F.explode(F.array(*[F.date_add("b_date", n) for n in (0, 2, 5, 30)])))
    classes = {"amounts": amount_class(F.col("b_amount"), F.col("e_amount")), "dates": date_class(F.col("b_date"), F.col("e_date"))}
    told = contextual(pairs, patterns, F.lit(0.0), hour, mode).withColumns(classes)
    return written(told.select("b_text", "e_text", *said, F.col("e_description").alias("_entry"), *classes, "total_bonus", "pattern_consistency"))


#: Rounds of best_learned: an amount class and date classes, those that can score most first.
ROUNDS = [("exact", ["same_day", "few_days"]), ("close", ["same_day", "few_days"]), ("exact", ["week"]), ("exact", ["extended"]), ("close", ["week"]), ("close", ["extended"])]


def best_learned(b: DataFrame, e: DataFrame, patterns: DataFrame, hour: int, mode: str, cfg: MatchConfig) -> DataFrame:
    """(b_id, e_id) of the best valid pairs of each bank row by the full score, as best_pairs finds them: class by class, and a bank row goes on
    to a class only where a pair there can score as much as the last of its best. For few different texts and amounts of cents."""
    tasks, cap = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), MODES[mode]["cap"]
    equal = Window.partitionBy("e_text", "e_amount", "e_date", "e_quality").orderBy("e_id")
    firsts = e.select("e_id", "e_date", "e_amount", "e_text", "e_quality").withColumn("_nth", F.row_number().over(equal)).filter(F.col("_nth") <= cfg.top).drop("_nth")
    firsts, cells = shuffled(written(firsts)), text_cells(b, e, patterns, hour, mode, cfg)
    larger = -math.log(1 - math.ceil(100 * cfg.tolerance - 1e-9) / 100)  # J2's tolerance is of the larger amount
    step = max(2 * larger, 1e-3)
    bucket = lambda c, by=0.0: F.floor(F.log(F.abs(F.col(c)).cast("double")) / step + by / step)
    span = lambda c, by=0: F.floor((F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) + by) / SPAN)
    listed = lambda *days: F.array(*[F.lit(n) for n in days])
    off = F.when(F.col("dates") == "same_day", listed(0)).when(F.col("dates") == "few_days", listed(-3, -2, -1, 1, 2, 3)).when(F.col("dates") == "week", listed(-7, -6, -5, -4, 4, 5, 6, 7)).otherwise(F.array(F.lit(None).cast("int")))
    date = F.when(F.col("dates") == "same_day", cfg.same_day).when(F.col("dates") == "few_days", cfg.near_day).otherwise(0.0)
    outlier = F.when(F.col("dates") == "extended", 0.9).otherwise(1.0)
    rows, best = b.select("b_id", "b_date", "b_amount", "b_text", "b_quality", "b_transaction_id"), None
    for amounts, dates in ROUNDS:
        asks = rows.withColumn("least", F.lit(cfg.threshold))
        if best is not None:
            last = best.filter(F.col("rank") == cfg.top).select("b_id", F.col("score").alias("last"))
            asks = asks.join(shuffled(last), "b_id", "left").withColumn("least", F.greatest("least", F.coalesce("last", F.lit(0.0)))).drop("last")
        base = F.least(F.lit(1.0), F.lit(cfg.exact if amounts == "exact" else cfg.close) + date + cfg.text * F.col("text_similarity") + 0.1 * F.col("entity_bonus"))
        most = lambda reference: 0.7 * F.least(F.lit(cap), base + reference + F.col("total_bonus")) + 0.3 * (0.3 + 0.25 * F.col("pattern_consistency") + 0.25 * outlier + 0.2) + 1e-6  # noqa: B023, E731
        texts = cells.filter((F.col("amounts") == amounts) & F.col("dates").isin(dates)).filter(most(F.lit(cfg.reference)) >= cfg.threshold)
        asks = asks.join(F.broadcast(texts), "b_text").filter(most(F.lit(cfg.reference)) >= F.col("least"))
        asks = asks.withColumn("reference_bonus", reference_bonus(F.col("b_transaction_id"), F.col("_entry"), cfg.reference)).filter(most(F.col("reference_bonus")) >= F.col("least"))
        asks = asks.withColumn("off", F.explode(off)).drop("_entry", "b_transaction_id", "amounts", "dates")
        far = dates == ["extended"]
        spread = asks.withColumn("span", F.explode(F.sequence(span("b_date", -cfg.max_days), span("b_date", cfg.max_days)))) if far else asks.withColumn("day", F.date_add("b_date", F.col("off")))
        keyed = firsts.withColumn("span", span("e_date")) if far else firsts.withColumn("day", F.col("e_date"))
        if amounts == "exact":
            spread, keyed = spread.withColumn("cents", F.abs("b_amount")), keyed.withColumn("cents", F.abs("e_amount"))
        else:
            spread, keyed = spread.withColumn("cents", F.explode(F.sequence(bucket("b_amount", -larger - 1e-9), bucket("b_amount", larger + 1e-9)))), keyed.withColumn("cents", bucket("e_amount"))
        keys = ["cents", "span" if far else "day", "e_text"]
        pairs = shuffled(spread.drop("off").repartition(tasks, *keys)).join(keyed, keys).filter(valid(cfg))
        pairs = pairs if amounts == "exact" else pairs.filter(F.abs("b_amount") != F.abs("e_amount"))
        pairs = pairs.filter(F.abs(F.datediff("b_date", "e_date")) > 7) if far else pairs
        pairs = learned_final(row_scores(pairs.drop(*keys[:2]), cfg), cfg, cap).filter(F.col("score") >= F.col("least")).select("b_id", "e_id", "score")
        best = written(ranked(pairs if best is None else best.drop("rank").unionByName(pairs), cfg.top))
    return best.select("b_id", "e_id")


def find_matches_learned(bank: DataFrame, entries: DataFrame, patterns: DataFrame, hour: int, mode: str = "balanced", cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """M20 with history: of each bank row the best valid entries by the full score, with recommendation (M14), explanations (M13) and analysis.

    Validity comes before the cut, unlike in find_matches: a pair of any two rows of like text can reach the threshold by history
    alone, so the other order would have to score all rows against all, only to drop what is no match. Where different texts are few, the best are found class
    by class; else all valid candidates are scored. The analysis has no D6, as it is about records, which these are not yet.
    """
    patterns = written(patterns)
    b, e = learned_sides(bank, entries, patterns)
    few_texts = one_a_text(b, "b").count() * one_a_text(e, "e").count() <= matching.FEW_TEXTS
    by_class = few_texts and cfg.tolerance <= 0.04 and not finer_amounts(b, e)
    met = best_learned(b, e, patterns, hour, mode, cfg) if by_class else written(valid_candidates(b, e, cfg, mode))
    best = ranked(learned_scores(met, b, e, patterns, hour, mode, cfg), cfg.top)
    named = best.select("*", F.col("score").alias("match_score"), *[F.col(f"b_{c}").alias(f"bank_{c}") for c in ("amount", "date", "description", "category")], F.col("b_transaction_type").alias("bank_type"),
                        *[F.col(f"e_{c}").alias(f"entry_{c}") for c in ("amount", "date", "description", "category")], F.col("e_transaction_type").alias("entry_type"))
    judged = anomaly.analyze(named)
    return judged.select("b_id", "e_id", "rank", "score", "base", "contextual", "patterns_used", "explanation", recommendation(F.col("score")).alias("recommendation"), "n_anomalies", "total", "severity", "primary_type", score_explanations().alias("explanations"))


def predict_missing(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (amount, description) with likely suppliers (3 at most), payment methods, categories (5 at most, by name), the amount class that history
    has most often, and a confidence. One row of patterns says the class and how many kinds have any; a row without description gets nothing."""
    kinds = patterns.agg(F.count_distinct("type").alias("kinds"))
    usual = patterns.filter("type = 'amount'").agg(F.min(F.struct((-F.col("count")).alias("n"), "pattern"))["pattern"].alias("usual"))
    text = F.col("description")
    suppliers, methods, taxes = (entity_list(text, k) for k in ("company", "payment_method", "tax"))
    told = F.coalesce(text, F.lit("")) != ""
    found = rows.withColumns({"_suppliers": suppliers, "_methods": methods, "_taxes": taxes}).crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(usual))
    size = F.abs("amount")
    hints = F.array_compact(F.array(
        *[F.when(F.size("_taxes") > 0, x) for x in ("taxes", "government_fees")], F.when(F.array_contains("_methods", "boleto"), "bill_payment"), F.when(F.array_contains("_methods", "pix"), "instant_payment"),
        F.when(F.size("_suppliers") > 0, "supplier_payment"), F.when((size > 0) & (size < 100), "small_expense").when(size > 10_000, "large_payment"),
    ))
    none = F.array().cast("array<string>")
    found = found.withColumns({"suppliers": F.when(told, F.slice("_suppliers", 1, 3)).otherwise(none), "payment_methods": F.when(told, F.col("_methods")).otherwise(none), "categories": F.when(told, F.slice(F.array_sort(hints), 1, 5)).otherwise(none)})
    part = lambda c, x: F.when(F.size(c) > 0, x).otherwise(0.0)
    trust = part("suppliers", 0.3) + part("payment_methods", 0.2) + part("categories", 0.2) + F.when(F.col("kinds") > 10, 0.2).when(F.col("kinds") > 5, 0.1).otherwise(0.0)
    return found.withColumns({"amount_pattern": F.when(told, F.coalesce("usual", F.lit("unknown"))).otherwise("unknown"), "confidence": F.when(told, F.round(trust, 6)).otherwise(0.0)}).drop("_suppliers", "_methods", "_taxes", "kinds", "usual")


def numbered(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger rows with their `place` by id among those of the same keys, from 1: places in ranges of ids, and the ranges before, so
    that no task orders all rows of a frequent text."""
    rows = entries.withColumn("_range", F.floor(F.col("e_id") / 65_536))
    sums = rows.groupBy(*keys, "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("e_id"))
    return rows.withColumn("_inside", inside).join(offsets, [*keys, "_range"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def alike_texts(b: DataFrame, e: DataFrame, least: float) -> DataFrame:
    """(b_description, e_description, b_norm, e_norm, text_similarity) of the different texts of both sides that are more than `least` similar.

    Texts meet, not rows, and only under a shared word or entity or where one of one or two words stands inside the other: else similarity is 0.
    """
    text = lambda df, s: df.filter(F.col(f"{s}_norm") != "").groupBy(f"{s}_description").agg(*[F.first(f"{s}_{c}").alias(f"{s}_{c}") for c in ("norm", "words", "ents")])
    tb, te = text(b, "b"), text(e, "e")
    ids = ["b_description", "e_description"]

    def keyed(df: DataFrame, s: str) -> DataFrame:
        return df.select(f"{s}_description", F.explode(text_tokens(s)).alias("token"))

    common = keyed(tb, "b").join(keyed(te, "e"), "token").select(*ids)
    # A text of one or two words can stand inside another without sharing a word: then its first two letters are two neighbours there.
    inner = lambda df, s: df.filter(F.size(f"{s}_words") <= 2).select(f"{s}_description", f"{s}_norm", F.substring(f"{s}_norm", 1, 2).alias("gram"))
    grams = lambda df, s: df.select(f"{s}_description", f"{s}_norm", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(f"{s}_norm")), lambda i: F.substring(F.col(f"{s}_norm"), i, F.lit(2))))).alias("gram"))
    held = inner(tb, "b").join(grams(te, "e"), "gram").filter(F.col("e_norm").contains(F.col("b_norm"))).select(*ids)
    holds = inner(te, "e").join(grams(tb, "b"), "gram").filter(F.col("b_norm").contains(F.col("e_norm"))).select(*ids)
    met = common.union(held).union(holds).distinct().join(tb, "b_description").join(te, "e_description")
    ents = [{k: F.col(f"{s}_ents.{k}") for k in ENTITIES} for s in "be"]
    alike = text_similarity(F.col("b_norm"), F.col("e_norm"), F.col("b_words"), F.col("e_words"), entity_similarity(*ents))
    return met.withColumn("text_similarity", alike).filter(F.col("text_similarity") > least).select(*ids, "b_norm", "e_norm", "text_similarity")


def class_scores(texts: DataFrame, patterns: DataFrame, hour: int, mode: str) -> DataFrame:
    """M22's score, patterns_used and explanation of pairs of texts by amount and date class (`amounts`, `dates`), where they pass the mode's threshold."""
    amount = lambda x: F.lit(x).cast("decimal(28,6)")
    pairs = texts.withColumns({"b_amount": amount(100), "b_date": F.lit("2024-01-01").cast("date"), "e_amount": F.explode(F.array(amount(100), amount(101), amount(200)))})
    pairs = pairs.withColumn("e_date", F.explode(F.array(*[F.date_add("b_date", n) for n in (0, 2, 5, 30)])))
    good = contextual(pairs, patterns, F.col("text_similarity"), hour, mode).filter(F.col("contextual") > MODES[mode]["threshold"])
    classes = {"amounts": amount_class(F.col("b_amount"), F.col("e_amount")), "dates": date_class(F.col("b_date"), F.col("e_date"))}
    return good.withColumns(classes).select("b_description", "e_description", *classes, F.round("contextual", 6).alias("score"), "patterns_used", "explanation")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best entries of each group of bank rows, ties by entry id, with their rank."""
    w = Window.partitionBy(*GROUP).orderBy(F.col("score").desc(), "e_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def beating(best: DataFrame, k: int) -> tuple[DataFrame, Column]:
    """The last of the k best of each group that has so many, and whether an entry of `score` whose id is over `seen` can still come before it."""
    last = shuffled(best.filter(F.col("rank") == k).select(*GROUP, F.col("score").alias("last_score"), F.col("e_id").alias("last_id")))
    return last, F.col("last_score").isNull() | (F.col("score") > F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col("seen") < F.col("last_id")))


def class_keys(kind: str, amount: Column, around: bool) -> Column:
    """The keys, as texts, under which entries of an amount class meet: equal amounts, amounts in buckets wider than 5 % (`around`: and the next ones), or any."""
    if kind == "variable":
        return F.array(F.lit("any"))
    if kind == "exact":
        return F.array(amount.cast("string"))
    k = F.floor(F.log(amount.cast("double")) / F.log(F.lit(1.06)))
    return F.transform(F.sequence(k - 1, k + 1) if around else F.array(k), lambda x: x.cast("string"))


def dealt(asks: DataFrame, looked: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """asks joined with the entries that are looked at: these go to all tasks if they are few, else to SALTS parts of a key, so that no task has all groups of a frequent one."""
    if few(looked):
        return asks.repartition(tasks).join(F.broadcast(looked), on)
    parts = looked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asks.withColumn("_part", F.pmod(F.hash(*GROUP), F.lit(SALTS))).repartition(tasks, *on, "_part").join(shuffled(parts), [*on, "_part"]).drop("_part")


def contextual_suggestions(bank: DataFrame, entries: DataFrame, patterns: DataFrame, hour: int, mode: str = "balanced", places: int = 40) -> DataFrame:
    """Per bank row the best entries by text similarity and learned bonuses, whatever their amounts and dates, where the sum passes the mode's threshold.

    Bonuses alone never pass it, so only entries of an alike text count, and amounts and dates only say which class of bonus there is. So a score
    belongs to two texts and two classes (class_scores), bank rows of equal text, amount and date are one group, and of equal entries only the first by id count.
    Entries are looked up by id, never all at once: first each group sees the first `places` of its texts. A class goes on only where an entry after
    those could come before the group's last best one, and meets its entries under keys of its own: equal amounts or a bucket of close ones, and a
    day or all days. Of each key as many as before are looked at, then eight times as many, while there are more and they can still count.
    So nothing is cut, and what is looked at hangs on how soon the best classes are filled, not on how many rows share a text.
    """
    w = MODES[mode]
    k, places = w["most"], max(places, w["most"])
    most = 0.3 * w["description"] + 0.2 * w["supplier"] + 0.2 * w["amount"] + 0.2 * w["date"] + 0.1 * w["time"]
    if most >= w["threshold"]:
        raise ValueError("bonuses alone pass the threshold")
    tasks = int(bank.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cents = lambda s: F.abs(F.col(f"{s}_amount").cast("decimal(28,6)")).alias(f"{s}_cents")
    b, e = written(prepared(bank, "b", [])), written(prepared(entries, "e", []))
    scores = hinted(written(class_scores(alike_texts(b, e, w["threshold"] - most - 1e-9), written(patterns), hour, mode)))
    members = b.join(scores, "b_description", "left_semi").select("b_id", "b_description", cents("b"), F.to_date("b_date").alias("b_date"))
    # Few bytes make many pairs: by their size Spark would join these partitions to one or two.
    groups = written(members.select(*GROUP).distinct()).repartition(tasks, *GROUP)
    rows = e.join(scores, "e_description", "left_semi").select("e_id", "e_description", cents("e"), F.to_date("e_date").alias("e_date"))
    equal = Window.partitionBy("e_description", "e_cents", "e_date").orderBy("e_id")
    rows = written(rows.withColumn("_nth", F.row_number().over(equal)).filter(F.col("_nth") <= k).drop("_nth"))
    firsts = rows.withColumn("place", F.row_number().over(Window.partitionBy("e_description").orderBy("e_id"))).filter(F.col("place") <= places)
    firsts = hinted(written(firsts))
    found = [*GROUP, "e_description", "amounts", "dates", "score", "e_id"]
    classes = {"amounts": amount_class(F.col("b_cents"), F.col("e_cents")), "dates": date_class(F.col("b_date"), F.col("e_date"))}
    pairs = groups.join(hinted(written(scores.select("b_description", "e_description").distinct())), "b_description").join(firsts, "e_description")
    best = written(best_of(pairs.withColumns(classes).join(scores, ["b_description", "e_description", "amounts", "dates"]).select(*found), k))

    last, can = beating(best, k)
    # Of texts with more entries than were seen: where all are within a week, or of close amounts, there are none of other days or amounts to look for.
    ends = rows.groupBy("e_description").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("e_cents", "e_date") for n, f in (("low", F.min), ("high", F.max))])
    seen = firsts.filter(F.col("place") == places).select("e_description", F.col("e_id").alias("seen")).join(ends.filter(F.col("n") > places), "e_description")
    left = groups.join(last, GROUP, "left").join(hinted(written(scores.join(seen, "e_description"))), "b_description").filter(can)
    far = lambda of, b_col, e_col, name: (of(F.col(b_col), F.col(f"low_{e_col}")) == name) | (of(F.col(b_col), F.col(f"high_{e_col}")) == name)
    left = left.filter(((F.col("amounts") != "variable") | far(amount_class, "b_cents", "e_cents", "variable")) & ((F.col("dates") != "extended") | far(date_class, "b_date", "e_date", "extended")))
    left = written(left.select(*GROUP, "e_description", "amounts", "dates", "score", "seen"))
    kinds = [] if left.isEmpty() else ["exact", "close", "variable"]
    on = ["e_description", "amount_key", "day_key"]
    days = F.when(F.col("dates") == "same_day", F.array(F.lit(0))).when(F.col("dates") == "few_days", F.array(*[F.lit(n) for n in (-3, -2, -1, 1, 2, 3)]))
    days = days.when(F.col("dates") == "week", F.array(*[F.lit(n) for n in (-7, -6, -5, -4, 4, 5, 6, 7)])).otherwise(F.array(F.lit(None).cast("int")))
    for kind in kinds:
        last, can = beating(best, k)
        asks = left.filter(F.col("amounts") == kind).join(last, GROUP, "left").filter(can).drop("last_score", "last_id")
        asks = asks.withColumn("amount_key", F.explode(class_keys(kind, F.col("b_cents"), True))).withColumn("day_key", F.explode(days))
        asks = written(asks.withColumn("day_key", F.coalesce(F.date_add("b_date", F.col("day_key")).cast("string"), F.lit("any"))))
        keyed = rows.withColumn("amount_key", F.explode(class_keys(kind, F.col("e_cents"), False))).withColumn("day_key", F.explode(F.array(F.col("e_date").cast("string"), F.lit("any"))))
        index = written(numbered(keyed.join(shuffled(asks.select(*on).distinct()), on, "left_semi"), on)) if not asks.isEmpty() else None
        after, upto = 0, places
        while not asks.isEmpty():
            met = dealt(asks, index.filter((F.col("place") > after) & (F.col("place") <= upto)), on, tasks)
            hits = met.filter((F.col("e_id") > F.col("seen")) & (F.col("amounts") == classes["amounts"]) & (F.col("dates") == classes["dates"])).select(*found)
            best = written(best_of(best.select(*found).union(hits), k))
            last, can = beating(best, k)
            more = asks.join(shuffled(index.filter(F.col("place") == upto).select(*on, F.col("e_id").alias("_at"))), on).withColumn("seen", F.greatest("seen", "_at")).drop("_at")
            asks, after, upto = written(more.join(last, GROUP, "left").filter(can).drop("last_score", "last_id")), upto, 8 * upto
    chosen = ranked(members.join(shuffled(best.select(*found)), GROUP), k)
    told = scores.select("b_description", "e_description", "amounts", "dates", "patterns_used", "explanation")
    return chosen.join(told, ["b_description", "e_description", "amounts", "dates"]).select("b_id", "e_id", "rank", "score", "patterns_used", "explanation")
