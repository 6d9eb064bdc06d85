"""Patterns learned from confirmed records, and scores in their light."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import entity_list, normalize_standard, supplier_name

#: By mode, the weights of entities, the user, description, supplier, amount, date and time, the score's cap, the threshold and how many are suggested.
MODES = {
    "conservative": {"entity": 0.25, "user": 0.10, "description": 0.35, "supplier": 0.20, "amount": 0.15, "date": 0.15, "time": 0.05, "cap": 0.85, "threshold": 0.7, "most": 5},
    "balanced": {"entity": 0.25, "user": 0.15, "description": 0.30, "supplier": 0.20, "amount": 0.10, "date": 0.10, "time": 0.05, "cap": 0.95, "threshold": 0.6, "most": 10},
    "aggressive": {"entity": 0.20, "user": 0.05, "description": 0.25, "supplier": 0.15, "amount": 0.10, "date": 0.10, "time": 0.05, "cap": 1.0, "threshold": 0.5, "most": 15},
    "learning": {"entity": 0.25, "user": 0.20, "description": 0.30, "supplier": 0.20, "amount": 0.10, "date": 0.10, "time": 0.05, "cap": 1.0, "threshold": 0.4, "most": 20},
}


#: Names of the factors in explanations, in order.
FACTORS = {"description": "Description Pattern Bonus", "entity": "Entity Pattern Bonus", "supplier": "Supplier Consistency Bonus", "amount": "Amount Pattern Likelihood", "date": "Date Pattern Likelihood", "time": "Time Pattern Bonus", "user": "User Behavior Bonus"}


def amount_class(a: Column, b: Column) -> Column:
    # Decimals are subtracted before they become doubles: else 1.40 and 1.33, which are 5 % apart, would be less.
    x, y = F.abs(a.cast("decimal(28,6)")), F.abs(b.cast("decimal(28,6)"))
    return F.when(x == y, "exact").when(F.abs(x - y).cast("double") / F.greatest(x, y).cast("double") < 0.05, "close").otherwise("variable")


def date_class(a: Column, b: Column) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days == 0, "same_day").when(days <= 3, "few_days").when(days <= 7, "week").when(days.isNotNull(), "extended")


def entity_pairs(b: Column, e: Column) -> Column:
    """C4: the patterns `type:bank entity||ledger entity` of two texts, for companies and payment methods."""
    both = lambda k: F.flatten(F.transform(entity_list(b, k), lambda x: F.transform(entity_list(e, k), lambda y: F.concat(F.lit(f"{k}:"), x, F.lit("||"), y))))
    return F.array_distinct(F.concat(both("company"), both("payment_method")))


def mine_patterns(records: DataFrame, tx: DataFrame, entries: DataFrame, entities: bool = False) -> DataFrame:
    """(type, pattern, count, frequency, significance) of what more than one, and over 1 %, of the confirmed records have:
    description pairs, amount and date classes, hours and suppliers, and with `entities` pairs of entities (C4). Counts are combined
    before they are shuffled."""
    b = tx.select(F.col("id").alias("bank_transaction_id"), F.col("amount").alias("ba"), F.col("date").alias("bd"), F.col("description").alias("bt"))
    e = entries.select(F.col("id").alias("company_entry_id"), F.col("amount").alias("ea"), F.col("date").alias("ed"), F.col("description").alias("et"))
    confirmed = records.filter("status = 'confirmed'")
    rows = confirmed.join(b, "bank_transaction_id").join(e, "company_entry_id")
    nb, ne = normalize_standard(F.col("bt")), normalize_standard(F.col("et"))
    kinds = {
        "description": F.when((nb != "") & (ne != ""), F.concat(nb, F.lit("||"), ne)), "amount": amount_class(F.col("ba"), F.col("ea")), "date": date_class(F.col("bd"), F.col("ed")),
        "time": F.concat(F.lit("hour_"), F.hour("created_at").cast("string")), "supplier": supplier_name(F.col("bt")),
    }
    said = F.array(*[F.struct(F.lit(k).alias("type"), v.alias("pattern")) for k, v in kinds.items()])
    if entities:
        said = F.concat(said, F.transform(entity_pairs(F.col("bt"), F.col("et")), lambda x: F.struct(F.lit("entity").alias("type"), x.alias("pattern"))))
    long = rows.select(F.explode(said).alias("x")).select("x.type", "x.pattern").filter("pattern is not null")
    total = confirmed.agg(F.count("*").alias("total"))
    counts = long.groupBy("type", "pattern").agg(F.count("*").alias("count")).crossJoin(F.broadcast(total))
    share = F.col("count") / F.col("total")
    return counts.filter((F.col("count") > 1) & (share > 0.01)).select("type", "pattern", "count", share.alias("frequency"), F.when(share > 0.1, "high").otherwise("medium").alias("significance"))


def explain(factors: dict[str, Column], total: Column) -> Column:
    """C9's text: each factor over 0.01 by name, and the total where it is over 0.1."""
    shown = F.array_compact(F.array(*[F.when(v > 0.01, F.format_string(f"{k}: +%.3f", v)) for k, v in factors.items()]))
    tail = F.when(total > 0.1, F.format_string(" (Total bonus: +%.3f)", total)).otherwise("")
    return F.when(F.size(shown) > 0, F.concat(F.lit("Contextual adjustments: "), F.array_join(shown, "; "), tail)).otherwise("No significant contextual patterns found")


def user_behavior(pairs: DataFrame, users: DataFrame, user: str, hour: int) -> DataFrame:
    """Pairs with `user_bonus`: a tenth of their user's style bonus and a twentieth of the preference for the hour, 0.15 at most.

    users (user_id, style_bonus, hours as a map from `hour_9` to a preference) are one row each and are joined by broadcast where Spark
    finds them small; a pair of an unknown user has 0.
    """
    known = users.groupBy("user_id").agg(F.first(F.struct("style_bonus", "hours")).alias("_u")).withColumnRenamed("user_id", "_user")
    bonus = 0.1 * F.coalesce("_u.style_bonus", F.lit(0.0)) + 0.05 * F.coalesce(F.element_at(F.col("_u.hours"), f"hour_{hour}"), F.lit(0.0))
    return pairs.join(known, F.col(user) == F.col("_user"), "left").withColumn("user_bonus", F.when(F.col("_u").isNotNull(), F.least(bonus, F.lit(0.15))).otherwise(0.0)).drop("_user", "_u")


def contextual(pairs: DataFrame, patterns: DataFrame, base: Column, hour: int, mode: str = "balanced", entities: bool = False) -> DataFrame:
    """Pairs with the bonuses of learned patterns, `contextual` (base and weighted bonuses, capped by mode),
    `patterns_used`, `pattern_consistency` and `explanation`. Entity pairs (C4) count with `entities`, as they never do in practice;
    a column user_bonus (C7) counts if there is one. Each pattern has over 1 % of the records, so there are fewer than 100 of a type: they are broadcast."""
    w = MODES[mode]
    keys = {
        "description": F.concat(F.col("b_norm"), F.lit("||"), F.col("e_norm")), "supplier": supplier_name(F.col("b_description")),
        "amount": amount_class(F.col("b_amount"), F.col("e_amount")), "date": date_class(F.col("b_date"), F.col("e_date")), "time": F.lit(f"hour_{hour}"),
    }
    out = pairs
    for kind, key in keys.items():
        known = patterns.filter(F.col("type") == kind).select(F.col("pattern").alias(f"_{kind}"), F.col("frequency").alias(f"_{kind}_share"))
        out = out.join(F.broadcast(known), key == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    most = {"description": (10, 0.3), "supplier": (2, 0.2), "amount": (1, 0.2), "date": (1, 0.2), "time": (1, 0.1)}
    bonus = {f"{k}_bonus": F.least(F.coalesce(F.col(f"_{k}_share") * times, F.lit(0.0)), F.lit(cap)) for k, (times, cap) in most.items()}
    out = out.withColumns(bonus).drop(*[f"_{k}_share" for k in keys])
    used = list(keys)
    if entities:
        known = patterns.filter("type = 'entity'").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "frequency"))).alias("_known"))
        shares = F.transform(entity_pairs(F.col("b_description"), F.col("e_description")), lambda x: F.least(F.coalesce(F.element_at("_known", x) * 5, F.lit(0.0)), F.lit(0.15)))
        out = out.crossJoin(F.broadcast(known)).withColumn("entity_bonus_learned", F.least(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(0.25))).drop("_known")
    bonuses = {k: F.col(f"{k}_bonus") for k in used} | ({"entity": F.col("entity_bonus_learned")} if entities else {}) | ({"user": F.col("user_bonus")} if "user_bonus" in out.columns else {})
    total = sum((v * w[k] for k, v in bonuses.items()), F.lit(0.0))
    part = lambda k, x: F.when(F.col(f"{k}_bonus") > 0, x).otherwise(0.0)
    return out.withColumns({
        "total_bonus": total, "contextual": F.least(base + total, F.lit(w["cap"])), "patterns_used": sum(((v > 0).cast("int") for v in bonuses.values()), F.lit(0)),
        "pattern_consistency": part("description", 0.3) + part("supplier", 0.2) + part("amount", 0.2) + (F.when(F.col("entity_bonus_learned") > 0, 0.3).otherwise(0.0) if entities else F.lit(0.0)),
        "explanation": explain({FACTORS[k]: bonuses[k] for k in FACTORS if k in bonuses}, total),
    })


def matching_metrics(pairs: DataFrame) -> DataFrame:
    """How many pairs, and the shares with a bonus and with a pattern."""
    share = lambda c: F.round(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)), 4)
    return pairs.agg(F.count("*").alias("n"), share("total_bonus").alias("contextual_share"), share("patterns_used").alias("pattern_share"))


def refresh_due(records: DataFrame, refreshed: str, as_of: str) -> DataFrame:
    """C11: one row: whether patterns of `refreshed` are over a day old at as_of, or over 100 records have been confirmed since."""
    since = F.lit(refreshed).cast("timestamp")
    recent = records.agg(F.count(F.when((F.col("created_at") > since) & (F.col("status") == "confirmed"), 1)).alias("recent"))
    old = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(since) > 24 * 3600
    return recent.select("recent", (old | (F.col("recent") > 100)).alias("due"))
