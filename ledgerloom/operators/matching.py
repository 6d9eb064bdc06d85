"""Bank-to-ledger matching: lossless blocking, scores, ranking, validity."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.similar import bound, reference_bonus
from ledgerloom.functions.text import ENTITIES, entity_list, entity_similarity, normalize_standard, text_similarity, tfidf_similarity
from ledgerloom.operators.tables import few, hinted, shuffled, written

#: Up to so many pairs of a bank row that are taken are ranked with the others and dropped then.
TAKEN = 20
#: Up to so many pairs of different texts are scored all; where there are more, texts meet under the keys of a block first.
FEW_TEXTS = 200_000
#: M9's shares of the mean amount, and what is left of the score up to each of them and beyond.
SHARES, OUTLIERS = (0.1, 0.2, 0.5), (1.0, 0.9, 0.8, 0.6)
#: A bucket of amounts of one day (in logarithms), and the one that all amounts are in.
DAY_STEP, ANY = math.log(5 / 3) / 4, -1_000_000
#: Days of a span of equal amounts.
SPAN = 31


@dataclass(frozen=True)
class MatchConfig:
    """Weights and limits of the score; checked as saved configurations are."""

    threshold: float = 0.65
    exact: float = 0.35
    close: float = 0.15
    same_day: float = 0.25
    near_day: float = 0.10
    text: float = 0.30
    reference: float = 0.05
    tolerance: float = 0.02
    max_days: int = 30
    top: int = 3
    semantic: float = 0.7

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")

    def check_saved(self) -> None:
        """The weights of a saved configuration sum to 1 within 0.01; those of the default don't."""
        if abs(self.exact + self.same_day + self.text + self.near_day + self.close - 1) > 0.01:
            raise ValueError("weights must sum to 1")


def matchable(df: DataFrame) -> DataFrame:
    """rows with id, date, amount of at least a cent and a description."""
    return df.filter("id is not null and date is not null and amount is not null and abs(amount) >= 0.01 and trim(coalesce(description, '')) <> ''")


def prepared(df: DataFrame, side: str, extra: list[str]) -> DataFrame:
    """Text features, before any join, once per different text: statements repeat their wordings, so these are few beside the rows.
    Rows are dealt by id first: millions stand in a file or two, whose few tasks would else do all that follows."""
    rows = matchable(df).select("id", "date", "amount", "description", *extra).repartition("id")
    texts = matchable(df).select("description").distinct()
    ents = F.struct(*[entity_list(F.col("description"), k).alias(k) for k in ENTITIES])
    texts = texts.select("description", normalize_standard(F.col("description")).alias("norm"), ents.alias("ents"), F.monotonically_increasing_id().alias("text")).withColumn("words", F.array_distinct(F.split("norm", " ")))
    told = rows.join(hinted(written(texts)), "description").select("id", "date", "amount", "description", *extra, "norm", "ents", "words", "text")
    return told.select(*[F.col(c).alias(f"{side}_{c}") for c in told.columns])


def text_needed(cfg: MatchConfig, amount: float, date: float) -> float:
    """The least text similarity with which a pair of these amount and date scores can reach the threshold, all else at its best."""
    left = said_needed(cfg, amount, date) - 0.1
    return left / cfg.text if cfg.text else float("inf" if left > 0 else "-inf")


def said_needed(cfg: MatchConfig, amount: float, date: float) -> float:
    """The least that the texts' similarity and entities must add to the base score of a pair of these amount and date scores. Scores are rounded to 6 digits."""
    return least_base(cfg) - amount - date - cfg.reference - 1e-6


def least_base(cfg: MatchConfig) -> float:
    """The least base score with which a pair without history can reach the threshold."""
    return (cfg.threshold - 0.3 * (0.3 + 0.25 + 0.2)) / 0.7


def text_tokens(s: str) -> Column:
    """Words of a prepared side's text and its entities, each under its type."""
    ents = [F.transform(F.col(f"{s}_ents.{k}"), lambda x, k=k: F.concat(F.lit(f"{k}:"), x)) for k in ENTITIES]
    return F.array_distinct(F.concat(F.array_remove(F.col(f"{s}_words"), ""), *ents))


def sharing_words(b: DataFrame, e: DataFrame, on: list[str], need: float, tokens: bool = False) -> DataFrame:
    """Texts (keys, b_text, e_text) that meet under the keys `on` and can be `need` similar; a pair may be there more than once.
    With `tokens`, only those that say anything alike: pairs that share no token (a word or an entity), and of which neither text stands inside
    the other, have similarity 0 and no entity bonus.

    Without a common word, similarity is 0.3 at most (entities alone), unless one text stands inside the
    other; then all its words but the first and the last are common. So where more than 0.3 is needed,
    pairs of longer texts meet per key and word, each under its smallest common word only, which splits hot days and
    amounts; texts of one or two words meet all of their key.
    """
    found = [*on, "b_text", "e_text"]
    inner = F.col("e_norm").contains(F.col("b_norm")) | F.col("b_norm").contains(F.col("e_norm"))
    if need <= 0.3:
        met = b.join(e, on)
        return (met.filter(F.arrays_overlap("b_tokens", "e_tokens") | ((F.col("b_norm") != "") & (F.col("e_norm") != "") & inner)) if tokens else met).select(*found)
    short = lambda side: F.size(f"{side}_words") <= 2
    worded = lambda df, side: df.withColumn("word", F.explode(f"{side}_words"))
    common = worded(b, "b").join(worded(e, "e"), [*on, "word"]).filter(F.col("word") == F.array_min(F.array_intersect("b_words", "e_words")))
    inside = b.filter(short("b")).join(e, on).filter(inner)
    around = e.filter(short("e")).join(b.filter(~short("b")), on).filter(inner)
    return reduce(DataFrame.union, [x.select(*found) for x in (common, inside, around)])


def best_score(cfg: MatchConfig, amount: float, date: float, said: Column, outlier: float | Column = 1.0) -> Column:
    """The highest final score of pairs of these amount and date scores and this outlier part, all else at its best; `said` is what texts and the reference add."""
    return 0.7 * F.least(F.lit(0.95), F.lit(amount + date) + said) + 0.3 * (0.3 + 0.25 * outlier + 0.2) + 1e-6


def said_score(cfg: MatchConfig) -> Column:
    return cfg.text * F.col("text_similarity") + 0.1 * F.col("entity_bonus")


@dataclass(frozen=True)
class Block:
    """A way for rows to meet: bank rows are spread over `keys`, entries have one key each (or two); `best` is the highest score of an ask there, and `only` what pairs belong to the block."""

    name: str
    keys: list[str]
    spread: Callable[[DataFrame], DataFrame]
    keyed: Callable[[DataFrame], DataFrame]
    best: Column
    only: Column
    need: float
    text_need: float
    finish: Callable[[DataFrame, Column], DataFrame] = lambda asks, need: asks


def match_blocks(cfg: MatchConfig, finer: bool = True, fits: bool = False, shares: list[tuple[int, int]] | None = None) -> list[Block]:
    """J1's blocks, whose pairs exclude each other: equal cents up to 3 days apart (`exact`), equal cents of other days (`cents`), other amounts within tolerance up
    to 3 days apart (`near`), and other amounts of one day (`day`).

    What an ask (a bank row and a text of entries) can score at best in a block says whether it is asked there at all, and on `day` how far
    amounts may lie apart: these meet in buckets, and only where the texts alone are enough all amounts do. `finer`: amounts can be finer than
    cents, so that others than equal ones count as such. `fits`: only pairs that J2 lets pass. `shares` splits `day` into rounds, from one place of SHARES to another.
    """
    tolerance = math.ceil(100 * cfg.tolerance - 1e-9) / 100
    said = said_score(cfg) + F.col("reference_bonus")
    close, other = (max(cfg.exact, cfg.close), cfg.exact) if finer else (cfg.close, 0.0)
    b_cents, e_cents, days = F.abs("b_amount"), F.abs("e_amount"), F.abs(F.datediff("b_date", "e_date"))
    within = F.abs(b_cents - e_cents) <= b_cents * F.lit(cfg.tolerance).cast("decimal(4,2)")
    day_no = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    near_step = max(math.log((1 + tolerance) / max(1 - tolerance, 1e-6)), 1e-3)
    bucket = lambda c, step, by=0.0: F.floor(F.log(c.cast("double")) / step + by / step)
    reached = lambda c, step, down, up: F.explode(F.sequence(bucket(c, step, -down - 1e-9), bucket(c, step, up + 1e-9)))
    offsets = lambda df: df.withColumn("off", F.explode(F.array(*[F.lit(n) for n in range(-3, 4)]))).withColumn("day", F.date_add("b_date", F.col("off")))
    dated = lambda amount: F.when(F.col("off") == 0, best_score(cfg, amount, cfg.same_day, said)).otherwise(best_score(cfg, amount, cfg.near_day, said))
    spans = lambda df: df.withColumn("span", F.explode(F.sequence(F.floor((day_no("b_date") - cfg.max_days) / SPAN), F.floor((day_no("b_date") + cfg.max_days) / SPAN)))) if fits else df
    spanned = lambda df: df.withColumn("span", F.floor(day_no("e_date") / SPAN)) if fits else df
    down, up = -math.log(max(1 - tolerance, 1e-6)), math.log(1 + tolerance)

    def ringed(first: int, last: int) -> Callable[[DataFrame, Column], DataFrame]:
        """Asks of a day with their buckets: as wide as their score allows, at most up to the place `last` of SHARES."""
        def finish(asks: DataFrame, need: Column) -> DataFrame:
            c = F.col("b_amount")
            seq = lambda reach: F.sequence(bucket(F.abs(c), DAY_STEP, -reach - 1e-9), bucket(F.abs(c), DAY_STEP, reach + 1e-9))
            wide = [math.log((1 + x / 2) / (1 - x / 2)) for x in SHARES]
            if fits:  # a J2 pair's amounts are within tolerance of the larger
                wide = [min(x, down) for x in wide]
            none = F.array().cast("array<bigint>")
            rings = none
            for at in range(first, last + 1):
                all_ = F.array(F.lit(ANY).cast("bigint"))
                met = all_ if at == len(SHARES) and not fits else seq(wide[min(at, len(SHARES) - 1)])
                rings = F.when(best_score(cfg, other, cfg.same_day, said, OUTLIERS[at]) >= need, met).otherwise(rings)
            return asks.withColumn("bucket", F.explode(rings))
        return finish

    def day_block(first: int, last: int) -> Block:
        share = F.when(b_cents + e_cents > 0, F.abs(b_cents - e_cents).cast("double") / ((b_cents + e_cents) / 2).cast("double")).otherwise(0.0)
        beyond = share > SHARES[first - 1] if first else F.lit(True)
        upto = share <= SHARES[last] if last < len(SHARES) else F.lit(True)
        wide = lambda df: df.withColumns({"day": F.col("e_date"), "bucket": F.explode(F.array(bucket(e_cents, DAY_STEP), F.lit(ANY).cast("bigint"))) if last == len(SHARES) and not fits else bucket(e_cents, DAY_STEP)})
        return Block("day", ["day"], lambda df: df.withColumn("day", F.col("b_date")), wide, best_score(cfg, other, cfg.same_day, said, OUTLIERS[first]), (b_cents != e_cents) & ~within & beyond & upto,
                     said_needed(cfg, other, cfg.same_day), text_needed(cfg, other, cfg.same_day), ringed(first, last))

    return [
        Block("exact", ["cents", "day"], lambda df: offsets(df).withColumn("cents", F.abs("b_amount")), lambda df: df.withColumns({"cents": e_cents, "day": F.col("e_date")}), dated(cfg.exact), F.lit(True), said_needed(cfg, cfg.exact, max(cfg.same_day, cfg.near_day)), 0.0),
        Block("cents", ["cents", "span"] if fits else ["cents"], lambda df: spans(df).withColumn("cents", F.abs("b_amount")), lambda df: spanned(df).withColumn("cents", e_cents), best_score(cfg, cfg.exact, 0.0, said),
              (days > 3) & ((days <= cfg.max_days) if fits else F.lit(True)), said_needed(cfg, cfg.exact, 0.0), text_needed(cfg, cfg.exact, 0.0)),
        Block("near", ["bucket", "day"], lambda df: offsets(df).withColumn("bucket", reached(b_cents, near_step, down, up)), lambda df: df.withColumns({"bucket": bucket(e_cents, near_step), "day": F.col("e_date")}), dated(close), (b_cents != e_cents) & within, said_needed(cfg, close, max(cfg.same_day, cfg.near_day)), 0.0),
        *[day_block(first, last) for first, last in shares or [(0, len(SHARES))]],
    ]


def finer_amounts(*sides: DataFrame) -> bool:
    """Whether amounts may be finer than cents."""
    kinds = [t for df in sides for c, t in df.dtypes if c in ("b_amount", "e_amount")]
    return not all(t.startswith("decimal") and int(t.rstrip(")").split(",")[1]) <= 2 for t in kinds)


def block_asks(b: DataFrame, e: DataFrame, blocks: list[Block], cfg: MatchConfig) -> dict[str, DataFrame]:
    """By block the bank rows with each text of entries that says enough for it (e_text) and the parts of the score that hang on both, written.

    Where different texts are few, as statements repeat their wordings, all are scored with all and an ask stands for all blocks. Else texts meet under
    the keys of a block (with which these asks come), and a pair of texts is scored once.
    """
    bare = b.drop("b_norm", "b_words", "b_ents")
    tb, te = (written(one_a_text(df, s).withColumn(f"{s}_tokens", text_tokens(s))) for df, s in ((b, "b"), (e, "e")))
    said = {k: v for k, v in base_score(cfg).items() if k in ("text_similarity", "entity_bonus")}
    texts_of = lambda df, s: df.select(*[f"{s}_{c}" for c in ("text", "norm", "words", "ents", "description")])
    told = ["b_text", "e_text", *said, "_entry"]

    def asking(df: DataFrame) -> DataFrame:
        reference = reference_bonus(F.col("b_transaction_id"), F.col("_entry"), cfg.reference) if "b_transaction_id" in b.columns else F.lit(0.0)
        told = df.withColumn("reference_bonus", reference).drop("_entry")
        return written(told.filter(best_score(cfg, max(cfg.exact, cfg.close), max(cfg.same_day, cfg.near_day), said_score(cfg) + F.col("reference_bonus")) >= cfg.threshold))

    least = min(block.need for block in blocks)
    if tb.count() * te.count() <= FEW_TEXTS:
        pairs = texts_of(tb, "b").crossJoin(F.broadcast(texts_of(te, "e"))).withColumns(said).withColumn("_entry", F.col("e_description")).select(*told)
        pairs = written(pairs.filter(said_score(cfg) >= least))
        asks = asking(bare.join(F.broadcast(pairs), "b_text"))
        return {block.name: asks for block in blocks}
    met: dict[str, DataFrame] = {}
    tb, te = hinted(tb), hinted(te)
    for block in blocks:
        if block.name not in met:
            keyed = block.keyed(e)
            left = block.spread(b.select("b_text", "b_amount", "b_date")).select(*block.keys, "b_text").distinct().join(tb.drop("b_ents"), "b_text")
            right = keyed.select(*block.keys, "e_text").distinct().join(te.drop("e_ents"), "e_text")
            met[block.name] = written(sharing_words(left, right, block.keys, block.text_need, block.need > 0).distinct())
    ids = ["b_text", "e_text"]
    every = reduce(DataFrame.union, [x.select(*ids) for x in met.values()]).distinct()
    scores = every.join(texts_of(tb, "b"), "b_text").join(texts_of(te, "e"), "e_text").withColumns(said).withColumn("_entry", F.col("e_description")).select(*told)
    scores = hinted(written(scores))
    found = {}
    for block in blocks:
        if block.name not in found:
            enough = shuffled(met[block.name].join(scores, ids).filter(said_score(cfg) >= block.need))
            found[block.name] = asking(block.spread(bare).join(enough, [*block.keys, "b_text"]))
    return found


def meeting(block: Block, asks: DataFrame, e: DataFrame, need: Column) -> DataFrame:
    """The pairs of a block whose asks can score `need`, with the columns of both sides."""
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = asks if set(block.keys) <= set(asks.columns) else block.spread(asks)
    keyed = block.keyed(e.drop("e_norm", "e_words", "e_ents"))
    rows = block.finish(spread.filter(block.best >= need), need)
    keys = sorted({*block.keys, *[c for c in ("bucket",) if c in rows.columns]}) + ["e_text"]
    # Few bytes make many pairs: by their size Spark would join these partitions to one or two.
    rows = shuffled(rows.repartition(tasks, *keys))
    return rows.join(keyed, keys).filter(block.only).drop("cents", "day", "bucket", "span", "off")


def candidate_rows(bank: DataFrame, entries: DataFrame, cfg: MatchConfig, fits: bool = False) -> DataFrame:
    """All candidate_blocks in one table."""
    return reduce(DataFrame.unionByName, candidate_blocks(bank, entries, cfg, fits))


def candidate_blocks(bank: DataFrame, entries: DataFrame, cfg: MatchConfig, fits: bool = False) -> list[DataFrame]:
    """J1's blocks as equi-joins: equal cents; same day; within tolerance and 3 days. Each pair of rows once, with the columns of both prepared
    sides but norm, words and ents, and with text_similarity, entity_bonus and reference_bonus.

    Rows only meet where their texts say enough, and under keys that hold the amounts and days of such scores. So the pairs of rows that are
    made are hardly more than those that reach the threshold, and none is shuffled. With `fits`, of pairs that J2 doesn't let pass none need be there.
    """
    blocks = match_blocks(cfg, finer_amounts(bank, entries), fits)
    asks = block_asks(bank, entries, blocks, cfg)
    return [meeting(block, asks[block.name], entries, F.lit(cfg.threshold)) for block in blocks]


def candidate_pairs(bank: DataFrame, entries: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Distinct (b_id, e_id) of candidate_rows: no other pair can reach the threshold."""
    return candidate_rows(bank, entries, cfg).select("b_id", "e_id").distinct()


def apart(cfg: MatchConfig, diff: Column, days: Column) -> dict[str, Column]:
    """M1's amount and date scores of amounts and days so far apart."""
    amount = F.when(diff < 0.01, cfg.exact).when(diff <= F.lit(cfg.tolerance).cast("decimal(4,2)") * F.abs("b_amount"), cfg.close).otherwise(0.0)
    return {"amount_score": amount, "date_score": F.when(days == 0, cfg.same_day).when(days <= 3, cfg.near_day).otherwise(0.0)}


def base_score(cfg: MatchConfig) -> dict[str, Column]:
    """M1's parts over a pair's columns: amount, date, description, entities, reference, and their capped sum."""
    ents = [{k: F.col(f"{s}_ents.{k}") for k in ENTITIES} for s in "be"]
    text = text_similarity(F.col("b_norm"), F.col("e_norm"), F.col("b_words"), F.col("e_words"), entity_similarity(*ents))
    # M4 counts where it is `semantic` or more; without a common word it is 0.
    close = F.when((F.col("b_norm") != F.col("e_norm")) & F.arrays_overlap("b_words", "e_words"), tfidf_similarity(F.col("b_norm"), F.col("e_norm"))).otherwise(0.0)
    text = bound(lambda plain, meant: F.when(meant >= cfg.semantic, F.greatest(plain, meant)).otherwise(plain), text, close)
    inter = sum((F.size(F.array_intersect(ents[0][k], ents[1][k])) for k in ENTITIES), F.lit(0))
    union = sum((F.size(F.array_union(ents[0][k], ents[1][k])) for k in ENTITIES), F.lit(0))
    entity = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    reference = reference_bonus(F.col("b_transaction_id"), F.col("e_description"), cfg.reference)
    return {**apart(cfg, F.abs(F.abs("b_amount") - F.abs("e_amount")), F.abs(F.datediff("b_date", "e_date"))), "text_similarity": text, "entity_bonus": entity, "reference_bonus": reference}


def one_a_text(df: DataFrame, s: str) -> DataFrame:
    """The different texts of a prepared side."""
    return df.select(f"{s}_description", *[f"{s}_{c}" for c in ("text", "norm", "words", "ents")]).distinct()


def text_scores(met: DataFrame, b: DataFrame, e: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs (b_description, e_description) of texts of the prepared sides b and e, with M1's parts of texts."""
    said = {k: v for k, v in base_score(cfg).items() if k in ("text_similarity", "entity_bonus")}
    return met.join(one_a_text(b, "b"), "b_description").join(one_a_text(e, "e"), "e_description").withColumns(said).select("b_description", "e_description", *said)


def with_base_scores(pairs: DataFrame, b: DataFrame, e: DataFrame, cfg: MatchConfig) -> DataFrame:
    """pairs of the prepared sides b and e, with all their columns, and M1's parts: those of texts once per different pair of texts, where these are few (counted), so
    that a broadcast brings them to the pairs; else pair by pair."""
    scores, ids = base_score(cfg), ["b_description", "e_description"]
    met = written(pairs.select(*ids).distinct())
    if not few(met):
        return pairs.withColumns(scores)
    texts = written(text_scores(met, b, e, cfg))
    return pairs.join(F.broadcast(texts), ids).withColumns({k: v for k, v in scores.items() if k not in texts.columns})


def completeness(s: str) -> Column:
    """M7 of a side's row."""
    full = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    last = part(full("b_category"), 0.2) if s == "b" else [part(full("e_category"), 0.1), part(full("e_cost_center"), 0.1)]
    told = part(F.length(f"{s}_description") > 5, 0.3) + part(F.abs(f"{s}_amount") > 0.01, 0.3) + part(F.col(f"{s}_date").isNotNull(), 0.2)
    return told + last if s == "b" else told + last[0] + last[1]


def quality_scores() -> dict[str, Column]:
    """Completeness, outlier and temporal consistency of a pair."""
    diff = F.abs(F.abs("b_amount") - F.abs("e_amount"))
    return {"data_quality": (completeness("b") + completeness("e")) / 2, **consistency(mean_share(diff), F.datediff("e_date", "b_date"))}


def mean_share(diff: Column) -> Column:
    """M9's share of amounts so far apart in their mean."""
    mean = (F.abs("b_amount") + F.abs("e_amount")).cast("double") / 2
    return F.when(mean > 0, diff.cast("double") / mean).otherwise(0.0)


def consistency(share: Column, signed: Column) -> dict[str, Column]:
    """M9 and M10 of amounts whose difference is this share of their mean, and dates so many days apart."""
    days = F.abs(signed)
    outlier = 1.0 - F.when(share > 0.5, 0.4).when(share > 0.2, 0.2).when(share > 0.1, 0.1).otherwise(0.0) - F.when(days > 30, 0.3).when(days > 14, 0.2).when(days > 7, 0.1).otherwise(0.0)
    temporal = 1.0 - F.when(signed < -7, 0.3).when(signed < 0, 0.1).otherwise(0.0) - F.when(signed > 30, 0.2).when(signed > 14, 0.1).otherwise(0.0)
    return {"outlier": F.greatest(F.lit(0.0), outlier), "temporal": temporal}


def row_scores(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The parts of the score that hang on rows: M1's amount and date scores, M7, M9 and M10, of candidate_rows of prepared_sides. What they share is computed once a pair."""
    told = pairs.withColumns({"_diff": F.abs(F.abs("b_amount") - F.abs("e_amount")), "_signed": F.datediff("e_date", "b_date")})
    told = told.withColumns({"_share": mean_share(F.col("_diff")), **apart(cfg, F.col("_diff"), F.abs("_signed"))})
    return told.withColumns({"data_quality": (F.col("b_quality") + F.col("e_quality")) / 2, **consistency(F.col("_share"), F.col("_signed"))}).drop("_diff", "_signed", "_share")


def final_scores(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """M11 without learned history: pairs with M1's parts and M7 to M10, their `base`, and the final `score` where it reaches the threshold."""
    base = F.least(F.lit(1.0), F.col("amount_score") + F.col("date_score") + cfg.text * F.col("text_similarity") + 0.1 * F.col("entity_bonus") + F.col("reference_bonus"))
    context = F.least(F.lit(0.95), base)
    final = F.least(F.lit(1.0), 0.7 * context + 0.3 * (0.3 * F.col("data_quality") + 0.25 * F.lit(0.0) + 0.25 * F.col("outlier") + 0.2 * F.col("temporal")))
    # A list of one keeps the filter on the score above its making. Spark would move it, with all that a score is made of, into the condition
    # of the join below, where each mention of a part is computed anew: 45 microseconds a pair.
    pairs = pairs.withColumn("_final", final).withColumn("_final", F.explode(F.array("_final")))
    pairs = pairs.filter(F.col("_final") >= cfg.threshold - 1e-6)
    return pairs.withColumn("base", F.round(base, 6)).withColumn("score", F.explode(F.array(F.round("_final", 6)))).filter(F.col("score") >= cfg.threshold).drop("_final")


def prepared_sides(bank: DataFrame, entries: DataFrame) -> list[DataFrame]:
    """Both sides of matching, with what their rows' completeness adds (b_quality, e_quality)."""
    sides = prepared(bank, "b", ["category", "transaction_id"]), prepared(entries, "e", ["category", "cost_center"])
    return [shuffled(written(df.withColumn(f"{s}_quality", completeness(s)))) for df, s in zip(sides, "be", strict=True)]


def pair_scores(bank: DataFrame, entries: DataFrame, cfg: MatchConfig = MatchConfig(), fits: bool = False) -> DataFrame:
    """J1 + M1 + M11 without learned history: candidate pairs whose final score reaches the threshold, with its parts (M12) and the rows' own columns.
    With `fits`, only those that J2 lets pass: others are not made, but where they share a key."""
    rows = candidate_rows(*prepared_sides(bank, entries), cfg, fits)
    return final_scores(row_scores(rows.filter(valid(cfg)) if fits else rows, cfg), cfg)


def scored_pairs(bank: DataFrame, entries: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """pair_scores with the normalised texts, words and entities of both rows, which are brought by their ids."""
    b, e = prepared_sides(bank, entries)
    pairs = written(candidate_pairs(b, e, cfg)).join(b, "b_id").join(e, "e_id")
    return final_scores(with_base_scores(pairs, b, e, cfg).withColumns(quality_scores()), cfg)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best entries per bank row, ties by entry id; Spark limits groups before the sort."""
    w = Window.partitionBy("b_id").orderBy(F.col("score").desc(), "e_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_pairs(bank: DataFrame, entries: DataFrame, k: int, cfg: MatchConfig = MatchConfig(), keep: tuple[str, ...] = (), only: Column | None = None, taken: DataFrame | None = None) -> DataFrame:
    """ranked(pair_scores, k) with the columns of `keep`, of the pairs that `only` (over amounts, dates and texts) holds for and that are not among `taken` (b_id, e_id).

    Each block is a job of its own that writes the best entries of a bank row so far, those that can score most first. A bank row goes on to a block only where that
    can still change its best: a pair there can score as much as the last of k. On a day, amounts meet from near to far. Of equal entries
    only the first by id can be among the best. Taken pairs go at the end, which leaves as many more as a bank row has of them at most
    (counted); where that is over TAKEN, they go before each rank.
    """
    most = 0 if taken is None else taken.groupBy("b_id").count().agg(F.max("count")).first()[0] or 0
    free = lambda df: df if taken is None else df.join(taken, ["b_id", "e_id"], "left_anti")
    places = k + most if most <= TAKEN else k
    b, e = prepared_sides(bank, entries)
    equal = Window.partitionBy("e_text", "e_amount", "e_date", "e_quality").orderBy("e_id")
    firsts = shuffled(written(e.withColumn("_nth", F.row_number().over(equal)).filter(F.col("_nth") <= k + most).drop("_nth")))
    blocks = match_blocks(cfg, finer_amounts(b, e), shares=[(0, 1), (2, len(SHARES))])
    asked, found, best = block_asks(b, e, blocks, cfg), ["b_id", "e_id", "score", *keep], None
    for block in blocks:
        asks, need = asked[block.name].withColumn("least", F.lit(cfg.threshold)), F.col("least")
        if best is not None:
            last = best.filter(F.col("rank") == places).select("b_id", F.col("score").alias("last"))
            asks = asks.join(shuffled(last), "b_id", "left").withColumn("least", F.greatest("least", F.coalesce("last", F.lit(0.0)))).drop("last")
        pairs = final_scores(row_scores(meeting(block, asks, firsts, need), cfg), cfg).filter(F.col("score") >= need)
        pairs = (pairs if only is None else pairs.filter(only)).select(*found)
        pairs = free(pairs) if most > TAKEN else pairs
        best = written(ranked(pairs if best is None else best.select(*found).unionByName(pairs), places))
    return ranked(free(best.select(*found)), k)


def valid(cfg: MatchConfig) -> Column:
    """At most max_days apart and amounts within tolerance of the larger."""
    larger = F.greatest(F.abs("b_amount"), F.abs("e_amount"))
    return (F.abs(F.datediff("b_date", "e_date")) <= cfg.max_days) & (F.abs(F.abs("b_amount") - F.abs("e_amount")) <= F.lit(cfg.tolerance).cast("decimal(4,2)") * larger)


def recommendation(score: Column) -> Column:
    """M14."""
    return F.when(score >= 0.9, "auto").when(score >= 0.8, "strong").when(score >= 0.7, "good").when(score >= 0.6, "review").otherwise("weak")


def find_matches(bank: DataFrame, entries: DataFrame, cfg: MatchConfig = MatchConfig(), validate_first: bool = False) -> DataFrame:
    """The top entries of each bank row, then the validity rules; the reference cuts before it validates, validate_first turns that round."""
    best = best_pairs(bank, entries, cfg.top, cfg, ("b_amount", "e_amount", "b_date", "e_date"), valid(cfg) if validate_first else None).filter(valid(cfg))
    return best.select("b_id", "e_id", "rank", "score", recommendation(F.col("score")).alias("recommendation"))
