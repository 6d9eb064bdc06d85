"""Personal data: fixed formats, plus terms that reveal them by corpus co-occurrence (information-theoretic sanitisation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, Scratch, durable, join_counted, let

KINDS = ("email", "ip", "card", "phone", "term")
#: The formats, with possessive loops where nothing follows them: same matches, no recursion on long runs.
#: A match can only start where a run does or where the last match ended: said so, long runs take linear time.
#: A card's run is maximal either way, so runs of fewer than 14 digits need not match at all.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{M}]{3,}+"
PART = 1000
#: Sides of up to this many rows (counted) are broadcast.
FEW = BROADCAST_ROWS
SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def matches(text: Column, pattern: str | Column, kind: str) -> Column:
    """All leftmost non-overlapping matches with code point offsets: the lengths of pieces between and of matches, summed up."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(acc: Column, x: Column) -> Column:
        piece, match = x["piece"], x["match"]
        start = acc["at"] + F.length(piece)
        end = start + F.coalesce(F.length(match), F.lit(0))
        found = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("value"))
        return F.struct(end.alias("at"), F.when(match.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found)).cast(SPANS).alias("out"))

    empty = F.array().cast(SPANS).alias("out")

    def steps(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    # In parts of a thousand, as each append copies what there is.
    parts = let(pairs, lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / PART).cast("int")), lambda i: F.slice(all_, i * PART + 1, PART)))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty), steps, lambda acc: acc["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string's Luhn sum is a multiple of ten."""
    def term(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(y := F.regexp_replace(x, "^0+(?=.)", "")) <= 3) & (F.coalesce(F.try_to_number(y, F.lit("999999")).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: passes(kind, x["value"])


def in_order(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.element_at(rank, x["kind"]).alias("r"), x["end"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def base_spans(text: Column) -> Column:
    """array of (start, end, kind, value) of the fixed formats that pass their checks."""
    parts = []
    for kind, pattern in FORMATS.items():
        found = F.filter(matches(text, pattern, kind), _check(kind))
        parts.append(F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPANS)))
    return in_order(F.concat(*parts))


def furthest_ends(spans: Column) -> Column:
    """The largest end up to each span, carried along; in parts of a thousand, as each append copies what there is."""
    def step(acc: Column, x: Column) -> Column:
        most = F.greatest(acc["most"], x["end"])
        return F.struct(most.alias("most"), F.array_append(acc["out"], most).alias("out"))

    none = F.array().cast("array<int>").alias("out")

    def steps(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(spans, i * PART + 1, F.lit(PART)), F.struct(acc["most"].alias("most"), none), step)
        return let(inner, lambda x: F.struct(x["most"].alias("most"), F.concat(acc["out"], x["out"]).alias("out")))

    parts = F.sequence(F.lit(0), F.floor(F.size(spans) / PART).cast("int"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("most"), none), steps, lambda acc: acc["out"])


def outside(text: Column, base: Column) -> Column:
    """What stands between the spans; letters that run into a span go, as part of it."""
    return let(furthest_ends(base), lambda ends: _between(text, base, ends))


def _between(text: Column, base: Column, ends: Column) -> Column:
    n = F.size(base)

    def piece(i: Column) -> Column:
        low = F.when(i == 0, 0).otherwise(F.try_element_at(ends, i))
        high = F.when(i == n, F.length(text)).otherwise(F.try_element_at(base, i + 1)["start"])
        before = F.when(i == 0, " ").otherwise(F.substring(text, low, F.lit(1)))
        after = F.when(i == n, " ").otherwise(F.substring(text, high + 1, F.lit(1)))
        cut = F.concat(before, F.substring(text, low + 1, F.greatest(high - low, F.lit(0))), after)
        return F.regexp_replace(cut, r"^[\p{L}\p{M}]++|(?<![\p{L}\p{M}])[\p{L}\p{M}]++$", "")

    return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), " ")


def words_of(text: Column) -> Column:
    """The distinct terms of a text, as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def find_personal_data(docs: DataFrame, share: float = 0.75, support: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row of docs: arrays of (start, end, kind, value).

    Base spans are the fixed formats. The method adds terms: for a term t in one document with a protected
    value e, PMI(t;e) = log(N n(t,e) / (n(t) n(e))) over the N documents of the whole corpus says how much
    of e's information content IC(e) = log(N / n(e)) the term gives away. A term seen with e, outside
    base spans, in at least `support` distinct texts, with PMI >= `share` * IC, discloses e, and each of its
    occurrences outside base spans is a span, in every document, with e or without. All counts are of whole documents.

    Everything is DataFrame functions. Narrow rows are shuffled: values, terms of texts that hold a value which
    other texts hold too, and candidate terms' occurrences, aggregated before they meet. Values that stand in the
    same texts tell the same, so one of them meets the terms. A term in so many documents that its PMI can't reach
    the share with any count is left out before terms meet values. Sides are broadcast up to a counted size; beyond
    it, texts with many copies are met by broadcast and all others by a shuffle. The result is written to the shared
    folder, and the tables it came from are deleted.

    Null counts as empty: no spans. Repeated rows get equal spans, and equal texts count once towards
    `support`. A null id is allowed. Empty input gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text).alias("th"))

    def context(base: Column) -> Column:
        entity = F.transform(base, lambda e: F.when(e["kind"].isin("card", "phone"), digits_of(e["value"])).otherwise(F.lower(e["value"])))
        terms = F.array_distinct(F.transform(words_of(outside(F.col("text"), base)), lambda w: F.lower(w)))
        return F.struct(base.alias("base"), F.when(F.size(base) > 0, F.array_distinct(entity)).alias("entities"), F.when(F.size(base) > 0, terms).alias("terms"))

    scratch = Scratch(docs.sparkSession)
    scanned = scratch.save(rows.select("id", "th", let(base_spans(F.col("text")), context).alias("x")).select("id", "th", "x.base", "x.entities", "x.terms"))
    total = scanned.count()
    holders = scanned.filter("entities is not null")
    copies = holders.groupBy("th").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"))
    held = scratch.save(copies.select("th", "copies", F.explode("entities").alias("entity")))
    where = [F.sum(F.xxhash64(F.lit(seed), "th").cast("decimal(20,0)")).alias(f"where_{seed}") for seed in (1, 2)]
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), *where).filter(F.col("texts") >= support)
    entities = entities.groupBy("n_e", "texts", "where_1", "where_2").agg(F.min("entity").alias("entity")).select("entity", "n_e")
    held = scratch.save(held.join(entities, "entity"))
    terms = holders.select("th", F.explode("terms").alias("term")).distinct().join(held.select("th").distinct(), "th", "left_semi")
    terms = scratch.save(terms)
    wanted = scratch.save(terms.groupBy("term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= support).select("term"))
    words = rows.select(F.explode(F.array_distinct(F.transform(words_of(F.col("text")), lambda w: F.lower(w)))).alias("term"))
    if few(wanted):
        known = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        known = words.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")
    known = scratch.save(known)
    # n(t,e) <= n(e), so PMI >= share * IC asks for n(t) <= n(e) * (N / n(e)) ** (1 - share).
    most = F.col("n_e") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - share)) * 1.000001
    pairs = terms.join(known, "term").join(held, "th").filter(F.col("n_t") <= most)
    both = pairs.groupBy("term", "entity", "n_t", "n_e").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    pmi = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    telling = scratch.save(both.filter((content > 0) & (pmi >= share * content)).select("term").distinct())
    telling = F.broadcast(telling) if few(telling) else telling
    spoken = rows.select("th", F.explode(words_of(F.col("text"))).alias("word")).withColumn("term", F.lower("word"))
    found = scratch.save(spoken.join(telling, "term", "left_semi").groupBy("th").agg(F.collect_set("word").alias("words")))  # of one text each
    all_few = few(found)
    each = scanned.groupBy("th").agg(F.count("*").alias("copies"))
    texts = rows.join(F.broadcast(found), "th") if all_few else join_counted(rows, scratch.save(found.join(each, "th")), "th", "copies", total)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{M}])"))
    at = F.transform(matches(F.col("text"), pattern, "term"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lower(x["value"]).alias("value")))
    added = scratch.save(texts.select("th", at.alias("more")).dropDuplicates(["th"]))
    more = F.filter("more", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    if all_few:
        out = scanned.join(F.broadcast(added), "th", "left")
    else:
        out = join_counted(scanned, scratch.save(each.join(added, "th", "left")), "th", "copies", total)
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(in_order(F.concat(F.col("base"), more)))
    out = durable(out.select(F.col("id").alias(id_col), "base", every.alias("spans")))
    scratch.clear()
    return out


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in brackets, and telling terms removed; of overlapping spans the first wins."""
    def step(acc: Column, x: Column) -> Column:
        skip = x["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.when(skip, acc["at"]).otherwise(x["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(piece).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
