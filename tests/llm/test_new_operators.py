"""Operators 11 to 13 on small tables: brute-force versions, nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import audit, fim, vectors

SCHEMA = "doc_id long, text string, lang string, digest string, mask string, part string, id string, n string, `index` string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["clash"] * 6) for i, t, lang in rows], SCHEMA)


# Operator 12


def cut_by_hand(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_rate else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


def test_fill_in_middle(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "é😀\nß", "x <P> y\nz", "<S", "ends in <\nS>\n", "\r\n\x0b\n", "z" * 300_000, "\n" * 5000]
    texts += ["".join(rng.choice(["word ", "é", "😀", "\n", "<", "S>", "long" * rng.randrange(90)]) for _ in range(rng.randrange(400))) for _ in range(80)]
    texts.append("".join("y" * rng.choice([0, 1, 3, 4000]) + "\n" for _ in range(3000)))  # lengths that no one line fits
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (None, texts[6], None), (None, texts[6], None), (-4, texts[-1], "x")]
    for rate, spm in ((100, 50), (40, 0)):
        got = fim.fill_in_middle(docs_of(spark, rows), rate, spm).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *cut_by_hand(i, t, rate, spm)) for i, t, _ in rows)
        by_id = {i: t or "" for i, t, _ in rows}
        assert all(r.back == by_id[r.doc_id] for r in got)
    assert fim.fill_in_middle(docs_of(spark, rows).filter("false")).count() == 0


def test_rank_index_finds_every_boundary():
    rng = np.random.default_rng(3)
    for text in ["", "a", "\n" * 700, "é\n" * 500, "".join("x" * int(k) + "\n" for k in rng.pareto(1.0, 2000) * 3), "".join("x" * (k % 7) + "\n" for k in range(3000)) + "tail"]:
        y = fim.boundaries(text)
        assert y.tolist() == [0, *np.cumsum([len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text)])]
        first, base, slope = fim.fit_segments(y)
        left = np.frombuffer(fim.residuals(y, first, base, slope), dtype=np.uint8).astype(int) - 128
        assert abs(left).max() <= fim.BOUND + 1
        seg = np.searchsorted(first, np.arange(len(y)), side="right") - 1
        assert (base[seg] + np.floor(slope[seg] * (np.arange(len(y)) - first[seg])) + left == y).all()
    assert len(fim.fit_segments(fim.boundaries("12345\n" * 10_000))[0]) == 1  # equal lines are one segment


# Operator 11


def audit_by_hand(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = (i > least[t]) if i is not None else t in least
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shap = {}, defaultdict(int)
    for order in map("".join, itertools.permutations("ABCDE")):
        for k, letter in enumerate(order):
            for part in {d[0] for d in docs}:
                row = Counter()
                for p, fails, g, x in docs:
                    if p != part:
                        continue
                    gone = bool(fails & set(order[:k]))
                    hit = letter in fails
                    row["kept"] += not gone and not hit
                    row["removed"] += not gone and hit
                    row["redundant"] += gone and hit
                    row["unique_fails"] += fails == {letter}
                    row["good_lost"] += not gone and hit and g
                    row["toxic_lost"] += not gone and hit and x
                shap[part, letter] += row["removed"]
                out[part, order, k + 1] = row
    return {(p, o, k, *(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shap[p, o[k - 1]]) for (p, o, k), r in out.items()}


def some_rows():
    rng = random.Random(8)
    bodies = [None, "", " \n\t", "word " * 250, "Copy THIS", "a|b", " ".join(f"w{k}" for k in range(220)), " ".join(f"W{k}" for k in range(220)) + " $", "é" * 50 + "ABC", "q " * 60_000]
    rows = [(i, rng.choice(bodies), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(1000), 120)]
    rows += [rows[0], rows[0], (rows[1][0], rows[1][1], "fr"), (None, "a|b", "en"), (None, "only without id", "en"), (None, "only without id", "en"), (-5, "a|b", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (999_999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("descending", [True, False])
def test_filter_audit(spark, tmp_path, descending):
    rows, labels = some_rows()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=descending)  # smaller ids last: every batch retracts; rows without id at either end
    for k in range(5):
        docs_of(spark, ordered[k::5] if not descending else ordered[k * 26 : (k + 1) * 26]).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(spark, str(tmp_path / "documents.parquet"), table, batches=5)
    assert {tuple(r) for r in got.collect()} == audit_by_hand(rows, labels)


def test_filter_audit_of_an_empty_table_and_one_file(spark, tmp_path):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs_of(spark, []).write.parquet(str(tmp_path / "none.parquet"))
    assert audit.audit_filters(spark, str(tmp_path / "none.parquet"), table).count() == 0
    docs_of(spark, [(1, "a", "en"), (2, "a", "en")]).coalesce(1).write.parquet(str(tmp_path / "folder"))
    next((tmp_path / "folder").glob("*.parquet")).rename(tmp_path / "one.parquet")
    assert audit.audit_filters(spark, str(tmp_path / "one.parquet"), table).count() == 600


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    marks = audit.label_marks(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    state = audit.RetractingCounters(spark, str(tmp_path), marks, list("ABCDE"))
    schema = "digest string, id long, part string, mask int"
    batches = [spark.createDataFrame([("x", 9, "en", 1), ("y", 4, "en", 2)], schema), spark.createDataFrame([("x", 1, "de", 1), ("x", 9, "en", 1)], schema)]
    for k, batch in enumerate(batches):
        state.update(batch, k)
    once = {tuple(r) for r in state.counters().collect()}
    state.update(batches[1], 1)
    assert {tuple(r) for r in state.counters().collect()} == once == {("de", 1, True, False, 1), ("en", 17, False, False, 2), ("en", 2, False, False, 1)}


def test_many_labels_are_met_in_parts(spark):
    rows = spark.createDataFrame([("t", 1), ("t", 1), ("u", 2), ("v", None)], "digest string, id long")
    marks = audit.label_marks(spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    for few in (True, False):
        got = audit.with_labels(rows, marks, few).select("id", "good", "toxic").collect()
        assert Counter(tuple(r) for r in got) == Counter({(1, True, True): 2, (2, False, False): 1, (None, False, False): 1})


# Operator 13


def links_by_hand(rows, threshold):
    sound = [(i, np.array(v, dtype=float), lab) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v) else (i, None, lab) for i, v, lab in rows]
    n, links = len(rows), [set() for _ in rows]
    for a in range(n):
        for b in range(n):
            x, y = sound[a], sound[b]
            if a != b and x[1] is not None and y[1] is not None and x[2] == y[2] and len(x[1]) == len(y[1]):
                ux, uy = x[1] / np.abs(x[1]).max(), y[1] / np.abs(y[1]).max()
                if ux @ uy / np.linalg.norm(ux) / np.linalg.norm(uy) >= threshold:
                    links[a].add(b)
    out = Counter()
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out[rows[a][0], len(links[a]), least, rows[a][0] == least] += 1
    return out


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # hot buckets are cut in blocks; the tasks' own copy of the module keeps its portions
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for label in (1, 2, None):
        for _ in range(6):
            centre = rng.standard_normal(64)
            for _ in range(rng.integers(1, 25)):
                rows.append((at := at + 1, (centre + rng.standard_normal(64) * rng.choice([0.05, 0.12, 0.18, 0.4])).tolist(), label))
    rows += [(at + 100 + k, rows[5][1], rows[5][2]) for k in range(60)]  # copies
    rows += [(at + 200, (np.array(rows[5][1]) * 3).tolist(), 1), (at + 201, (np.array(rows[5][1]) * 1e200).tolist(), 1), (at + 202, (-np.array(rows[5][1])).tolist(), 1)]
    rows += [(None, rows[5][1], 1), (3, rows[5][1], 1), (at + 300, None, 1), (at + 301, [], 1), (at + 302, [0.0] * 64, 1), (at + 303, [float("nan")] + [1.0] * 63, 1), (at + 304, [None] + [1.0] * 63, 1)]
    rows += [(at + 305, [float("inf")] + [1.0] * 63, 1), (at + 306, [float("inf")] + [1.0] * 63, 1), (None, None, 1), (at + 400, [2.0], 1), (at + 401, [3.0], 1), (at + 402, [-3.0], 1), (at + 403, [1.0, 0.0], 2), (at + 404, [1.0, 0.1], 2), (None, [0.0, 1.0], 2)]
    schema = T.StructType().add("vec_id", T.LongType()).add("embedding", T.ArrayType(T.DoubleType())).add("label", T.IntegerType()).add("n", T.StringType()).add("rid", T.StringType()).add("key", T.StringType())
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect())
    want = links_by_hand(rows, 0.98)
    want = Counter({(i, n, c, True if i is None and c is None else kept): k for (i, n, c, kept), k in want.items()})
    assert got == want
    assert vectors.near_vectors(table.filter("false")).count() == 0
    assert vectors.near_vectors(table.filter("embedding is null")).count() == 2


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    y = x + rng.standard_normal((4000, 64)) * 0.2
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    label = np.zeros(4000, dtype=np.int64)
    (_, cx, fx), (_, cy, fy) = vectors.encode(x, label, 13, 17), vectors.encode(y, label, 13, 17)
    dx, dy = vectors.decode(cx, fx, 64), vectors.decode(cy, fy, 64)
    guess = ((dx[:, 0] * dy[:, 1]).sum(1) + (dx[:, 1] * dy[:, 0]).sum(1)) / 2
    true = (x * y).sum(1)
    assert abs((guess - true).mean()) < 0.005
    (ax, bx), (ay, by) = vectors.lowest_estimate(fx, 64, 0.98), vectors.lowest_estimate(fy, 64, 0.98)
    near = true >= 0.98
    assert near.sum() > 500 and (guess[near] >= 0.98 - vectors.SURE * np.sqrt(ax + ay + bx * by)[near]).all()
    far = rng.permutation(4000)
    low = ((dx[:, 0] * dy[far, 1]).sum(1) + (dx[:, 1] * dy[far, 0]).sum(1)) / 2
    assert (low >= 0.98 - vectors.SURE * np.sqrt(ax + ay[far] + bx * by[far])).mean() < 0.01  # the codes exclude nearly all others


def test_saved_tables_leave_no_shuffle_files_and_can_be_freed(spark):
    from pathlib import Path

    from pyspark.sql import functions as F

    from ledgerloom.llm.common import SHUFFLE_CLEANUP, Scratch

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    scratch, before, setting = Scratch(spark), shuffles(), spark.conf.get(SHUFFLE_CLEANUP, None)
    first = scratch.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    second = scratch.save(first.groupBy("count").agg(F.sum("k").alias("k")))
    assert not shuffles() - before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    scratch.free(first)
    folder = Path(scratch.path.removeprefix("file:"))
    assert [p.name for p in folder.iterdir() if p.is_dir()] == ["2"] and second.count() == 2
    scratch.clear()
    assert not folder.exists()
