from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from sweepframe.llm import decontaminate, licenses, mixing, topk
from sweepframe.llm.queries import QUERIES, SQL, WEIGHTS, _mix_sql, tree


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    assert difference(spark, connect(folder), QUERIES[name], SQL[name], folder) is None


def plain_top(rows, k):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in kept:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.1, 7).astype(np.float32)]) for i in range(300)]
    rows += [(400, None), (450, [None, 1.0]), (500, [float("nan")] * 7), (550, [float("inf")] + [0.0] * 6), (600, []), (650, [0.5, -0.5])]
    rows += [(None, [1.0] * 7), (700, [0.1] * 7), (700, [0.1] * 7), (701, [0.1] * 7), (702, [0.1] * 7)]
    rows += [(-50, [9.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    found = topk.top_k(table, lambda i: i % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5)
    assert topk.top_k(table.where("false"), lambda i: i % 50 == 0).count() == 0
    assert topk.top_k(table.where("vec_id = 0"), lambda i: i % 50 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), lambda i: i == 0).count()


def test_repeated_rows_leave_blocks_bounded(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    plain = topk.packed

    def watched(*args):
        out = plain(*args)
        sizes.add(max(len(r["ids"]) // 8 for r in out.select("ids").collect()))
        return out

    monkeypatch.setattr(topk, "packed", watched)
    rows = [(50, [0.5, 0.25])] * 300 + [(7, [0.5, 0.5])] * 300 + [(i, [i / 64, 0.125]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = topk.top_k(table, lambda i: i % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5)
    # The index has each of the two no more than five times, the query block once.
    assert sizes.value <= 40 + 2 * 5 + 2


def test_search_stops_on_proof():
    rng = np.random.default_rng(1)
    values = np.zeros((2000, 30), np.int32)
    values[:, 0] = rng.integers(0, 4000, 2000)
    values[:, 1:] = rng.integers(-3, 4, (2000, 29))
    index = topk.Index(np.arange(2000), values)
    query = np.array([50] + [1] * 29, np.int32)
    ids, scores = index.search(query, 5, -1)
    full = values.astype(np.int64) @ query
    assert scores.tolist() == sorted(full.tolist(), reverse=True)[:5]


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        text = "".join(rng.choices("abcd", k=rng.randint(0, 90)))
        if rng.random() < 0.5:
            text = text + pattern[: rng.randint(0, 80)] + text
        found = decontaminate.distance_within(pattern, text, len(pattern))
        assert found[0] == plain_distance(pattern, text)
        tail = text[: found[1]]
        assert plain_distance(pattern[::-1], tail[::-1]) == found[0]


def edited(rng, text, n):
    letters = list(text)
    for _ in range(n):
        i = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[i] = "q"
        elif kind == 1 and len(letters) > 1:
            del letters[i]
        else:
            letters.insert(i, "z")
    return "".join(letters)


def test_items_are_found_up_to_the_budget(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    items = [" ".join(rng.choices(words, k=rng.randint(6, 40))) for _ in range(12)]
    docs, want = [], set()
    for i in range(150):
        parts = [" ".join(rng.choices(words, k=30))]
        for item in rng.sample(range(12), rng.randint(0, 2)):
            parts += [edited(rng, items[item], rng.randint(0, 4)).upper(), "\n  filler words here  "]
        docs.append((i, " ".join(parts)))
    for i, text in docs:
        for j, item in enumerate(items):
            if plain_distance(item, decontaminate.plain(text)) <= len(item) * decontaminate.PERCENT // 100:
                want.add((i, j, plain_distance(item, decontaminate.plain(text))))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " "), (None, "an item without an id that nothing holds")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(table, bench).collect()}
    assert found == want
    kept = {r["doc_id"] for r in decontaminate.clean(table, bench).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want}


def test_several_passes_find_the_same(spark, tables, odd, none, monkeypatch):
    docs, bench = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "benchmark"))
    once = sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "distance").collect()))
    assert once and len(once) < 0.2 * docs.count()
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 900)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "distance").collect())) == once
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - {x[0] for x in once}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontaminate.clean(none, bench).count() == decontaminate.contaminated(odd, bench.where("false")).count() == 0
    assert decontaminate.clean(odd, bench.where("false")).count() == odd.count()


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, supply long")
    found = lambda total, weights=None: {(r["domain"], r["lang"]): r["budget"] for r in mixing.budgets(leaves, ["domain", "lang"], weights or {}, F.lit(total)).collect()}
    assert found(800) == {("a", "x"): 10, ("a", "y"): 390, ("b", "x"): 200, ("b", "y"): 200}
    assert found(3000) == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 995, ("b", "y"): 995}
    assert sum(found(9999).values()) == 3010
    assert found(1001, {"domain": {"a": 0}}) == {("a", "x"): 0, ("a", "y"): 0, ("b", "x"): 500, ("b", "y"): 501}


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd, tree(), WEIGHTS, percent=100, epochs=1).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sum(r["taken"] for r in rows) == sum(len(t.encode().split()) for t in texts)
    twice = mixing.mix(odd, tree(), WEIGHTS, percent=60, epochs=3).collect()
    assert all(0 <= r["taken"] <= r["n_tokens"] for r in twice)
    assert mixing.mix(none, tree(), WEIGHTS).count() == 0
    kept = mixing.mixed_documents(odd, tree(), WEIGHTS, 100)
    assert kept.columns == odd.columns and kept.count() > 0
    assert mixing.mixed_documents(none, tree(), WEIGHTS, 90).count() == 0


def test_licenses(spark, tables, odd, none):
    scanner = licenses.train(spark)
    lines = [
        ("Licensed under the Apache License, Version 2.0.", "apache", True),
        ("released under the mit license", "mit", True),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl", True),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", True),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa", True),
        ("My neighbour has no license to keep bees.", "unknown", False),
        ("No warranty was given for the old bicycle.", "unknown", False),
    ]
    table = spark.createDataFrame([(i, f"Some words.\n{t}\nMore words.") for i, (t, _, _) in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"]: (r["line"], r["family"], r["confirmed"]) for r in licenses.license_lines(table, scanner).collect()}
    assert found == {i: (1, family, sure) for i, (_, family, sure) in enumerate(lines)}
    assert licenses.license_lines(none, scanner).count() == licenses.license_lines(odd, scanner).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licenses.license_lines(docs, scanner).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    notices = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General", "cc-by-nc": "CC BY-NC"}
    want = sorted((d, f) for d, t in texts.items() for line in t.split("\n") for f, n in notices.items() if n in line)
    assert want and sorted((r["doc_id"], r["family"]) for r in rows if r["confirmed"]) == want


def test_licenses_beyond_single_cued_lines(spark):
    scanner = licenses.train(spark)
    mit = "Permission is hereby granted, free of\ncharge, to any person obtaining\na copy of this software and\nassociated documentation files."
    bsd = "Redistribution and use\nin source and binary\nforms, with or without\nmodification, are permitted\nprovided that the following\nconditions are met."
    texts = [
        ("One.\nAll rights reserved.\nTwo.", 1, "all-rights-reserved", False),
        ("One.\nDistributed under the GPL, version 2 or later\nTwo.", 1, "gpl", True),
        ("Released under GPLv3", 0, "gpl", True),
        ("One.\nCC BY 4.0\nTwo.", 1, "cc-by", True),
        (f"One.\nTwo.\n \n\n{mit}\n\nThree.", 4, "mit", True),
        (f"{bsd}\n\nThree.", 0, "bsd", True),
    ]
    table = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id long, text string")
    rows = [(r["doc_id"], r["line"], r["family"], r["confirmed"]) for r in licenses.license_lines(table, scanner).collect() if r["family"] != "unknown"]
    assert {(i, *want) for i, (_, *want) in enumerate(texts)} <= set(rows)
    assert len({(r[0], r[2]) for r in rows if r[3]}) == sum(r[3] for r in rows)


@pytest.mark.parametrize("percent,epochs", [(60, 1), (37, 3), (100, 2)])
def test_budgets_are_exact_with_repeated_and_null_ids(spark, tmp_path, monkeypatch, percent, epochs):
    monkeypatch.setattr(mixing, "_BUCKET", 4)
    monkeypatch.setattr(mixing, "_STEP", 7)
    ten, six = "one two three four five six seven eight nine ten", "a b c d e f"
    rows = [(None, ten, "en", "src1")] * 100 + [(5, six, "en", "src1")] * 50 + [(6, ten, "en", "src1")] * 50 + [(6, six, "en", "src1")] * 3
    rows += [(i, " ".join(["w"] * (i % 13)), "de", f"src{i % 4}") for i in range(200)] + [(None, None, None, None), (7, "", "fr", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    names = list(tree())
    counted = mixing.levelled(docs, tree())
    planned = mixing.plan(counted, names, WEIGHTS, percent, epochs, 1).where("tokens > 0")
    taken = mixing.mix(docs, tree(), WEIGHTS, percent, epochs).groupBy(*names).agg(F.sum("taken").alias("taken"))
    found = planned.join(taken, names, "left").select("budget", F.coalesce("taken", F.lit(0)).alias("taken")).collect()
    assert len(found) == planned.count() and all(r["budget"] == r["taken"] for r in found)
    assert sum(r["budget"] for r in found) == percent * sum(len((r[1] or "").split()) for r in rows) // 100
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.execute(_mix_sql(percent, epochs, 1))
    columns = [d[0] for d in sql.description]
    here = mixing.mix(docs, tree(), WEIGHTS, percent, epochs).select(*columns)
    assert sorted(map(str, map(tuple, here.collect()))) == sorted(map(str, sql.fetchall()))
    # Whole documents: less than one document beyond the budget, never all copies of the last one.
    if epochs == 1:
        kept = mixing.levelled(mixing.mixed_documents(docs, tree(), WEIGHTS, percent), tree()).groupBy(*names).agg(F.sum("n_tokens").alias("n"))
        for r in planned.join(kept, names, "left").collect():
            assert r["budget"] <= (r["n"] or 0) < r["budget"] + 12
