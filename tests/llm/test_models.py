from __future__ import annotations

import collections
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sweepframe.llm import common, language, language_model, toxicity
from sweepframe.llm.queries import QUERIES


def remainder(doc, n):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n


def plain_scores(rows):
    """``tokens, known, train tokens, base`` of ``(doc_id, text)`` rows."""
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    counts = collections.Counter()
    for d, w in words:
        if remainder(d, 7) != 2:
            counts.update([*w, None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, w in words:
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in [*w, None])
        out.append((str(d), remainder(d, 7) == 2, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, round(base, 6)))
    return sorted(out)


def scored(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


def test_language_model(spark, tables, texts, monkeypatch):
    want = plain_scores(texts.items())
    found = QUERIES["op6_language_model"](spark, tables)
    assert scored(found) == want
    held = [r for r in found.collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # Words beyond the table that workers get are counted by a join: same scores.
    monkeypatch.setattr(language_model, "HEAD", 50)
    assert scored(QUERIES["op6_language_model"](spark, tables)) == want


def test_language_model_of_odd_rows(odd, none):
    run = lambda df: language_model.language_model_scores(df, common.fold(F.col("doc_id"), 7) == 2)
    assert scored(run(odd)) == plain_scores([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert run(none).count() == 0
    untrained = language_model.language_model_scores(odd, F.lit(True)).collect()
    assert len(untrained) == odd.count() and all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_filter_is_never_too_low():
    rng = np.random.default_rng(2)
    grams = common.mixed(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    counts = rng.integers(1, 900, 3000)
    order = np.argsort(grams)
    import pyarrow as pa

    batch = language_model._packed(grams[order], counts[order], 3)
    bits = 1 << 14
    field = np.zeros(8 * bits >> 3, np.uint8)
    table = pa.Table.from_batches([batch])
    for row in range(batch.num_rows):
        built = language_model._build(bits)((batch["block"][row],), table.slice(row, 1)).to_pylist()[0]
        field[built["block"] * bits // 8 : (built["block"] + 1) * bits // 8] = np.frombuffer(built["bits"], np.uint8)
    found = language_model.Filter(field, 3).counts(grams)
    assert (found * 1.5 >= counts).all() and np.mean(found <= counts * 1.5) > 0.9
    assert np.mean(language_model.Filter(field, 3).counts(common.mixed(grams + np.uint64(1))) > 0) < 0.9


def test_a_large_filter_keeps_its_rate(spark, tables, monkeypatch):
    by_id = lambda: sorted((r["doc_id"], *r[1:6], round(r["score"], 6)) for r in QUERIES["op6_language_model"](spark, tables).collect())
    want = by_id()
    # A filter beyond what workers get is asked by a shuffle: not one bit less, so the same scores.
    monkeypatch.setattr(language_model, "MOST_BITS", 1 << 13)
    monkeypatch.setattr(language_model, "_PART_BYTES", 1 << 14, raising=False)
    got = by_id()
    assert [r[:4] + (r[6],) for r in got] == [r[:4] + (r[6],) for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def test_shuffled_scores_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(language_model, "MOST_BITS", 0)
    run = lambda df: language_model.language_model_scores(df, common.fold(F.col("doc_id"), 7) == 2)
    assert scored(run(odd)) == plain_scores([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert run(none).count() == 0


def test_word_hashes():
    texts = [b"Ab c", b"", b"  ", b"c\nAB", "É é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, bounds = common.words(data, offsets)
    assert bounds.tolist() == [0, 2, 2, 2, 4, 6]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[4] != hashes[5]
    low, _ = common.words(data, offsets, letters=True)
    assert low[4] == low[5] == common.word_hash("é")
    assert len(common.words(np.zeros(0, np.uint8), np.array([0, 0]))[0]) == 0


def test_language(spark, tables):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = QUERIES["op5_language"](spark, tables).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) >= 0.97
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_of_odd_rows(spark, tables, odd, none):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language.train(docs)
    rows = language.identify(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == odd.count()
    lost = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert lost == {2, 3, 4, 7, None} and all(r["rejected"] and r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language.accepted(odd, model).columns == odd.columns
    assert language.train(none) is None
    assert {r["lang_pred"] for r in language.identify(odd, None, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language.identify(none, model, {"doc_id": F.col("doc_id")}).count() == 0


def test_a_text_is_judged_alone():
    parts = ["Über den Fluss".encode(), b"", b"the end", "été".encode(), b"!!"]
    codes, bounds = language.buckets(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    for i, part in enumerate(parts):
        own, own_bounds = language.buckets(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        assert codes[bounds[i] : bounds[i + 1]].tolist() == own[: own_bounds[-1]].tolist()


def test_memory_of_scoring_many_texts():
    words = "the house der hund und le chat est grand une maison".split()
    texts = [" ".join(words[(i + j) % 11] for j in range(300)).encode() for i in range(600)]
    table = np.random.default_rng(2).random((language.BUCKETS, 3)).astype(np.float32)
    model = language.Model(["a", "b", "c"], table, np.zeros(3), 1.0, 0.0)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], ["_content", "_lettered"])
    tracemalloc.start()
    found = [x for out in language._predict(model)(iter([batch])) for x in out.column("score").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = [model.scores(np.frombuffer(x, np.uint8), np.array([0, len(x)])).max() for x in texts[::50]]
    assert found[::50] == alone and len(found) == len(texts)
    assert peak < 30e6, peak


def plain_nearest(vectors, query, k):
    values = [(round(sum(w * v.get(t, 0) for t, w in query.items()), 9), i) for i, v in enumerate(vectors)]
    return [(s, i) for s, i in sorted(values, key=lambda x: (-x[0], x[1])) if s > 0][:k]


def test_blocks_find_the_nearest():
    rng = np.random.default_rng(4)
    terms = np.sort(common.mixed(np.arange(1, 41, dtype=np.uint64)))
    index = toxicity.Index(terms, rng.uniform(0.5, 4, 40))
    runs = [terms[rng.integers(0, 40, rng.integers(0, 9))] for _ in range(400)]
    bounds = np.cumsum([0, *map(len, runs)])
    text, term, weight = index.vectors(np.concatenate(runs), bounds)
    index.load(text, term, weight, list(range(400)), np.zeros(400))
    full = [{} for _ in runs]
    for i, t, w in zip(text.tolist(), term.tolist(), weight.tolist()):
        full[i][t] = w
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in full if v)
    for i in range(60):
        here = text == i
        places, values = index.nearest(term[here], weight[here])
        want = plain_nearest(full, full[i], toxicity.NEIGHBOURS)
        assert np.allclose(values, [s for s, _ in want], atol=1e-8)


def plain_words(text):
    """Runs of ASCII letters and bytes beyond ASCII, in lower case, accented capitals too."""
    low = "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[a-z\x80-\xff]+", low.encode())]


def test_toxicity_against_brute_force(spark, tables):
    """Every similarity, vote and score of the query, by plain dictionaries over all words of all examples."""
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    texts = {r["doc_id"]: Counter(plain_words(r["text"])) for r in docs.collect()}
    raw = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if remainder(r["doc_id"], 5) != 0}
    first: dict = {}
    for i in sorted(set(marks) & set(raw)):
        first.setdefault(raw[i], [i, 0])
        first[raw[i]][1] |= marks[i]
    examples = dict(map(tuple, first.values()))
    index = toxicity.build(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert sorted(index.ids) == sorted(i for i in examples if texts[i])
    n, df = len(texts), Counter(w for c in texts.values() for w in c)
    known = {w for i in examples for w in texts[i]}
    sizes = [sum(1 for y in examples.values() if y == label) for label in (0, 1)]
    held = {w: [0, 0] for w in known}
    for i, y in examples.items():
        for w in texts[i]:
            held[w][y] += 1
    chance = math.log(max(2, sum(1 for a, b in held.values() if a + b >= 2)))
    share = sizes[1] / sum(sizes)

    def weight(w):
        if w not in known:
            return math.log((1 + n) / 2) + 1e-3
        total, rate = sum(held[w]), held[w][1] / sum(held[w])
        told = 0.0
        if rate > share:
            told = total * (rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0))
        return (math.log((1 + n) / (1 + df[w])) + 1e-3) * (1 + toxicity.BOOST * math.log1p(max(0, told - chance)))

    def vector(counts):
        out = {w: (1 + math.log(c)) * weight(w) for w, c in counts.items()}
        length = math.sqrt(sum(v * v for v in out.values()))
        return {w: v / length for w, v in out.items()} if length else {}

    vectors = {i: vector(texts[i]) for i in index.ids}
    for r in toxicity.toxicity(docs, index, F.lit(False)).collect():
        query = vector(texts[r["doc_id"]])
        near = sorted((-sum(v * vectors[i].get(w, 0) for w, v in query.items()) for i in vectors))[: toxicity.NEIGHBOURS]
        assert np.allclose([e["similarity"] for e in r["evidence"]], [-s for s in near if s < 0], atol=1e-9)
        assert all(e["toxic"] == examples[e["doc_id"]] for e in r["evidence"])
        vote = sum(e["similarity"] * (2 * e["toxic"] - 1) for e in r["evidence"]) / toxicity.NEIGHBOURS
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, index.slope * vote + index.shift))))) < 1e-9


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(toxic[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    good, bad = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.7
    assert sum(s >= 0.5 for s in bad) <= 0.03 * len(bad)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    index = toxicity.build(docs, labels)
    some = toxicity.toxicity(odd, index, F.lit(False)).collect()
    assert len(some) == odd.count() and all(0 <= r["score"] < 0.5 for r in some)
    assert toxicity.toxicity(none, index, F.lit(False)).count() == 0
    blank = toxicity.build(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.toxicity(odd, blank, F.lit(False)).collect()} == {0.0}


def test_a_shuffled_filter_is_sent_each_text_once(spark, odd, monkeypatch):
    docs = odd.unionByName(odd.withColumn("text", F.concat_ws(" ", "text", F.lit("wind wave one two"))))
    run = lambda: language_model.language_model_scores(docs, common.fold(F.col("doc_id"), 7) == 2)
    by_row = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], *r[3:5], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())
    want = by_row(run())
    for name, value in {"MOST_BITS": 0, "HEAD": 3, "_PART_BYTES": 1 << 10, "_GATHER": 8}.items():
        monkeypatch.setattr(language_model, name, value)
    kept = []
    monkeypatch.setattr(language_model, "stored", lambda df, label: kept.append(label) or common.stored(df, label))
    found = run()
    assert [r[:5] for r in by_row(found)] == [r[:5] for r in want]
    # Only the exact word counts are stored, and the texts' n-grams are dealt once, to be counted and to ask.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert kept == ["words"] and plan.count("hashpartitioning(block") <= 2
    # A part, its blocks' answers and the scores of its texts stand together whatever the parts are.
    monkeypatch.setattr(language_model, "_PART_BYTES", 1 << 30)
    assert by_row(run()) == by_row(found)
