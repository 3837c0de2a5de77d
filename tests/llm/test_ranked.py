from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import maxscore
from sweepframe.llm.spans import unpack

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def plain(docs, items, k):
    """Every document scored for every item, as the contract states it."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((score, doc_id))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, doc_id, score) for rank, (score, doc_id) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shard,most", [(4000, 32), (1 << 21, 8), (500, 0)])
def test_whole_tables(spark, tables, monkeypatch, shard, most):
    monkeypatch.setattr(maxscore, "SHARD_TERMS", shard)
    monkeypatch.setattr(maxscore, "PAIR_TERMS", most)
    monkeypatch.setattr(maxscore, "PASS_TERMS", 200)
    docs, items = (spark.read.parquet(f"{tables}/{name}.parquet") for name in ("documents", "benchmark"))
    found = maxscore.ranked(maxscore.build_index(docs.repartition(2)), items, 10)
    wanted = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert rows(found) == wanted


def test_odd_rows(spark, odd, none):
    items = [(1, "the SMALL text, the sea; 12345"), (2, None), (3, ""), (4, "!!! ..."), (5, "naïve ÜBER café"), (5, "naïve ÜBER café"), (None, "the wind"), (6, "word " * 5000 + "fox")]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, rank int")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows(maxscore.ranked(maxscore.build_index(odd), asked, 3)) == plain(docs, items, 3)
    assert maxscore.ranked(maxscore.build_index(none), asked).count() == 0
    assert maxscore.ranked(maxscore.build_index(odd), asked.where("false")).count() == 0
    empty = odd.where("text is null")
    assert maxscore.ranked(maxscore.build_index(empty), asked).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "alpha beta") for i in (9, 3, 7, 3, 1)] + [(None, "alpha beta"), (50, "gamma")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(0, "beta")], "item_id long, text string")
    index = maxscore.build_index(table)
    assert rows(maxscore.ranked(index, asked, 4)) == plain(docs, [(0, "beta")], 4)
    assert rows(maxscore.ranked(index, asked, 9)) == plain(docs, [(0, "beta")], 9)


def shard_of(texts, most=32):
    parts = []
    for i, words in enumerate(texts):
        parts.append((np.array(words, np.uint64), np.full(len(words), i)))
    row = {"shard": 0, "ids": maxscore.pack(np.arange(len(texts))), "nulls": np.packbits(np.zeros(len(texts), bool)).tobytes()}
    batch = maxscore._table([row | maxscore._postings_of(parts, len(texts))], maxscore._POSTINGS)
    n = sum(map(len, texts))
    (made,) = maxscore._add_impacts(len(texts), n, most)(iter([batch]))
    return maxscore.Shard(made.to_pylist()[0]), made.to_pylist()[0]


def test_pairs_tighten_the_bounds():
    rng = np.random.default_rng(5)
    # Words 1 to 8 are frequent but seldom together, words from 100 on are rare.
    texts = []
    for _ in range(3000):
        common = rng.choice(8, rng.integers(1, 3), replace=False) + 1
        texts.append([*np.repeat(common, rng.integers(1, 4, len(common))), *rng.integers(100, 400, rng.integers(1, 30))])
    shard, row = shard_of(texts)
    assert len(unpack(row["pair_terms"], np.int32)) == 32 and len(shard.pair_sum) == 32 * 31 // 2
    with_pairs, without = maxscore.Work(), maxscore.Work()
    for seed in range(40):
        rng = np.random.default_rng(seed)
        asked = np.unique(np.concatenate([rng.choice(8, 6, replace=False) + 1, rng.integers(100, 400, 3)])).astype(np.uint64)
        df = np.array([sum(t in x for x in map(set, texts)) for t in asked.tolist()]) if seed < 1 else np.diff(shard.starts)[shard.find(asked)]
        weights = maxscore.weights_of(df, len(texts))
        results = []
        for pairs, work in ((True, with_pairs), (False, without)):
            members, scores = maxscore.search(shard, asked, weights, 10, 0, pairs, work)
            order = np.lexsort((members, -scores))[:10]
            results.append((members[order].tolist(), scores[order].tolist()))
        found = shard.find(asked)
        sums = np.zeros(len(texts), np.int64)
        for t, w in zip(found, weights):
            sums[shard.places[shard.starts[t] : shard.starts[t + 1]]] += w * shard.impacts[shard.starts[t] : shard.starts[t + 1]]
        best = np.lexsort((np.arange(len(texts)), -sums))[:10]
        assert results[0] == results[1] == (best.tolist(), sums[best].tolist())
    assert with_pairs.postings + with_pairs.completed < 0.9 * (without.postings + without.completed)


def test_joint_bound_holds():
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 12, rng.integers(1, 25)).tolist() for _ in range(200)]
    shard, _ = shard_of(texts, 6)
    for a in shard.pair_of:
        for b in shard.pair_of:
            if a != b:
                for wa, wb in ((1, 1), (1000, 3), (7, 900)):
                    bound, at = shard.joint(a, b, wa, wb)
                    dense = np.zeros((2, shard.docs), np.int64)
                    for i, t in enumerate((a, b)):
                        dense[i, shard.places[shard.starts[t] : shard.starts[t + 1]]] = shard.impacts[shard.starts[t] : shard.starts[t + 1]]
                    both = (dense > 0).all(axis=0)
                    assert (wa * dense[0] + wb * dense[1])[both].max(initial=0) <= bound
                    assert (np.unpackbits(shard.pair_bits[at], count=shard.docs).astype(bool) == both).all()


def test_very_long_text(spark):
    text = "Big red dog " * 400_000
    docs = [(1, text), (2, "big cat"), (3, "one dog")]
    table = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("x").alias("terms"))
    asked = spark.createDataFrame([(0, "dog cat")], "item_id long, text string")
    assert rows(maxscore.ranked(maxscore.build_index(table), asked)) == plain(docs, [(0, "dog cat")], 50)
