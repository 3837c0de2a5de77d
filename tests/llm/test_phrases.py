from __future__ import annotations

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import collocations as phrases
from sweepframe.llm import common


def plain(rows, least, longest, best, absorb=100):
    """The contract read word for word: every phrase counted, every cut tried, every longer phrase looked into."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        absorbed = set()
        for p, a in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= absorb * counts[p[i : i + size]]:
                        absorbed.add(p[i : i + size])
        kept = []
        for p, a in often.items():
            if len(p) > 1 and p not in absorbed:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                more = [(q, b) for q, b in often.items() if len(q) == len(p) + 1]
                lefts = max((b for q, b in more if q[1:] == p), default=None)
                rights = max((b for q, b in more if q[:-1] == p), default=None)
                kept.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score, lefts, rights))
        kept.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(kept[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("longest,best,absorb", [(5, 2000, 100), (4, 7, 60), (2, 50, 100), (3, 50, 100)])
def test_many_shards(spark, tables, monkeypatch, longest, best, absorb):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 3000)
    monkeypatch.setattr(phrases, "BUCKET_ITEMS", 5000)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 2000)
    docs = spark.read.parquet(f"{tables}/documents.parquet").repartition(3)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    found = phrases.collocations(docs, 6, longest, best, absorb)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 6, longest, best, absorb)


def test_odd_rows(spark, odd, none):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    found = phrases.collocations(odd, 2)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 2, 5, 2000)
    assert phrases.collocations(none, 2).count() == 0
    assert phrases.collocations(odd.where("text is null"), 1).count() == 0
    renamed = odd.withColumnsRenamed({"text": "body", "lang": "tongue"}).withColumn("text", F.lit("x y x y")).withColumn("shard", F.lit(1))
    other = phrases.collocations(renamed, 2, text="body", lang="tongue")
    assert sorted(map(tuple, other.collect()), key=str) == plain(rows, 2, 5, 2000)


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    text = "Big red dog, " * 400_000 + "x" * 50 + " and one tail\x0bend\x00word \xa0 big red"
    docs = spark.createDataFrame([(text, "en"), ("word " * 300_000, None)], "text string, lang string")
    found = {r["phrase"]: r for r in phrases.collocations(docs, 100).where("lang = 'en'").collect()}
    # "big red" occurs once more, so it is not held by the longer phrase alone.
    assert {p: r["a"] for p, r in found.items()} == {"big red dog": 400_000, "big red": 400_001}
    assert found["big red dog"]["n"] == 1_200_008


def test_intervals_against_plain_counts():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.int32)
    numbers = np.array([-1, 10, 11, -1, 13])
    fm = phrases.FMIndex(phrases.transform(symbols, 3), phrases.transform(symbols[::-1], 3), numbers)
    def windows(size):
        return [tuple(numbers[w].tolist()) for w in np.lib.stride_tricks.sliding_window_view(symbols, size) if (numbers[w] >= 0).all()]

    pairs = fm.extend(fm.words())
    assert dict(zip(map(tuple, pairs.ids.tolist()), pairs.size.tolist())) == Counter(windows(2))
    pairs = pairs.where(pairs.size > 12)
    often = set(map(tuple, pairs.ids.tolist()))
    # Only parts that were kept are extended, on either side.
    triples = fm.extend(pairs)
    assert dict(zip(map(tuple, triples.ids.tolist()), triples.size.tolist())) == Counter(t for t in windows(3) if t[:2] in often and t[1:] in often)


def test_score_needs_more_than_64_bits(spark):
    a, n, left, right = 9 * 10**13, 9 * 10**14, 10**14 + 7, 10**14 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(f"{phrases.SCORE} as s").first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_memory_of_a_shards_ngrams():
    rng = np.random.default_rng(4)
    symbols = np.append(1 + np.minimum(rng.zipf(1.3, 200_000), 19_999), 0).astype(np.int32)
    fm = phrases.FMIndex(phrases.transform(symbols, 4), phrases.transform(symbols[::-1], 4), np.arange(-1, 20_000))
    grams = fm.words()
    for _ in range(3):
        grams = fm.extend(grams)
    tracemalloc.start()
    grams = fm.extend(grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert grams.ids.shape[1] == 5 and grams.ids.itemsize == 4
    assert peak < 90 * len(symbols)


def test_memory_of_a_shard():
    rng = np.random.default_rng(5)
    words = [b"word%x" % i for i in np.minimum(rng.zipf(1.3, 200_000), 19_999)]
    shard = phrases._Shard()
    for i in range(0, len(words), 50_000):
        data = np.frombuffer(b" ".join(words[i : i + 50_000]), np.uint8)
        shard.add(data, np.array([0, len(data)]), np.zeros(1, np.int32), np.zeros(1, np.uint64))
    tracemalloc.start()
    row = shard.row(0, ["en"], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = dict(zip(row.column("words")[0].as_py(), row.column("counts")[0].as_py()))
    assert counts == {k.decode(): v for k, v in Counter(words).items()}
    assert peak < 75 * len(words), peak / len(words)


def test_distinct_hashes():
    hashes = np.random.default_rng(6).integers(0, 50, 400).astype(np.uint64)
    expected = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    for one, two in zip(phrases.distinct(hashes), expected):
        assert one.tolist() == two.tolist()
    assert [x.tolist() for x in phrases.distinct(hashes[:0])] == [[], [], [], []]


def test_a_worker_gives_memory_back_around_groups(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append("back"))
    assert common.released_group(lambda key, table: calls.append((key, table)) or 7)(1, 2) == 7
    assert calls == ["back", (1, 2), "back"]
