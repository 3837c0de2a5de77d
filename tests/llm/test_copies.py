from __future__ import annotations

import numpy as np
import pytest
import xxhash

from sweepframe.llm import simhash
from sweepframe.llm.components import components
from sweepframe.llm.queries import QUERIES


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, prints, radius=3):
    values = np.array(prints, np.uint64)
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(ids))]


def check(rows, found):
    prints = [plain_fingerprint(t) for _, t in rows]
    classes = plain_classes([d for d, _ in rows], prints)
    want = [(str(d), f"{p:016x}", str(c)) for (d, _), p, c in zip(rows, prints, classes)]
    got = [(str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found]
    assert sorted(got) == sorted(want)


def test_query(spark, tables, texts):
    check(list(texts.items()), QUERIES["op4_simhash"](spark, tables).collect())


def test_odd_rows(odd, none):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], simhash.near_copies(odd).collect())
    assert simhash.near_copies(none).count() == 0


@pytest.mark.parametrize("quartered", [1 << 21, 0])
def test_tiles_lose_no_link(spark, monkeypatch, quartered):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "QUARTERED", quartered)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for _ in range(4):  # chains of near values
        values = np.concatenate([values, values[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))])
    values = np.unique(values)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
    label = plain_classes(list(range(len(values))), values)
    groups = {}
    for v, c in zip(values.view(np.int64).tolist(), label):
        groups.setdefault(c, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 500).selectExpr("id * 7 % 1009 AS u", "(id + 1) * 7 % 1009 AS v")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len(found) == 499 and set(found.values()) == {min(7 * i % 1009 for i in range(1, 501))}


def test_one_of_each_stays(odd, none):
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 1 and 6 are copies; 2, 3 and 4 have no words; rows without an id stay.
    assert ids == sorted(["-8", "1", "2", "20", "5", "7", "None", "None"])
    assert simhash.first_of_each(none).count() == 0
    repeated = odd.where("doc_id = 6")
    assert simhash.first_of_each(repeated).count() == 1


def test_repeated_ids_lose_no_text(spark):
    one, two = "the first text of an id that is used again", "another text about harbours, ships and long winters"
    rows = [(3, one), (5, one), (5, two), (5, two), (9, two), (9, "a third text that nobody else has written so far")]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(map(tuple, kept.collect())) == [(3, one), (5, two), (9, rows[5][1])]


@pytest.mark.parametrize("equal", [2, 3])
def test_links_grow_with_the_fingerprints(equal):
    # Pairs within the radius share a tile, others hardly any: so no fingerprint is compared with all others.
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    near = values.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(values), dtype=np.uint64)
    masks = simhash.masks(3, equal)
    assert ((values[:, None] & masks) == (near[:, None] & masks)).any(axis=1).all()
    met = sum(int((n * (n - 1) // 2).sum()) for mask in masks for n in [np.unique(values & mask, return_counts=True)[1]])
    assert met < len(values) * (len(values) - 1) // 2 / 100_000


def test_a_large_tile_is_cut(spark, monkeypatch):
    # Nearly all bits are equal, so that all fingerprints are in some tiles together.
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(6)
    values = np.unique((np.uint64(0xF0F << 50) ^ (rng.integers(0, 2**22, 150, dtype=np.uint64) << np.uint64(3))))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
    label = plain_classes(list(range(len(values))), values)
    groups = {}
    for v, c in zip(values.view(np.int64).tolist(), label):
        groups.setdefault(c, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups) > 1
