"""Ranked lexical search: MaxScore whose bounds are tightened by stored term-pair intersections.

A shard is a run of documents of some two million terms. Its index holds the postings of every term with their
impacts (the part of the score that no query changes), the largest impact of each term, and, for all pairs of its
most frequent terms, the pair's intersection as bits with the largest impacts of both terms and of their sum in it.

A query adds up terms by descending bound. As soon as what the remaining terms can give is less than the k-th best sum,
no document outside the sums can enter the result. That bound is where pairs help: two remaining terms together give no
more than the larger of their own maxima or what the intersection allows, which for frequent terms is far below the sum
of both. Possible members then get a bound of their own, by the bits of the pairs they lie in, and are completed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, chunks, lowered, map_arrow, stored, text_bytes
from .spans import byte_set, pack, runs, sections, unpack

#: Terms of a shard, repeats included; a shard exceeds it by one document at most.
SHARD_TERMS = 1 << 21
#: Most frequent terms of a shard whose pairs are stored.
PAIR_TERMS = 32
#: Terms of the queries that are searched in one pass over the index.
PASS_TERMS = 1 << 20
_TERM = ~byte_set(range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80))

_POSTINGS = "shard long, docs long, with_terms long, n_terms long, ids binary, nulls binary, lengths binary, terms binary, dfs binary, places binary, times binary"
_INDEX = "shard long, docs long, ids binary, nulls binary, terms binary, dfs binary, places binary, impacts binary, pair_terms binary, pair_first binary, pair_second binary, pair_sum binary, pair_bits binary"


def _postings_of(parts: list[tuple], docs: int) -> dict:
    hashes, doc = (np.concatenate(x) for x in zip(*parts))
    terms, term = np.unique(hashes, return_inverse=True)
    both = (term.astype(np.int64) << 32) | doc
    both, times = np.unique(both, return_counts=True)
    term, place = both >> 32, both & 0xFFFFFFFF
    lengths = np.bincount(doc, minlength=docs)
    return {
        "docs": docs, "with_terms": int((lengths > 0).sum()), "n_terms": len(doc), "lengths": pack(lengths.astype(np.int64)),
        "terms": pack(terms), "dfs": pack(np.bincount(term, minlength=len(terms)).astype(np.int32)),
        "places": pack(place.astype(np.int32)), "times": pack(times.astype(np.int32)),
    }


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _collect_postings(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        ids: list = []
        held = 0

        def row() -> pa.RecordBatch:
            plain = np.array([i or 0 for i in ids], np.int64)
            nulls = np.packbits(np.array([i is None for i in ids], bool)).tobytes()
            return _table([{"shard": number, "ids": pack(plain), "nulls": nulls, **_postings_of(parts, len(ids))}], _POSTINGS)

        for batch in chunks(batches, "content"):
            data, offsets = binary(batch.column("content"))
            for low, some in sections(lowered(data, False), offsets, ~_TERM):
                start, _, hashes = runs(low, some, _TERM)
                parts.append((hashes, len(ids) + np.searchsorted(some, start, side="right") - 1))
                held += len(start)
            ids += batch.column("doc_id").to_pylist()
            if held >= limit:
                yield row()
                number, parts, ids, held = number + 1, [], [], 0
        if ids:
            yield row()

    return run


def _impacts(times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def _add_impacts(n_docs: int, n_terms: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                dfs, places = unpack(row["dfs"], np.int32).astype(np.int64), unpack(row["places"], np.int32)
                lengths = unpack(row["lengths"], np.int64)
                impacts = _impacts(unpack(row["times"], np.int32).astype(np.int64), lengths[places], n_docs, max(1, n_terms))
                starts = np.concatenate([[0], np.cumsum(dfs)])
                chosen = np.argsort(-dfs, kind="stable")[:most]
                dense = np.zeros((len(chosen), row["docs"]), np.int32)
                for i, term in enumerate(chosen):
                    dense[i, places[starts[term] : starts[term + 1]]] = impacts[starts[term] : starts[term + 1]]
                firsts, seconds, sums, bits = [], [], [], []
                for i in range(1, len(chosen)):
                    # Pairs (i, j) of all j before i, in the order of triangle().
                    common = (dense[:i] > 0) & (dense[i] > 0)
                    firsts.append(np.where(common, dense[i], 0).max(axis=1, initial=0))
                    seconds.append(np.where(common, dense[:i], 0).max(axis=1, initial=0))
                    sums.append(np.where(common, dense[:i] + dense[i], 0).max(axis=1, initial=0))
                    bits.append(np.packbits(common, axis=1))
                empty = [np.zeros(0, np.int32)]
                yield _table(
                    [
                        {name: row[name] for name in ("shard", "docs", "ids", "nulls", "terms", "dfs", "places")}
                        | {"impacts": pack(impacts.astype(np.int32)), "pair_terms": pack(chosen.astype(np.int32))}
                        | {name: pack(np.concatenate(v or empty).astype(np.int32)) for name, v in (("pair_first", firsts), ("pair_second", seconds), ("pair_sum", sums))}
                        | {"pair_bits": pack(np.concatenate([b.ravel() for b in bits] or [np.zeros(0, np.uint8)]))}
                    ],
                    _INDEX,
                )

    return run


@dataclass
class Index:
    """Stored shards with the corpus' number of documents that hold terms, and of terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every row; null and empty texts have no terms, and an empty table has no shards.

    Postings are stored first, as impacts need the corpus' totals; both steps work shard by shard, without a shuffle.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("content"))
    postings = stored(map_arrow(rows, _collect_postings(SHARD_TERMS), _POSTINGS), "postings")
    n_docs, n_terms = postings.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Index(stored(map_arrow(postings, _add_impacts(n_docs, n_terms, PAIR_TERMS), _INDEX), "impacts"), n_docs, n_terms)


class Shard:
    """One shard in memory."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.ids = unpack(row["ids"], np.int64)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=self.docs).astype(bool)
        self.terms = unpack(row["terms"], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(unpack(row["dfs"], np.int32).astype(np.int64))])
        self.places = unpack(row["places"], np.int32)
        self.impacts = unpack(row["impacts"], np.int32).astype(np.int64)
        self.pair_of = {int(t): i for i, t in enumerate(unpack(row["pair_terms"], np.int32))}
        self.pair_first, self.pair_second, self.pair_sum = (unpack(row[f"pair_{x}"], np.int32).astype(np.int64) for x in ("first", "second", "sum"))
        self.pair_bits = unpack(row["pair_bits"], np.uint8).reshape(len(self.pair_sum), -1) if len(self.pair_sum) else None
        self.largest: dict[int, int] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of terms, -1 for those that the shard lacks."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def most(self, term: int) -> int:
        if term not in self.largest:
            self.largest[term] = int(self.impacts[self.starts[term] : self.starts[term + 1]].max())
        return self.largest[term]

    def joint(self, a: int, b: int, wa: int, wb: int) -> tuple[int, int] | None:
        """The most that two terms give together, and the place of their bits; None if the pair is not stored."""
        i, j = self.pair_of.get(a), self.pair_of.get(b)
        if i is None or j is None:
            return None
        if i < j:
            i, j, wa, wb = j, i, wb, wa
        at = triangle(i, j)
        x, y, both = int(self.pair_first[at]), int(self.pair_second[at]), int(self.pair_sum[at])
        # The largest of wa * u + wb * v where u <= x, v <= y and u + v <= both.
        return (wa * x + wb * min(y, both - x) if wa >= wb else wa * min(x, both - y) + wb * y), at


def triangle(i: int, j: int) -> int:
    """The place of the pair ``j < i``."""
    return i * (i - 1) // 2 + j


@dataclass
class Work:
    """What a search did, for tests."""

    postings: int = 0
    completed: int = 0


def search(shard: Shard, hashes: np.ndarray, weights: np.ndarray, k: int, floor: int = 0, pairs: bool = True, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the shard's documents that may be among the best ``k``; ``floor`` is a score that ``k`` others have.

    All documents with a score above 0 that belong to the shard's best ``k`` and reach ``floor`` are returned with
    exact scores, equal scores at the end included.
    """
    work = work or Work()
    found = shard.find(hashes)
    terms = [(int(t), int(w)) for t, w in zip(found, weights) if t >= 0 and w > 0]
    terms.sort(key=lambda x: (-x[1] * shard.most(x[0]), x[0]))
    n = len(terms)
    most = [w * shard.most(t) for t, w in terms]
    # Pairs of terms with what their bound saves, the largest saving first.
    saved = []
    for i in range(n if pairs else 0):
        for j in range(i + 1, n):
            stored_pair = shard.joint(terms[i][0], terms[j][0], terms[i][1], terms[j][1])
            if stored_pair is not None:
                bound = max(stored_pair[0], most[i], most[j])
                if bound < most[i] + most[j]:
                    saved.append((most[i] + most[j] - bound, i, j, stored_pair))
    saved.sort(key=lambda x: (-x[0], x[1], x[2]))

    def matched(i: int) -> list[tuple]:
        taken, out = set(), []
        for s in saved:
            if s[1] >= i and s[1] not in taken and s[2] not in taken:
                taken |= {s[1], s[2]}
                out.append(s)
        return out

    rest = [sum(most[i:]) - sum(s[0] for s in matched(i)) for i in range(n)] + [0]
    sums = np.zeros(shard.docs, np.int64)
    i = 0
    while i < n and not rest[i] < floor:
        a, b = shard.starts[terms[i][0]], shard.starts[terms[i][0] + 1]
        sums[shard.places[a:b]] += terms[i][1] * shard.impacts[a:b]
        work.postings += int(b - a)
        i += 1
        if shard.docs > k:
            floor = max(floor, int(np.partition(sums, shard.docs - k)[shard.docs - k]))
    members = np.flatnonzero((sums > 0) & (sums + rest[i] >= floor))
    if i < n and len(members):
        # A member outside a pair's intersection has at most one of the two terms.
        bound = np.full(len(members), rest[i])
        for s, x, y, (joint, at) in matched(i):
            inside = (shard.pair_bits[at][members >> 3] >> (7 - (members & 7))) & 1
            bound -= (most[x] + most[y] - s) - np.where(inside, joint, max(most[x], most[y]))
        members = members[sums[members] + bound >= floor]
        for j in range(i, n):
            a, b = shard.starts[terms[j][0]], shard.starts[terms[j][0] + 1]
            list_of = shard.places[a:b]
            at = np.minimum(np.searchsorted(list_of, members), b - a - 1)
            sums[members] += np.where(list_of[at] == members, terms[j][1] * shard.impacts[a:b][at], 0)
            work.completed += len(members)
            members = members[sums[members] + rest[j + 1] >= floor]
    scores = sums[members]
    if len(members) > k:
        least = np.partition(scores, len(members) - k)[len(members) - k]
        members, scores = members[scores >= least], scores[scores >= least]
    return members, scores


def _best(ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, nulls, -scores))[:k]


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = {number: none for number, _, _ in items}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                for number, hashes, weights in items:
                    ids, nulls, scores = best[number]
                    floor = int(scores[-1]) if len(scores) == k else 0
                    members, new = search(shard, hashes, weights, k, floor)
                    if len(members):
                        ids, nulls, scores = np.append(ids, shard.ids[members]), np.append(nulls, shard.nulls[members]), np.append(scores, new)
                        order = _best(ids, nulls, scores, k)
                        best[number] = ids[order], nulls[order], scores[order]
        for number, (ids, nulls, scores) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids, mask=nulls), pa.array(scores)], ["item_no", "doc_id", "score"])

    return run


def _frequencies(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for terms, dfs in zip(batch.column("terms"), batch.column("dfs")):
                terms, dfs = unpack(terms.as_py(), np.uint64), unpack(dfs.as_py(), np.int32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    total += np.where(terms[at] == hashes, dfs[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "content"):
        low, offsets = binary(batch.column("content"))
        start, _, hashes = runs(lowered(low, False), offsets, _TERM)
        owner = np.searchsorted(offsets, start, side="right") - 1
        terms = [np.unique(hashes[owner == i]).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.binary())], ["item_id", "terms"])


def _passes(rows: Iterator) -> Iterator[list[tuple[int, object, np.ndarray]]]:
    held, size = [], 0
    for number, row in enumerate(rows):
        terms = np.frombuffer(bytes(row["terms"]), np.uint64)
        held.append((number, row["item_id"], terms))
        size += len(terms) + 1
        if size >= PASS_TERMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked(index: Index, items: DataFrame, k: int = 50, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` its ``k`` best documents with a score above 0.

    Equal scores go to the smaller id, null ids last; every repeated document takes a rank, every repeated item has its
    own ranking; items without terms have none; empty tables give no rows; further columns are ignored. The queries are
    the small side: they go to the index in passes of ``PASS_TERMS`` terms. A task keeps ``k`` documents an item
    over all its shards, so later shards start from the bound that earlier ones proved.
    """
    spark = items.sparkSession
    plain = items.select(F.col(key).cast("long").alias("item_id"), text_bytes(text).alias("content"))
    asked = stored(map_arrow(plain, _item_terms, "item_id long, terms binary"), "items")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for held in _passes(asked.toLocalIterator()):
        hashes = np.unique(np.concatenate([terms for _, _, terms in held]))
        counted = map_arrow(index.shards.select("terms", "dfs"), _frequencies(hashes), "term long, df long")
        df = np.zeros(len(hashes), np.int64)
        for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row["term"]] = row["df"]
        weights = weights_of(df, index.n_docs)
        known = [(number, terms, weights[np.searchsorted(hashes, terms)]) for number, _, terms in held]
        found = map_arrow(index.shards, _search(known, k), "item_no long, doc_id long, score long")
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(number, item) for number, item, _ in held], "item_no long, item_id long")
        best = best.join(F.broadcast(names), "item_no")  # at most PASS_TERMS rows
        out = out.unionByName(stored(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    return out
