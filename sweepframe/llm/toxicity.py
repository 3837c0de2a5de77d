"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled texts, toxic and not, with all their words. Document frequencies are counted
over all documents. A word's weight also grows with what its labels tell beyond chance, counted over all distinct
labelled texts; no word is left out for it. Examples lie in blocks, and for every word a block has the largest weight
in it. A query's blocks are visited by descending upper bound, until no bound is above the k-th best similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, chunks, map_arrow, sample, small, stored, text_bytes, words

#: Labelled texts in the index, half of each label.
SAMPLE_ROWS = 4_000
NEIGHBOURS = 8
#: How much a word weighs more for each factor of e in the evidence of its labels.
BOOST = 8.0
_BLOCK = 32
#: Blocks of a query that are opened first, and then together.
_FIRST = 8
_SLICES = 64


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges one after the other."""
    places = np.repeat(start - (np.cumsum(size) - size), size)
    places += np.arange(len(places))
    return places


@dataclass
class Index:
    terms: np.ndarray  # hashes, ascending
    idf: np.ndarray  # weights of the words
    unseen: float = 0.0  # weight of a word that no example holds
    ids: list[int | None] = field(default_factory=list)
    toxic: np.ndarray = None
    slope: float = 0.0
    shift: float = 0.0
    blank: float = 0.0  # score of texts without any term

    def vectors(self, tokens: np.ndarray, bounds: np.ndarray):
        """``text, term, weight`` of all terms of a run of texts.

        A text's weights have length 1 together with its words that no example holds.
        """
        if not len(self.terms) or not len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, tokens), len(self.terms) - 1)
        found = self.terms[at] == tokens
        hit = np.flatnonzero(found)
        text = np.searchsorted(bounds, hit, side="right") - 1
        cell, times = np.unique(text * len(self.terms) + at[hit], return_counts=True)
        text, term = cell // len(self.terms), cell % len(self.terms)
        weight = (1 + np.log(times)) * self.idf[term]
        squares = np.bincount(text, weight**2, len(bounds) - 1)
        other = np.flatnonzero(~found)
        if self.unseen and len(other):
            owner = np.searchsorted(bounds, other, side="right") - 1
            order = np.lexsort((tokens[other], owner))
            owner, token = owner[order], tokens[other][order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
            heads = np.flatnonzero(fresh)
            more = (1 + np.log(np.diff(np.append(heads, len(order))))) * self.unseen
            squares += np.bincount(owner[heads], more**2, len(bounds) - 1)
        return text, term, weight / np.sqrt(squares)[text]

    def load(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: list, toxic: np.ndarray) -> None:
        """Lay the examples out by their weightiest term, so that blocks are alike and bounds tight."""
        n = len(ids)
        lead = np.full(n, -1, np.int64)
        order = np.lexsort((weight, text))
        lead[text[order]] = term[order]
        layout = np.argsort(lead, kind="stable")
        layout = layout[lead[layout] >= 0]
        place = np.full(n, -1, np.int64)
        place[layout] = np.arange(len(layout))
        self.ids, self.toxic = [ids[i] for i in layout], toxic[layout].astype(np.float64)
        example = place[text]
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        self.example, self.weight = example, weight
        self.blocks = -(-len(layout) // _BLOCK)
        # A cell holds the postings of one term in one block.
        cell = term * max(1, self.blocks) + example // _BLOCK
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_block = example[heads] // _BLOCK
        self.cell_first = heads
        self.cell_size = np.diff(np.append(heads, len(cell)))
        self.cell_most = np.maximum.reduceat(weight, heads) if len(heads) else np.zeros(0)
        self.first = np.searchsorted(term[heads], np.arange(len(self.terms) + 1))

    def nearest(self, term: np.ndarray, weight: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the ``NEIGHBOURS`` most similar examples, none of similarity 0."""
        size = self.first[term + 1] - self.first[term]
        cells, given = _flat(self.first[term], size), np.repeat(weight, size)
        block = self.cell_block[cells]
        bounds = np.bincount(block, given * self.cell_most[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        sums = np.zeros(self.blocks * _BLOCK)
        least, at = 0.0, 0
        while at < len(order) and bounds[order[at]] >= least - 1e-12:
            # The best blocks alone, then all that may still hold a neighbour.
            end = _FIRST if at == 0 else len(order) - int(np.searchsorted(bounds[order][::-1], least - 1e-12))
            opened = np.zeros(self.blocks, bool)
            opened[order[at : max(end, at + 1)]] = True
            some = np.flatnonzero(opened[block])
            size = self.cell_size[cells[some]]
            postings = _flat(self.cell_first[cells[some]], size)
            sums += np.bincount(self.example[postings], np.repeat(given[some], size) * self.weight[postings], len(sums))
            if skip >= 0:
                sums[skip] = 0
            at = max(end, at + 1)
            if np.count_nonzero(sums) >= NEIGHBOURS:
                least = np.partition(sums, len(sums) - NEIGHBOURS)[len(sums) - NEIGHBOURS]
        found = np.flatnonzero(sums > 0)
        found = found[sums[found] >= least]
        found = found[np.lexsort((found, -sums[found]))[:NEIGHBOURS]]
        return found, sums[found]

    def vote(self, places: np.ndarray, values: np.ndarray) -> float:
        """Similarities of toxic neighbours less those of others, over the number of neighbours asked for."""
        return float((values * (2 * self.toxic[places] - 1)).sum() / NEIGHBOURS)

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30))))


def _term_counts(terms: np.ndarray, labels: int):
    """How many texts hold each term, for each of ``labels`` labels: a task's counts in slices of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((labels, len(terms)), np.int64)
        for batch in chunks(batches, "content"):
            tokens, bounds = words(*binary(batch.column("content")), letters=True)
            label = batch.column("label").to_numpy()
            at = np.minimum(np.searchsorted(terms, tokens), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == tokens)
            text = np.searchsorted(bounds, hit, side="right") - 1
            cell = np.unique(text * len(terms) + at[hit])
            np.add.at(total, (label[cell // len(terms)], cell % len(terms)), 1)
        parts = np.array_split(np.ascontiguousarray(total.T), _SLICES)
        group = TaskContext.get().partitionId() % 64
        columns = [pa.array(range(_SLICES), pa.int32()), pa.array([group] * _SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "part", "counts"])

    return run


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = table["counts"].to_pylist()
    total = np.zeros(len(rows[0]) // 8, np.int64)
    for row in rows:
        total += np.frombuffer(row, np.int64)
    part = key[1].as_py() if len(key) > 1 else 0
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _counted(texts: DataFrame, terms: np.ndarray, labels: int = 1) -> np.ndarray:
    """``(terms, labels)`` counts of the texts (``content, label``); tasks' counts are added up in two steps."""
    schema = "slice int, part int, counts binary"
    counted = map_arrow(texts, _term_counts(terms, labels), schema)
    summed = counted.groupBy("slice", "part").applyInArrow(_added, schema).groupBy("slice").applyInArrow(_added, schema)
    rows = sorted((r["slice"], bytes(r["counts"])) for r in summed.collect())
    return np.frombuffer(b"".join(c for _, c in rows), np.int64).reshape(-1, labels) if rows else np.zeros((len(terms), labels), np.int64)


def _evidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a word's labels tell for toxic beyond chance: Chernoff's exponent less what the best of all words has by chance."""
    total = counts.sum(axis=1)
    if not sizes.all():
        return np.zeros(len(total))
    share = sizes[1] / sizes.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = counts[:, 1] / total
        spread = rate * np.log(rate / share) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0)
    evidence = np.where((total > 0) & (rate > share), total * np.nan_to_num(spread), 0)
    return np.maximum(0, evidence - np.log(max(2, (total >= 2).sum())))


def build(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Index:
    """Index about ``rows`` labelled texts. ``labels(doc_id, toxic)`` holds the rows to learn from.

    An id with several labels counts as toxic if one says so; of several texts under an id the least is taken. Equal texts
    count as one example, toxic if one of them is.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("doc_id"), text_bytes(text).alias("content"))
    digests = texts.where("doc_id is not null").select("doc_id", F.md5("content").alias("digest"))
    distinct = digests.join(small(stored(marked, "labels")), "doc_id").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    distinct = stored(distinct, "labelled")
    chosen = distinct.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(sample(chosen, rows, "toxic"))  # of bounded size
    found = texts.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("content").alias("content")).collect()
    found.sort(key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] for r in found], np.float64)
    runs = []
    for row in found:
        data = np.frombuffer(bytes(row["content"]), np.uint8)
        tokens, _ = words(data, np.array([0, len(data)]), letters=True)
        runs.append(tokens)
    flat = np.concatenate([*runs, np.zeros(0, np.uint64)])
    terms = np.unique(flat)
    index = Index(terms, np.zeros(len(terms)))
    if len(terms):
        counts = _counted(texts.select("content", F.lit(0).alias("label")), terms)[:, 0]
        learnt = texts.join(small(chosen), "doc_id").select("content", F.col("toxic").cast("int").alias("label"))
        sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
        evidence = _evidence(_counted(learnt, terms, 2), np.array([sizes.get(0, 0), sizes.get(1, 0)]))
        n = docs.count()
        index.idf = (np.log((1 + n) / (1 + counts)) + 1e-3) * (1 + BOOST * np.log1p(evidence))
        index.unseen = float(np.log((1 + n) / 2) + 1e-3)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
    text_no, term, weight = index.vectors(flat, bounds)
    index.load(text_no, term, weight, [r["doc_id"] for r in found], toxic)
    rates = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    _calibrate(index, flat, bounds, toxic, rates, {r["doc_id"]: i for i, r in enumerate(found)})
    return index


def _calibrate(index: Index, flat, bounds, toxic, rates, number) -> None:
    """Fit score = logistic(slope * vote + shift) on the examples, each without itself, at the labels' true rates."""
    text, term, weight = index.vectors(flat, bounds)
    place = {number[doc]: i for i, doc in enumerate(index.ids)}
    seen = {y: max(1, int((toxic == y).sum())) for y in (0.0, 1.0)}
    worth = {y: rates.get(int(y), 0) / seen[y] for y in (0.0, 1.0)}
    votes, truth = [], []
    starts = np.searchsorted(text, np.arange(len(bounds)))
    for i in range(len(toxic)):
        a, b = starts[i], starts[i + 1]
        if a == b:
            continue
        votes.append(index.vote(*index.nearest(term[a:b], weight[a:b], place[i])))
        truth.append(toxic[i])
    x, y = np.array(votes), np.array(truth)
    w = np.array([worth[t] for t in truth])
    slope, shift = 4.0, 0.0
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        bend = w * p * (1 - p) + 1e-9
        # A mild pull to slope 4 and shift 0 keeps separable examples finite.
        g = np.array([(w * (p - y) * x).sum() + 0.05 * (slope - 4), (w * (p - y)).sum() + 0.05 * shift])
        h = np.array([[(bend * x * x).sum() + 0.05, (bend * x).sum()], [(bend * x).sum(), bend.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -5, 5), shift - np.clip(step[1], -5, 5)
    index.slope, index.shift = float(slope), float(shift)
    # A text that shares no word with any example has a vote of 0.
    index.blank = index.score(0.0) if len(x) else 0.0


def _score(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in chunks(batches, "content"):
            tokens, bounds = words(*binary(batch.column("content")), letters=True)
            text, term, weight = index.vectors(tokens, bounds)
            starts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            scores, evidence = [index.blank] * batch.num_rows, [[]] * batch.num_rows
            for i in np.unique(text).tolist():
                a, b = starts[i], starts[i + 1]
                places, values = index.nearest(term[a:b], weight[a:b])
                scores[i] = index.score(index.vote(places, values))
                near = zip(places.tolist(), values.tolist())
                evidence[i] = [{"doc_id": index.ids[p], "similarity": v, "toxic": int(index.toxic[p])} for p, v in near]
            score = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, kind)],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return run


def toxicity(docs: DataFrame, index: Index, held_out, text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every row; evidence lists the neighbours that voted.

    Texts without a word of any example (null and empty ones too) get the score of a vote of 0 and no evidence. Every repeated row has its result; null ids stay null; an empty table gives no rows; without
    labels all scores are 0; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes(text).alias("content"))
    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, toxic: int>>"
    return map_arrow(rows, _score(index), schema)
