"""Scores of texts under a bigram model whose counts live in a log-frequency Bloom filter.

A count c is quantised to 1 + floor(log2 c) levels, and an n-gram is put into the filter once per level, so its
level is found by probing 1, 2, .. until one is missing. A filter is never too low; it may be too high for a few.
The filter is cut into blocks by the n-gram's hash, so that each block is built by one group of rows. Every block
has ``BITS_EACH`` bits for each n-gram and level in it, so the rate of false levels is the same for every corpus.
Workers get the whole filter where it can not exceed ``MOST_BITS``; for larger corpora the texts are dealt to parts, each
part sends its n-grams to their blocks once, to be counted and to ask, and the levels come back, with the same results.

Words of high count are kept exactly in a small table that workers get; all other words of a text are joined with
their exact counts, or get them with the levels, so the base score is exact however large the vocabulary grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StudyError
from .common import binary, chunks, map_arrow, mixed, per_text, ship_package, stored, text_bytes, words

#: Most words of the table that workers get, with 16 bytes each.
HEAD = 1 << 18
#: Most bits of a filter that workers get whole (64 MB); where it may be larger it is asked by a shuffle.
MOST_BITS = 1 << 29
PROBES = 3
#: Bits for each n-gram and level: with three probes a level is false with probability (1 - exp(-3 / 12))^3 = 0.011.
BITS_EACH = 12
#: Strength of the unigram distribution behind the bigram counts.
PRIOR = 32.0
END = np.uint64(0xE17A1465D5A11B0C)
_UNIGRAM = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: N-grams that a task gathers before it hands them on or counts them.
_GATHER = 2 << 20
#: Bytes of the texts that ask together, about.
_PART_BYTES = 12 << 20


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a run of texts, each text followed by one end, and where each text's tokens start."""
    hashes, bounds = words(data, offsets)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def pairs(tokens: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before; the first of a text follows an end."""
    before = np.concatenate([np.array([END]), tokens[:-1]])
    return mixed(before * _PAIR + tokens)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "content"):
        found, counts = np.unique(sequence(*binary(batch.column("content")))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["h", "n"])


def _blocks(grams: np.ndarray, block_bits: int) -> np.ndarray:
    """The n-grams' blocks, the leading bits of their hashes."""
    return (grams >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(grams), np.int64)


def _cut(grams: np.ndarray, block_bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The blocks of sorted n-grams, and where each block's n-grams start and end."""
    found, first = np.unique(_blocks(grams, block_bits), return_index=True)
    cuts = [*first.tolist(), len(grams)]
    return found, list(zip(cuts, cuts[1:]))


def _steps(grams: np.ndarray) -> bytes:
    """Sorted n-grams as steps from one to the next, byte by byte, so that a shuffle's compression finds the zeros."""
    return np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_steps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _large(counts: np.ndarray) -> bytes:
    """Counts of which most are 1: the places and sizes of the others."""
    at = np.flatnonzero(counts > 1).astype("<u4")
    return at.tobytes() + counts[at].astype("<u8").tobytes()


def _from_large(data: bytes, n: int) -> np.ndarray:
    counts, m = np.ones(n, np.int64), len(data) // 12
    counts[np.frombuffer(data, "<u4", m)] = np.frombuffer(data, "<u8", m, 4 * m)
    return counts


def _packed(grams: np.ndarray, counts: np.ndarray, block_bits: int) -> pa.RecordBatch:
    """Rows ``block, grams, counts`` of sorted n-grams."""
    found, rows = _cut(grams, block_bits)
    steps, large = [_steps(grams[a:b]) for a, b in rows], [_large(counts[a:b]) for a, b in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array(found), pa.array(steps, pa.binary()), pa.array(large, pa.binary())], ["block", "grams", "counts"]
    )


def _pair_counts(block_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, "content"):
            held.append(pairs(sequence(*binary(batch.column("content")))[0]))
            size += len(held[-1])
            if size >= _GATHER:
                yield _packed(*np.unique(np.concatenate(held), return_counts=True), block_bits)
                held, size = [], 0
        if size:
            yield _packed(*np.unique(np.concatenate(held), return_counts=True), block_bits)

    return run


def _single_counts(block_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams = mixed(batch.column("h").to_numpy().view(np.uint64) ^ _UNIGRAM)
                order = np.argsort(grams)
                yield _packed(grams[order], batch.column("n").to_numpy()[order], block_bits)

    return run


def _places(grams: np.ndarray, level: int, probe: int, bits: int | np.ndarray) -> np.ndarray:
    """Places below ``bits``, which is below 2^32."""
    seed = np.uint64((level * PROBES + probe + 1) * int(_PAIR) & (2**64 - 1))
    half = np.uint64(32)
    return ((mixed(grams ^ seed) >> half) * np.asarray(bits, np.uint64) >> half).astype(np.int64)


def _totals(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, the sums of their counts, and which of them each of ``grams`` is."""
    found, place = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64), place


def _field(grams: np.ndarray, total: np.ndarray, bits: int | None = None) -> np.ndarray:
    """A block's bits, as bytes, from all its n-grams and their counts, ``BITS_EACH`` for each level of each if ``bits`` is not given."""
    top = np.frexp(total.astype(np.float64))[1]
    size = bits or max(64, -(-BITS_EACH * int(top.sum()) // 8) * 8)
    field = np.zeros(size, bool)
    for level in range(1, int(top.max()) + 1):
        some = grams[top >= level]
        for probe in range(PROBES):
            field[_places(some, level, probe, size)] = True
    return np.packbits(field, bitorder="little")


def _build(bits: int | None = None):
    """One block's bits from all its n-grams."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = [_from_steps(part) for part in table["grams"].to_pylist()]
        counts = [_from_large(large, len(new)) for large, new in zip(table["counts"].to_pylist(), grams)]
        field = _field(*_totals(grams, counts)[:2], bits)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": [field.tobytes()]})

    return run


class Filter:
    """The quantised counts of all n-grams, a flat array of bits; blocks are of one size if ``starts`` is not given."""

    def __init__(self, bits: np.ndarray, block_bits: int, starts: np.ndarray | None = None):
        self.bits, self.block_bits = bits, block_bits
        self.starts = np.arange((1 << block_bits) + 1) * (len(bits) * 8 >> block_bits) if starts is None else starts

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Each n-gram's highest level, 0 if it is in none."""
        out = np.zeros(len(grams), np.uint8)
        block = _blocks(grams, self.block_bits)
        base = self.starts[block]
        size = self.starts[block + 1] - base
        # Nothing is in a block without bits.
        alive = np.flatnonzero(size)
        level = 1
        while len(alive) and level < 64:
            for probe in range(PROBES):
                at = base[alive] + _places(grams[alive], level, probe, size[alive])
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = level
            level += 1
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        return middles(self.levels(grams))


def middles(levels: np.ndarray) -> np.ndarray:
    """About the middle of the counts of each level, 0 for none."""
    return np.where(levels > 1, 1.4, 1.0) * np.where(levels > 0, np.exp2(levels - 1.0), 0.0)


class Model:
    """What scoring needs: totals, exact counts of frequent words, the filter's bits and starts (broadcast, or None)."""

    def __init__(self, total: int, distinct: int, head: np.ndarray, head_counts: np.ndarray, shared, block_bits: int):
        self.total, self.distinct = total, distinct
        self.head, self.head_counts = head, head_counts
        self.shared, self.block_bits = shared, block_bits
        self.even = 1.0 / (total + distinct + 1)

    def frequent(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are frequent words, and their exact counts, 0.0 for the others."""
        if not len(self.head):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens))
        at = np.minimum(np.searchsorted(self.head, tokens), len(self.head) - 1)
        known = self.head[at] == tokens
        return known, np.where(known, self.head_counts[at], 0).astype(np.float64)

    def chances(self, count: np.ndarray, both: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The model's log10 probability of every token, from the filter's counts of tokens and of their pairs."""
        ends = count[bounds[1:] - 1][:1] if len(bounds) > 1 else np.zeros(1)
        before = np.concatenate([ends, count[:-1]])
        both = np.minimum(both, np.minimum(before, count))
        return np.log10((both + PRIOR * (count + 1) * self.even) / (before + PRIOR))

    def score(self, data: np.ndarray, offsets: np.ndarray, counts):
        """Per text: tokens, frequent ones, their base score, the model's log10 probability; hashes of the others.

        ``counts`` gives the filter's counts of n-grams.
        """
        tokens, bounds = sequence(data, offsets)
        known, count = self.frequent(tokens)
        base = np.where(known, np.log10((count + 1) * self.even), 0.0)
        rare = np.flatnonzero(~known)
        count[rare] = counts(mixed(tokens[rare] ^ _UNIGRAM))
        score = per_text(self.chances(count, counts(pairs(tokens)), bounds), bounds)
        return np.diff(bounds), per_text(known, bounds).astype(np.int64), per_text(base, bounds), score, tokens, ~known, bounds


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """Count all of ``docs``; the model, with a filter where that is surely small, and the stored exact word counts ``h, n``."""
    spark = docs.sparkSession
    content = docs.select(text_bytes(text).alias("content"))
    counted = map_arrow(content, _word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    # A histogram of eighths of powers of two is small at any size; it gives the least count of a frequent word.
    step = F.floor(F.log2("n") * 8)
    sizes = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    total, distinct = sum(r["tokens"] for r in sizes), sum(r["words"] for r in sizes)
    least, room = math.inf, HEAD
    for row in sorted(sizes, key=lambda r: -r["step"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["step"]
    frequent = counted.where(step >= least).toArrow() if least < math.inf else None
    head = frequent["h"].to_numpy().view(np.uint64) if frequent else np.zeros(0, np.uint64)
    order = np.argsort(head)
    head_counts = frequent["n"].to_numpy()[order] if frequent else np.zeros(0, np.int64)
    # About half a million n-grams to build a block from.
    block_bits = max(4, (total >> 19).bit_length())
    model = Model(total, distinct, head[order], head_counts, None, block_bits)
    # A token is in two n-grams, and an n-gram has no more levels than it has occurrences.
    if 2 * total * BITS_EACH <= MOST_BITS:
        ship_package(spark)
        grams = map_arrow(content, _pair_counts(block_bits), "block long, grams binary, counts binary")
        rare = counted.where(step < least) if least < math.inf else counted
        grams = grams.union(map_arrow(rare, _single_counts(block_bits), "block long, grams binary, counts binary"))
        built = stored(grams.groupBy("block").applyInArrow(_build(), "block long, bits binary"), "filter")
        parts = {row["block"]: np.frombuffer(row["bits"], np.uint8) for row in built.toLocalIterator()}
        starts = np.cumsum([0, *(8 * len(parts.get(block, b"")) for block in range(1 << block_bits))])
        field = np.concatenate([np.zeros(0, np.uint8), *(parts[block] for block in sorted(parts))])
        model.shared = spark.sparkContext.broadcast((field, starts))
    return model, counted


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, frequent long, base double, score double, rare array<long>"


def _scored(model: Model, batch: pa.RecordBatch, rows: pa.Array, counts) -> pa.RecordBatch:
    n, frequent, base, score, tokens, rare, bounds = model.score(*binary(batch.column("content")), counts)
    others = per_text(rare, bounds).astype(np.int64)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32)), pa.array(tokens[rare].view(np.int64))
    )
    return pa.RecordBatch.from_arrays(
        [rows, batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(frequent), pa.array(base), pa.array(score), lists],
        ["row", "doc_id", "held_out", "n_tokens", "frequent", "base", "score", "rare"],
    )


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        field, starts = model.shared.value
        store = Filter(field, model.block_bits, starts)
        for batch in chunks(batches, "content"):
            ids = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield _scored(model, batch, ids, store.counts)

    return run


def _counted(held: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, of runs that are counted already or not."""
    if len(held) and held[0][1] is not None:
        return _totals([x for x, _ in held], [np.ones(len(x), np.int64) if n is None else n for x, n in held])[:2]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in held)]), return_counts=True)


_ASKED = "part long, learned boolean, block long, grams binary, counts binary, words binary, times binary"


def _ask(model: Model):
    """What the texts of a part, which stand together, hold of each block: pairs and rarer words, and how often."""

    def packed(part: int, learned: bool, both: list, single: list) -> pa.RecordBatch:
        (grams, counts), (rare, times) = _counted(both), _counted(single)
        blocks = np.unique(np.concatenate([_blocks(x, model.block_bits) for x in (grams, rare)]))
        columns = [pa.array(np.full(len(blocks), part)), pa.array(np.full(len(blocks), learned)), pa.array(blocks)]
        for found, n in ((grams, counts), (rare, times)):
            own = _blocks(found, model.block_bits)
            cuts = list(zip(np.searchsorted(own, blocks).tolist(), np.searchsorted(own, blocks, side="right").tolist()))
            columns.append(pa.array([_steps(found[a:b]) for a, b in cuts], pa.binary()))
            columns.append(pa.array([_large(n[a:b]) if learned else b"" for a, b in cuts], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["part", "learned", "block", "grams", "counts", "words", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, learned, held, waiting = None, False, ([], []), 0
        for batch in chunks(batches, "content"):
            numbers = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if part is not None and numbers[a] != part:
                    yield packed(part, learned, *held)
                    held, waiting = ([], []), 0
                part, learned = int(numbers[a]), batch.column("learned")[a].as_py()
                tokens, _ = sequence(*binary(batch.slice(a, b - a).column("content")))
                held[0].append((pairs(tokens), None))
                held[1].append((mixed(tokens[~model.frequent(tokens)[0]] ^ _UNIGRAM), None))
                waiting += len(tokens)
                # Many equal rows may fall into one part.
                if waiting >= 4 * _GATHER:
                    held, waiting = ([_counted(held[0])], [_counted(held[1])]), 0
        if part is not None:
            yield packed(part, learned, *held)

    return run


_ANSWERS = "part long, block long, levels binary, word_levels binary, word_counts binary"


def _answer(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    """A block's bits from all that was learned of it; the levels of all that is asked, and the words' exact counts."""
    learned, sides, bounds = asked["learned"].to_pylist(), [], [0]
    for name, times in (("grams", "counts"), ("words", "times")):
        grams = [_from_steps(x) for x in asked[name].to_pylist()]
        known = zip(grams, asked[times].to_pylist(), learned)
        sides.append((grams, [_from_large(n, len(x)) if own else np.zeros(len(x), np.int64) for x, n, own in known]))
        bounds += [len(x) for x in grams]
    found, total, place = _totals(sides[0][0] + sides[1][0], sides[0][1] + sides[1][1])
    some = total > 0
    # As the block stands alone, its bits are the whole field.
    store = Filter(_field(found[some], total[some]) if some.any() else np.zeros(0, np.uint8), 0)
    levels, ends = store.levels(found)[place], np.cumsum(bounds)
    cut = [levels[a:b].tobytes() for a, b in zip(ends, ends[1:])]
    _, exact, place = _totals(*sides[1])
    ends = np.cumsum([0, *map(len, sides[1][0])])
    # Byte by byte, as most counts are small.
    counts = [exact[place[a:b]].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(ends, ends[1:])]
    n = asked.num_rows
    columns = [pa.array(x, pa.binary()) for x in (cut[:n], cut[n:], counts)]
    return pa.table([asked["part"], asked["block"], *columns], ["part", "block", "levels", "word_levels", "word_counts"])


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_part(model: Model):
    def given(answers: list[bytes], grams: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        """Which answer is that of each n-gram: answers are in the order of the blocks, and of the n-grams in them."""
        found, place = np.unique(grams, return_inverse=True)
        values = np.frombuffer(b"".join(answers), kind)
        if len(values) != len(found):
            raise StudyError(f"{len(values)} answers to {len(found)} n-grams")
        return values, place

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [sequence(*binary(batch.column("content"))) for batch in chunks(iter(texts.to_batches()), "content")]
        tokens = np.concatenate([x for x, _ in parts])
        sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        answers = answers.sort_by("block")
        both, place = given(answers["levels"].to_pylist(), pairs(tokens), np.uint8)
        both = middles(both)[place]
        known, count = model.frequent(tokens)
        rare = np.flatnonzero(~known)
        exact = count.copy()
        levels, place = given(answers["word_levels"].to_pylist(), mixed(tokens[rare] ^ _UNIGRAM), np.uint8)
        count[rare] = middles(levels)[place]
        planes = [np.frombuffer(x, np.uint8).reshape(8, -1).T.tobytes() for x in answers["word_counts"].to_pylist()]
        exact[rare] = np.frombuffer(b"".join(planes), "<u8")[place]
        # Every text has a token, its end.
        summed = lambda values: np.add.reduceat(values, bounds[:-1])
        columns = [
            texts["doc_id"], texts["held_out"], sizes, summed((exact > 0).astype(np.int64)), np.full(len(sizes), model.total),
            summed(np.log10((exact + 1) * model.even)), summed(model.chances(count, both, bounds)),
        ]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _by_shuffle(rows: DataFrame, model: Model) -> DataFrame:
    """The scores of ``rows`` under a filter of any size: no task holds more than a block or a part.

    A part depends on the rows alone and is learned from as a whole or not at all. The dealt texts are read twice, to
    ask and to score.
    """
    learned = F.coalesce(~F.col("held_out"), F.lit(False))
    sizes = dict(rows.groupBy(learned).agg(F.sum(F.length("content"))).collect())
    n, others = (max(1, (sizes.get(x) or 0) // _PART_BYTES) for x in (True, False))
    place = F.xxhash64("doc_id", "content")
    part = F.when(learned, F.pmod(place, F.lit(n))).otherwise(F.pmod(place, F.lit(others)) + n)
    texts = rows.select(part.alias("part"), learned.alias("learned"), "doc_id", "held_out", "content").repartition("part")
    asked = map_arrow(texts.sortWithinPartitions("part"), _ask(model), _ASKED)
    answers = asked.groupBy("block").applyInArrow(_answer, _ANSWERS)
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score_part(model), _RESULT)


def language_model_scores(docs: DataFrame, held_out, text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows where ``held_out`` (a column) is false. Null and empty texts are a single
    end; every repeated row counts and has its result; null ids stay null; without rows to learn from all counts
    are 0 and ``base_score`` is 0; an empty table gives no rows; further columns are ignored.
    """
    model, counted = train(docs.where(~held_out), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes(text).alias("content"))
    if not model.shared:
        return _by_shuffle(rows, model)
    scored = stored(map_arrow(rows, _score(model), _SCORES), "scores")
    rare = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    even = F.lit(float(model.total + model.distinct + 1))
    exact = rare.join(counted, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / even)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"),
    )
    return scored.drop("rare").join(exact, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("frequent") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
