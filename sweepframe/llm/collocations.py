"""Phrases whose words belong together, counted with one FM-index per shard of the corpus.

A shard is a run of texts of some two million words. Its words are numbered, pieces are parted by the symbol 0, and
two Burrows-Wheeler transforms, of the symbols and of their reversal, are stored with the shard's words. Their rows
are ordered by as many symbols as an interval can have, which is all that phrases of limited length need.

An n-gram is an interval in both transforms. Extending all intervals of a level to the right is one pass over the
reversed transform in the order of its LF mapping, extending to the left one over the other. An extended n-gram is
kept only where both passes reach it, that is, where the n-grams without its last and without its first word were
both frequent in the whole corpus. Counts are summed across shards level by level: every shard deals its distinct
n-grams, packed, to buckets by a hash; a bucket sums them and tells each shard by one bit which of them are frequent.
Words, the first level, are summed by their text, and shards are told the numbers of those that are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import binary, chunks, lowered, map_arrow, mixed, released_group, small, stored, text_bytes
from .spans import byte_set, pack, runs, sections, stable_order, unpack

#: Words of a shard. A text that is longer is cut between pieces.
SHARD_WORDS = 1 << 21
#: Occurrences that one bucket of n-grams may stand for; it holds fewer, as a shard sends each n-gram once.
BUCKET_ITEMS = 1 << 22
#: Words of all shards that one bucket sums.
BUCKET_WORDS = 1 << 18
_BREAK = byte_set(*b".,;:!?", range(0x0A, 0x0E))
_WORD = ~(_BREAK | byte_set(0x20, 0x09))

_INDEX = "shard long, bwt binary, reverse binary, hashes binary, words array<string>, langs array<string>, counts array<long>"
_WORDS = "bucket int, shard long, words array<string>, langs array<string>, counts array<long>"
_TOLD = "shard long, bucket int, flags binary, words array<string>, langs array<string>, totals array<long>, all_langs array<string>, all_totals array<long>"
_ITEMS = "level int, bucket int, shard long, ids binary, counts binary"
_REPLY = "shard long, level int, bucket int, flags binary, ids binary, totals binary"


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform under the order of the first ``depth`` symbols, equal ones by place."""
    n = len(symbols)
    wrapped = np.concatenate([symbols, np.resize(symbols, depth)]) if n else symbols
    order = np.arange(n, dtype=np.int32)
    for d in range(depth - 1, -1, -1):
        order = order[stable_order(wrapped[d:][order])]
    return symbols[order - 1].astype(np.int32, copy=False) if n else np.zeros(0, np.int32)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in ascending order, the first place of each, every hash's number among them, and their counts."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    in_order = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = in_order[1:] != in_order[:-1]
    heads = np.flatnonzero(fresh)
    number = np.empty(len(hashes), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return in_order[heads], order[heads], number, np.diff(np.append(heads, len(hashes)))


@dataclass
class Intervals:
    """N-grams of one length: their intervals in both transforms, and their words' numbers in the corpus."""

    low: np.ndarray
    reverse_low: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    def where(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.low[keep], self.reverse_low[keep], self.size[keep], self.ids[keep])


class FMIndex:
    """The two transforms of one shard; ``numbers`` gives the corpus' number of a symbol, -1 for those to be passed over.

    Places in a shard and numbers take 32 bits, so that its n-grams fit beside those of another task.
    """

    def __init__(self, bwt: np.ndarray, reverse: np.ndarray, numbers: np.ndarray):
        self.numbers = numbers
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=len(numbers)))])
        # Row j of the sorted first column stands at order[j] in the transform: the LF mapping, inverted.
        self.order, self.reverse_order = stable_order(bwt).astype(np.int32), stable_order(reverse).astype(np.int32)
        self.sorted = bwt[self.order]

    def words(self) -> Intervals:
        symbols = np.flatnonzero(self.numbers >= 0)
        low = self.first[symbols].astype(np.int32)
        return Intervals(low, low, (self.first[symbols + 1] - low).astype(np.int32), self.numbers[symbols][:, None].astype(np.int32))

    def _step(self, low: np.ndarray, size: np.ndarray, order: np.ndarray):
        """One symbol further from each interval: ``from, symbol, low, size`` by symbol and place."""
        owner = np.full(len(order), -1, np.int32)
        places = np.repeat((low - (np.cumsum(size) - size)).astype(np.int32), size)
        places += np.arange(len(places), dtype=np.int32)
        owner[places] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        del places
        owner = owner[order]
        at = np.flatnonzero(owner >= 0).astype(np.int32)
        owner, symbol = owner[at], self.sorted[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        heads = np.flatnonzero(fresh)
        return owner[heads], symbol[heads], at[heads], np.diff(np.append(heads, len(at))).astype(np.int32)

    def extend(self, grams: Intervals) -> Intervals:
        """All n-grams of one word more whose parts without the last and without the first word are in ``grams``."""
        owner, symbol, reverse_low, size = self._step(grams.reverse_low, grams.size, self.reverse_order)
        # In the other transform an extension lies behind those by smaller symbols.
        by = stable_order(owner)
        before = np.cumsum(size[by]) - size[by]
        heads = np.flatnonzero(np.diff(owner[by], prepend=-1))
        before -= np.repeat(before[heads], np.diff(np.append(heads, len(by))))
        low = np.empty(len(owner), np.int32)
        low[by] = grams.low[owner[by]] + before
        del by, before, heads
        reached = np.zeros(len(self.order) + 1, bool)
        reached[self._step(grams.low, grams.size, self.order)[2]] = True
        keep = reached[low]
        owner, symbol = owner[keep], symbol[keep]
        ids = np.empty((len(owner), grams.ids.shape[1] + 1), np.int32)
        ids[:, :-1], ids[:, -1] = grams.ids[owner], self.numbers[symbol]
        return Intervals(low[keep], reverse_low[keep], size[keep], ids)


class _Shard:
    """Texts of a shard under construction."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.words = self.bytes = 0

    def add(self, low: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: np.ndarray) -> None:
        start, stop, hashes = runs(low, offsets, _WORD)
        text = np.searchsorted(offsets, start, side="right") - 1
        breaks = np.cumsum(_BREAK[low])[start] if len(start) else start
        fresh = np.ones(len(start), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1])
        lang = langs[text]
        # The same in every shard, so that words can be dealt by it.
        symbols = mixed(hashes ^ names[lang])
        self.parts.append((low, (start + self.bytes).astype(np.int32), (stop + self.bytes).astype(np.int32), symbols, lang, fresh))
        self.words += len(start)
        self.bytes += len(low)

    def row(self, number: int, names: list[str], depth: int) -> pa.RecordBatch:
        # Each column of the parts goes as soon as it is whole, and what is only for the words before the transforms.
        columns = [list(x) for x in zip(*self.parts)]
        self.parts = []
        low, start, stop, hashes, lang, fresh = (np.concatenate(columns.pop(0)) for _ in range(6))
        found, at, symbol, counts = distinct(hashes)
        del hashes
        start, stop, lang = start[at].tolist(), stop[at].tolist(), lang[at].tolist()
        words = [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start, stop)]
        del low, start, stop, at
        top = (found >> np.uint64(32)).astype(np.uint32)
        symbols = np.zeros(len(symbol) + int(fresh.sum()) + 1, np.int32)
        places = np.cumsum(fresh, dtype=np.int32)
        places += np.arange(len(places), dtype=np.int32)
        symbols[places] = symbol + 1
        del fresh, places, symbol, found
        row = [number, pack(transform(symbols, depth)), pack(transform(symbols[::-1], depth)), pack(np.diff(top, prepend=np.uint32(0))), words, [names[i] for i in lang], counts.tolist()]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["shard", "bwt", "reverse", "hashes", "words", "langs", "counts"])


def _index(depth: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        codes: dict[str, int] = {}
        shard = _Shard()
        for batch in chunks(batches, "content"):
            langs = np.array([codes.setdefault(x, len(codes)) for x in batch.column("lang").to_pylist()], np.int32)
            names = np.array([xxhash.xxh64_intdigest(x) for x in codes], np.uint64)
            data, offsets = binary(batch.column("content"))
            for low, offsets in sections(lowered(data, False), offsets, _BREAK):
                shard.add(low, offsets, langs, names)
                if shard.words >= limit:
                    yield shard.row(number, list(codes), depth)
                    number, shard = number + 1, _Shard()
        if shard.words:
            yield shard.row(number, list(codes), depth)

    return run


def build_index(docs: DataFrame, longest: int = 5, text: str = "text", lang: str = "lang") -> DataFrame:
    """The stored shards: both transforms and the words with their languages and counts.

    Null texts are empty, a null language is ``und``; an empty table has no shards.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("content"))
    return stored(map_arrow(rows, _index(longest - 1, SHARD_WORDS), _INDEX), "phrases-index")


def _buckets(ids: np.ndarray, n: int) -> np.ndarray:
    hashes = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        hashes = mixed(hashes ^ (column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return (hashes % np.uint64(n)).astype(np.int64)


def _word_cuts(hashes: bytes, n: int) -> np.ndarray:
    """Where the words of each of ``n`` buckets begin among a shard's words, which are in the order of their hashes."""
    top = np.cumsum(unpack(hashes, np.uint32), dtype=np.uint64)
    return np.searchsorted((top * np.uint64(n)) >> np.uint64(32), np.arange(n + 1))


def _deal_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cuts = _word_cuts(batch.column("hashes")[i].as_py(), n)
                some = np.flatnonzero(np.diff(cuts))
                offsets = pa.array(np.append(cuts[some], cuts[-1]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, batch.column(name)[i].values) for name in ("words", "langs", "counts")]
                shard = pa.array(np.full(len(some), batch.column("shard")[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), shard, *lists], ["bucket", "shard", "words", "langs", "counts"])

    return run


def _sum_words(least: int):
    """Sum the words of one bucket; shards are told the place of each of their words among the frequent ones, or -1."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words, langs, counts = (table[name].combine_chunks().flatten() for name in ("words", "langs", "counts"))
        # A word holds no tab, so language and word can be told apart at the last one.
        named = pc.binary_join_element_wise(langs, words, "\t").dictionary_encode()
        same = named.indices.to_numpy()
        totals = np.zeros(len(named.dictionary), np.int64)
        np.add.at(totals, same, counts.to_numpy())
        often = np.flatnonzero(totals >= least)
        place = np.full(len(totals), -1, np.int32)
        place[often] = np.arange(len(often))
        sizes = pc.list_value_length(table["words"]).to_numpy()
        flags = [pack(x) for x in np.split(place[same], np.cumsum(sizes)[:-1])]
        first = np.zeros(len(totals), np.int64)
        first[same[::-1]] = np.arange(len(same))[::-1]
        first = pa.array(first[often])
        by_lang = pa.table({"lang": langs, "count": counts}).group_by("lang").aggregate([("count", "sum")])
        n = len(flags)
        none = [None] * n
        lists = {"words": words.take(first).to_pylist(), "langs": langs.take(first).to_pylist(), "totals": totals[often].tolist()}
        lists |= {"all_langs": by_lang["lang"].to_pylist(), "all_totals": by_lang["count_sum"].to_pylist()}
        kinds = {name: pa.list_(pa.int64() if name.endswith("totals") else pa.string()) for name in lists}
        return pa.table(
            {
                "shard": pa.array([*table["shard"].to_pylist(), None], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
                "flags": pa.array([*flags, None], pa.binary()),
            }
            | {name: pa.array([*none, values], kinds[name]) for name, values in lists.items()}
        )

    return run


def _replay(index: pa.Table, replies: pa.Table, starts: np.ndarray, plan: dict[int, int]) -> tuple[FMIndex, Intervals]:
    """The shard's index and its frequent n-grams of the last level that has been summed.

    ``starts`` has the number of the first frequent word of each bucket, ``plan`` the buckets of the other levels.
    """
    row = index.to_pylist()[0]
    cuts = _word_cuts(row["hashes"], len(starts))
    numbers = np.full(cuts[-1] + 1, -1, np.int32)
    told: dict[int, dict[int, bytes]] = {}
    for reply in replies.to_pylist():
        told.setdefault(reply["level"], {})[reply["bucket"]] = reply["flags"]
    for bucket, flags in told.get(1, {}).items():
        place = unpack(flags, np.int32).astype(np.int64)
        numbers[1 + cuts[bucket] : 1 + cuts[bucket + 1]] = np.where(place < 0, -1, place + starts[bucket])
    fm = FMIndex(unpack(row["bwt"], np.int32), unpack(row["reverse"], np.int32), numbers)
    grams = fm.words()
    for level in sorted(plan):
        grams = fm.extend(grams)
        buckets = _buckets(grams.ids, plan[level])
        keep = np.zeros(len(buckets), bool)
        for bucket, flags in told.get(level, {}).items():
            places = np.flatnonzero(buckets == bucket)
            keep[places] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(places)).astype(bool)
        grams = grams.where(keep)
    return fm, grams


def _count(starts: np.ndarray, plan: dict[int, int], levels: list[int], n: int):
    """Deal a shard's n-grams of ``levels`` to ``n`` buckets each; ``plan`` has the buckets of earlier levels."""

    def run(index: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in ("level", "bucket", "shard", "ids", "counts")}
        if index.num_rows and replies.num_rows:
            fm, grams = _replay(index, replies, starts, plan)
            for level in levels:
                grams = fm.extend(grams)
                buckets = _buckets(grams.ids, n)
                order = stable_order(buckets)
                cuts = np.searchsorted(buckets[order], np.arange(n + 1))
                for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        some = order[a:b]
                        values = (level, bucket, index["shard"][0].as_py(), pack(grams.ids[some].T.ravel().astype(np.int32)), pack(grams.size[some].astype(np.int32)))
                        for to, value in zip(out.values(), values):
                            to.append(value)
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), types)})

    return run


def _sum(least: int):
    """Sum one bucket over its shards: a bit for each n-gram of each shard, and the frequent n-grams with their counts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level, bucket = key[0].as_py(), key[1].as_py()
        shards = table["shard"].to_pylist()
        parts = [unpack(x, np.int32).reshape(level, -1).T for x in table["ids"].to_pylist()]
        counts = np.concatenate([unpack(x, np.int32) for x in table["counts"].to_pylist()]).astype(np.int64)
        ids = np.concatenate(parts)
        same = ids[:, 0].astype(np.int64)
        for column in ids.T[1:]:
            _, same = np.unique((same << 32) | column, return_inverse=True)
        _, at, same = np.unique(same, return_index=True, return_inverse=True)
        totals = np.zeros(len(at), np.int64)
        np.add.at(totals, same, counts)
        often = totals >= least
        flags = np.split(often[same], np.cumsum([len(p) for p in parts])[:-1])
        n = len(shards)
        return pa.table(
            {
                "shard": pa.array([*shards, None], pa.int64()),
                "level": pa.array([level] * (n + 1), pa.int32()),
                "bucket": pa.array([bucket] * (n + 1), pa.int32()),
                "flags": pa.array([*(np.packbits(f).tobytes() for f in flags), None], pa.binary()),
                "ids": pa.array([None] * n + [pack(ids[at[often]].T.ravel())], pa.binary()),
                "totals": pa.array([None] * n + [pack(totals[often])], pa.binary()),
            }
        )

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed frequent n-grams as rows; a key is the words' numbers, four bytes each, highest first."""
    for batch in batches:
        for level, ids, totals in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a = unpack(totals, np.int64)
            key = unpack(ids, np.int32).reshape(level, -1).T.astype(">u4").tobytes()
            offsets = np.arange(len(a) + 1, dtype=np.int32) * (4 * level)
            keys = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(key)])
            yield pa.RecordBatch.from_arrays([pa.array([level] * len(a), pa.int32()), keys, pa.array(a)], ["size", "key", "a"])


def frequent_phrases(index: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, languages and phrases of an index: ``(number, lang, word, a)``, ``(lang, n)`` and ``(size, key, a)``.

    Words and phrases of 2 to ``longest`` words that occur ``least`` times or more within a language; ``n`` counts
    all words of the language.
    """
    spark = index.sparkSession
    ship_package(spark)
    entries = index.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n = max(1, -(-entries // BUCKET_WORDS))
    dealt = map_arrow(index.select("shard", "hashes", "words", "langs", "counts"), _deal_words(n), _WORDS)
    told = stored(dealt.groupBy("bucket").applyInArrow(released_group(_sum_words(least)), _TOLD), "word-sums")
    sums = told.where("shard is null")
    # One number a bucket reaches the driver.
    starts, occurrences = np.zeros(n, np.int64), 0
    sizes_of = {r[0]: (r[1], r[2]) for r in sums.select("bucket", F.size("words"), F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b)).collect()}
    total = 0
    for bucket in sorted(sizes_of):
        starts[bucket] = total
        total, occurrences = total + sizes_of[bucket][0], occurrences + sizes_of[bucket][1]
    if total >= 1 << 31:
        raise ValueError("too many frequent words to number")
    first = spark.createDataFrame([(i, int(x)) for i, x in enumerate(starts)], "bucket int, start long")
    entry = F.posexplode(F.arrays_zip("words", "langs", "totals")).alias("place", "entry")
    words = sums.select("bucket", entry).join(F.broadcast(first), "bucket")  # a row per bucket
    words = stored(words.select((F.col("start") + F.col("place")).cast("int").alias("number"), F.col("entry.langs").alias("lang"), F.col("entry.words").alias("word"), F.col("entry.totals").alias("a")), "frequent-words")
    pairs = sums.select(F.inline(F.arrays_zip("all_langs", "all_totals")))
    sizes = pairs.groupBy(F.col("all_langs").alias("lang")).agg(F.sum("all_totals").alias("n"))
    replies = told.where("shard is not null").select("shard", F.lit(1).alias("level"), "bucket", "flags")
    plan: dict[int, int] = {}
    phrases = spark.createDataFrame([], "size int, key binary, a long")
    # The last two levels are summed together: few n-grams are left, and their counts need not be told.
    steps = [[level] for level in range(2, longest - 1)] + [list(range(max(2, longest - 1), longest + 1))]
    for levels in steps:
        n = max(1, -(-occurrences // BUCKET_ITEMS))
        dealt = index.select("shard", "bwt", "reverse", "hashes").groupBy("shard").cogroup(replies.groupBy("shard"))
        items = dealt.applyInArrow(released_group(_count(starts, dict(plan), levels, n)), _ITEMS)
        summed = stored(items.groupBy("level", "bucket").applyInArrow(released_group(_sum(least)), _REPLY), "sums")
        new = stored(map_arrow(summed.where("shard is null").select("level", "ids", "totals"), _rows, "size int, key binary, a long"), "phrases")
        phrases = phrases.unionByName(new)
        replies = replies.unionByName(summed.where("shard is not null").select("shard", "level", "bucket", "flags"))
        plan[levels[0]] = n
        occurrences = new.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
        if not occurrences:
            break
    return words, sizes, phrases


#: Exact: the product of a decimal of 38 digits has 38 digits, and one that needs more stops the job.
SCORE = "cast((cast(1000 as decimal(38, 0)) * cast(a as decimal(38, 0)) * cast(n as decimal(38, 0))) div (cast(l as decimal(38, 0)) * cast(r as decimal(38, 0))) as long)"


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, absorb: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, lefts, rights``: each language's ``best`` phrases.

    A phrase has 2 to ``longest`` words and occurs ``a >= least`` times; its score is that of its weakest cut into a
    part that occurs ``l`` and one that occurs ``r`` times, ``1000 * a * n / (l * r)`` rounded down. Phrases that lie in
    a longer one with at least ``absorb`` percent of their count are left out. ``lefts`` and ``rights`` are the largest
    counts of a phrase with one word more on that side, null if none is frequent.

    Every row counts, repeated ones too; null and empty texts hold no words, a null language is ``und``; an empty
    table gives no rows; further columns are ignored.
    """
    words, sizes, phrases = frequent_phrases(build_index(docs, longest, text, lang), least, longest)
    phrases = stored(phrases, "all-phrases")
    # hex/unhex keep a number's four bytes, highest first, as in the phrases' keys.
    number = F.unhex(F.lpad(F.hex(F.col("number").cast("long")), 8, "0"))
    known = small(stored(words.select(number.alias("key"), "a").unionByName(phrases.select("key", "a")), "counted"))
    cut = phrases.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring(key, 1, 4 * k)")).withColumn("rest", F.expr("substring(key, 4 * k + 1, 4 * (size - k))"))
    cut = cut.join(known.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(known.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    named = small(stored(words.select(number.alias("word_key"), "lang", "word"), "names"))
    firsts = named.select(F.col("word_key").alias("head"), "lang").join(small(stored(sizes, "languages")), "lang")
    cut = cut.withColumn("head", F.expr("substring(key, 1, 4)")).join(firsts, "head")
    weakest = cut.groupBy("key", "a", "size", "lang", "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut"))
    # A longer phrase with enough of the count implies one that is longer by one word.
    longer = phrases.where("size > 2").select("a", F.expr("substring(key, 1, 4 * (size - 1))").alias("prefix"), F.expr("substring(key, 5, 4 * (size - 1))").alias("suffix"))
    side = longer.select(F.col("prefix").alias("key"), F.col("a").alias("rights"), F.lit(None).cast("long").alias("lefts")).unionByName(
        longer.select(F.col("suffix").alias("key"), F.lit(None).cast("long").alias("rights"), F.col("a").alias("lefts"))
    )
    around = side.groupBy("key").agg(F.max("lefts").alias("lefts"), F.max("rights").alias("rights"))
    free = weakest.join(around, "key", "left").where(100 * F.coalesce(F.greatest("lefts", "rights"), F.lit(-1)) < absorb * F.col("a"))
    free = free.select("lang", "key", "size", "a", "n", "cut.score", "cut.l", "cut.r", "lefts", "rights")
    by_count = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties at the end stay until their words are known.
    chosen = stored(free.withColumn("place", F.rank().over(by_count)).where(F.col("place") <= best).drop("place"), "chosen")
    spelled = chosen.select("key", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")).withColumn("word_key", F.expr("substring(key, 4 * i + 1, 4)"))
    spelled = spelled.join(named.select("word_key", "word"), "word_key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("parts"))
    spelled = spelled.select("key", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("phrase"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = chosen.join(spelled, "key").withColumn("rank", F.row_number().over(ranked).cast("long")).where(F.col("rank") <= best)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "lefts", "rights")
