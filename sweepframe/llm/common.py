"""What the operators of this package share: stored tables, folds, samples and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, ship_package

#: Most rows that are sent to every worker; larger sides are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``limit`` rows; it is stored first, so counting is cheap."""
    return F.broadcast(df) if df.count() <= limit else df


def _give_back() -> None:
    """Return memory that this worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _released(function):
    """``function``, with freed memory given back before and after: workers live on while other stages run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from function(batches)
        _give_back()

    return run


def released_group(function):
    """The same for a function of a key and a table, or of two tables, as ``applyInArrow`` takes them."""

    def run(one, two):
        _give_back()
        out = function(one, two)
        _give_back()
        return out

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package present on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_released(function), schema)


def sample(df: DataFrame, limit: int, by: str) -> DataFrame:
    """About ``limit`` rows, evenly from the values of ``by``, chosen by a hash of the whole row.

    The rate of every value comes from its count, so the size of the sample does not grow with the
    table. Only for fitting; never for what is counted or returned.
    """
    counts = {row[0]: row[1] for row in df.groupBy(by).count().collect()}
    if not counts:
        return df
    share = limit / len(counts)
    place = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(share / n)).otherwise(rate)
    return df.where(place < rate)


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow column without nulls, without copying."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``size`` bytes in ``column`` (or one row)."""
    for batch in batches:
        _, offsets = binary(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered(data: np.ndarray, accents: bool) -> np.ndarray:
    """A-Z in lower case; with ``accents`` the capitals of U+00C0 to U+00DE as well."""
    low = _LOWER[data]
    if accents and len(low) > 1:
        lead = low[:-1] == 0xC3
        tail = low[1:]
        tail[lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return low


def words(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of texts, and where each text's words start.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; with ``letters`` they are runs of ASCII
    letters and bytes beyond ASCII, accented capitals in lower case too. The hash is a polynomial over
    the bytes, so it depends on the word alone. The second array has one entry more than there are texts.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = lowered(data, letters)
    inside = _LETTER[low] if letters else ~_SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    stop = np.flatnonzero(ends) + 1
    n = len(low)
    powers = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
    hashes = mixed((sums[stop] - sums[start]) * inverse[start])
    return hashes, np.searchsorted(start, offsets)


def word_hash(word: str, letters: bool = False) -> int:
    """The hash that :func:`words` gives a single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]), letters)[0][0])


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's part, 0.0 where it is empty."""
    sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
