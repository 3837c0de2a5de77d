"""Exact top-k by inner product over an impact-ordered index, read score at a time.

Vectors become integers, ``floor(256 * x)``. An index block holds some thousand vectors. In it every dimension
is cut into levels of equal width, its impacts; a segment lists the block's vectors at one level of one dimension.
Counted from the level that is worst for the query's sign, a segment adds at least ``|q| * level * width`` to its
vectors' scores. Segments are processed by descending contribution. What is left for any vector is bounded by the
next segment of each dimension, so a vector whose sum plus that bound stays below the k-th best sum is proven out.
Processing stops when so few are left that they are cheap to score exactly, or at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship_package, stored

BLOCK = 4096
QUERY_BLOCK = 512
LEVEL_BITS = 5
_LARGEST = 1 << 26
_BATCH = 64


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: ids with integer vectors. Vectors that are null or hold null or non-finite components are left out.

    Components beyond 2^26 after scaling stop the job, as scores might not fit 64 bits.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c * 256.0))
    fits = F.forall(x, lambda c: F.abs(c * 256.0) <= float(_LARGEST))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("a vector component is too large")).cast("array<long>"))
    kept = vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("id"), checked.cast("array<int>").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of equal width from lists; shorter vectors count as ending in zeros."""
    out = np.zeros((len(column), width), np.int32)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _pack(width: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = table.combine_chunks()
        values = _matrix(pa.concat_arrays(part["v"].chunks), width)
        order = np.argsort(part["id"].to_numpy(), kind="stable")
        ids, values = part["id"].to_numpy()[order].astype(np.int64), values[order]
        times = part["times"].to_numpy()[order].astype(np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": [ids.tobytes()], "vals": [values.tobytes()], "times": [times.tobytes()]})

    return run


def packed(vectors: DataFrame, width: int, rows: int, count: int) -> DataFrame:
    """``block, ids, vals, times``: the vectors in blocks of about ``rows``, dealt by a hash of id and vector."""
    ship_package(vectors.sparkSession)
    blocks = max(1, -(-count // rows))
    # Ids may repeat without end, so the vector takes part in the hash, and a random draw cannot be repeated.
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_pack(width), "block long, ids binary, vals binary, times binary")


class Index:
    """Segments of one block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.n, self.width = values.shape
        spread = int(values.max(initial=0)) - int(values.min(initial=0))
        self.shift = max(0, spread.bit_length() - LEVEL_BITS)
        levels = values >> self.shift
        self.low, self.high = levels.min(axis=0, initial=1 << 30), levels.max(axis=0, initial=-(1 << 30))
        segments = []
        for j in range(self.width):
            order = np.argsort(levels[:, j], kind="stable").astype(np.int32)
            cuts = np.searchsorted(levels[order, j], np.arange(self.low[j], self.high[j] + 2))
            segments += [(j, self.low[j] + i, order[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        self.dimension = np.array([s[0] for s in segments], np.int64)
        self.level = np.array([s[1] for s in segments], np.int64)
        self.postings = [s[2] for s in segments]
        self.sizes = np.array([len(s[2]) for s in segments], np.int64)

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` vectors whose id is not ``own``; equal scores by ascending id."""
        others = self.ids != own
        k = min(k, int(others.sum()))
        if not k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = query.astype(np.int64)
        weight = np.abs(q)
        worst = np.where(q > 0, self.low, self.high)
        gain = (np.abs(self.level - worst[self.dimension]) << self.shift) * weight[self.dimension]
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        spare = int(weight.sum()) << self.shift  # a vector is less than one width above its level's edge
        sums = np.zeros(self.n)
        sums[~others] = -np.inf
        possible = others
        few = max(4 * k, self.n // 8)
        steps = range(0, len(order), max(_BATCH, len(order) // 12))
        for start in steps:
            some = order[start : start + steps.step]
            at = np.concatenate([self.postings[i] for i in some])
            sums += np.bincount(at, np.repeat(gain[some].astype(np.float64), self.sizes[some]), self.n)
            rest = order[start + steps.step :]
            # Of each dimension the largest contribution that is still to come.
            coming = np.zeros(self.width, np.int64)
            coming[self.dimension[rest][::-1]] = gain[rest][::-1]
            bound = int(coming.sum()) + spare
            least = np.partition(sums, self.n - k)[self.n - k]
            possible = sums + bound >= least
            if np.count_nonzero(possible) <= few:
                break
        members = np.flatnonzero(possible & others)
        scores = self.values[members].astype(np.int64) @ q
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members[best]], scores[best]


def _search(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                index = Index(ids, np.frombuffer(row["vals"], np.int32).reshape(len(ids), width))
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                queries = np.frombuffer(row["query_vals"], np.int32).reshape(len(query_ids), width)
                times = np.frombuffer(row["query_times"], np.int64)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for i, (own, query) in enumerate(zip(query_ids, queries)):
                    found, scores = index.search(query, k, own)
                    new = (np.full(len(found), own), np.full(len(found), row["part"] * QUERY_BLOCK * 4 + i), found, scores, np.full(len(found), times[i]))
                    for to, values in zip(out, new):
                        to.append(values)
                columns = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in out]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_no", "vec_id", "score", "times"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query(id)``, the ``k`` best other vectors.

    Candidates are all rows but those with the query's own id; equal scores go to the smaller id. A repeated
    query row has its result repeated, a repeated candidate takes as many ranks as it has rows. Null ids are
    neither queries nor candidates. Vectors of unequal length are compared as if padded with zeros. Every pair of
    an index block and a query block is one piece of work. Rows of equal id and vector are one query, and as
    candidates no more than ``k``, so both blocks hold a bounded number of rows however often a row is repeated.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector).where("id is not null")
    table = stored(rows.groupBy("id", "v").agg(F.count("*").alias("times")), "vectors")
    queries = table.where(is_query(F.col("id")))
    # No more than k copies of a candidate can be among the best k.
    copies = F.least("times", F.lit(k))
    n, width = table.agg(F.sum(copies), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = queries.count()
    schema = "query_id long, query_no long, vec_id long, score long, times long"
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    candidates = table.select("id", "v", "times", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("col")
    index = packed(candidates, width, BLOCK, n).drop("times")
    parts = packed(queries, width, QUERY_BLOCK, asked).select(
        F.col("block").alias("part"), F.col("ids").alias("query_ids"), F.col("vals").alias("query_vals"), F.col("times").alias("query_times")
    )
    last = max(1, -(-asked // QUERY_BLOCK)) - 1
    work = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<long>"))).join(parts, "part")
    found = map_arrow(work.repartition("block", "part"), _search(k, width), schema)
    best = Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # In two steps, as a list of all repetitions might not fit.
    step = 1 << 16
    ranked = ranked.withColumn("done", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(step).cast("long"))))
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times") - F.col("done"), F.lit(step)))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
