"""Locating values among sorted thresholds, and distributed running totals."""

from __future__ import annotations

import math
from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path

BLOCK = 2**16


def count_not_above(df: DataFrame, value: Column, sorted_values: Column, limit: int, out: str) -> DataFrame:
    """Add how many entries of a sorted array are <= ``value``.

    A binary search spelled out as one projection per halving: it stays inside
    generated code and costs log2(limit) comparisons per row. ``limit`` bounds the
    length of the array.
    """
    df = df.withColumns({"_search": value, out: F.lit(0)})
    for bit in reversed(range(max(1, limit).bit_length())):
        probe = F.get(sorted_values, F.col(out) + (2**bit - 1))
        df = df.withColumn(
            out, F.when(probe <= F.col("_search"), F.col(out) + 2**bit).otherwise(F.col(out))
        )
    return df.drop("_search")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, int | None]],
    weight: str,
    out: str,
    ties: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over the earlier rows of the same key.

    ``order`` lists the sort columns with a bound on the number of values each
    can take under one prefix of the others, or None where no bound is known.
    No window holds more rows than such a bound or about ``BLOCK``: a longer order is
    summed level by level, the totals of one level being the weights of the next.
    From the first column without a bound on, values are cut into blocks by a hashed
    sample of them, ties included, unless a key is declared to have at most ``rows``
    rows and those are few; ``df`` is stored for it. ``ties`` order what is equal in ``order``.
    """
    bounds = [bound for _, bound in order]
    if None in bounds:
        whole = rows is not None and rows <= BLOCK
    else:
        whole = math.prod(bounds) <= BLOCK
    if whole:
        return _window_total(df, keys, [*(c for c, _ in order), *ties], weight, out)

    if None in bounds:
        first = bounds.index(None)
        sorted_by = [*(c for c, _ in order[first:]), *ties]
        df, block, limit = _blocks(df, sorted_by, out)
        outer = [*order[:first], (block, limit)]
        local = _window_total(df, [*keys, *(c for c, _ in outer)], sorted_by, weight, out)
    else:
        *outer, (last, inner) = order
        block = f"{last}_block"
        if inner > BLOCK:
            df = df.withColumn(block, F.expr(f"`{last}` div {BLOCK}"))
            outer, inner = [*outer, (block, inner // BLOCK + 1)], BLOCK
        local = running_total(df, [*keys, *(c for c, _ in outer)], [(last, inner)], weight, out, ties)
    prefix = [c for c, _ in outer]
    # Read off the windowed rows, so both sides share one shuffle.
    totals = local.groupBy(*keys, *prefix).agg(F.max(F.col(out) + F.col(weight)).alias("_weight"))
    start = f"{out}_start"
    starts = running_total(totals, keys, outer, "_weight", start).drop("_weight")
    # A null key is a key like any other, in the windows and here.
    names = {c: f"{c}_{out}_start" for c in [*keys, *prefix]}
    starts = starts.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, (local[c].eqNullSafe(starts[n]) for c, n in names.items()), F.lit(True))
    joined = local.join(starts, same)
    return joined.withColumn(out, F.col(out) + F.col(start)).drop(start, block, *names.values())


def _window_total(df: DataFrame, keys: Sequence[str], sorted_by: Sequence[str], weight: str, out: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*(sorted_by or [F.lit(0)]))
    return df.withColumn(out, F.sum(weight).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))


def _blocks(df: DataFrame, sorted_by: Sequence[str], out: str) -> tuple[DataFrame, str, int]:
    """Number blocks of about ``BLOCK`` distinct values in their order; gives the column and how many there are."""
    path = fresh_path(df.sparkSession, "ordered")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    value, block = F.struct(*sorted_by), f"{out}_block"
    sampled = df.where(F.pmod(F.xxhash64(*sorted_by), F.lit(BLOCK)) == 0).select(value.alias("_v")).distinct()
    limit = sampled.count()
    bounds = sampled.agg(F.array_sort(F.collect_list("_v")).alias("_b"))
    df = count_not_above(df.withColumn("_bounds", bounds.scalar()), value, F.col("_bounds"), max(1, limit), block)
    return df.drop("_bounds"), block, limit + 1


def merged_places(values: DataFrame, value: str, thresholds: DataFrame, threshold: str, out: str, per_block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Locate values among more thresholds than one array holds, by one sorted pass over both together.

    Adds to ``values`` the place of ``value``: 2k above the k-th of the sorted distinct ``thresholds``, 2k - 1 on it.
    The second frame has every threshold with its number ``k`` in ``out``. Both are dealt by ranges whose bounds
    are a hashed sample of all values, so a range holds about ``per_block`` distinct ones, and a range is counted
    in its order. Both frames are read twice and should be stored; their values are not null.
    """
    both = values.select(F.col(value).alias("_v")).unionByName(thresholds.select(F.col(threshold).alias("_v")))
    # Equal values share a hash, so that a frequent one is one bound; their number reaches the driver, not they.
    sampled = both.where(F.pmod(F.xxhash64("_v"), F.lit(per_block)) == 0).distinct()
    bounds = sampled.agg(F.array_sort(F.collect_list("_v")).alias("_bounds"))
    limit = sampled.count()
    events = values.withColumns({"_v": F.col(value), "_is_t": F.lit(0)}).unionByName(
        thresholds.select(F.col(threshold).alias("_v"), F.lit(1).alias("_is_t")), allowMissingColumns=True
    )
    events = events.withColumn("_bounds", bounds.scalar())
    events = count_not_above(events, F.col("_v"), F.col("_bounds"), max(1, limit), "_range").drop("_bounds")
    # A threshold comes before the values that equal it.
    so_far = Window.partitionBy("_range").orderBy("_v", F.desc("_is_t")).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumns(
        {"_k": F.sum("_is_t").over(so_far), "_last": F.max(F.when(F.col("_is_t") == 1, F.col("_v"))).over(so_far)}
    )
    totals = counted.groupBy("_range").agg(F.sum("_is_t").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    counted = counted.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    number = F.col("_k") + F.col("_start")
    on_it = F.coalesce(F.col("_last") == F.col("_v"), F.lit(False))
    placed = counted.where("_is_t = 0").withColumn(out, number * 2 - on_it.cast("long")).select(*values.columns, out)
    numbered = counted.where("_is_t = 1").select(F.col("_v").alias(threshold), number.alias(out))
    return placed, numbered
