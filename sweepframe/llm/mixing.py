"""Mixing sources to target weights: a token budget handed down a tree of domains, languages and sources.

Every node's budget is shared among its children by weight. A child that cannot use its share keeps what it can
use, and the rest goes to its siblings by their weights; only when all siblings are full does it go up, where
the node's own siblings share it in the same way. A leaf's budget is filled with a prefix of its tokens: whole
epochs, and of the last epoch the documents in an order seeded by epoch and id (equal ids by their texts' digests),
the last of them in part, so that a leaf gives its budget to the token.
DataFrame and SQL functions only; all budgets are exact integers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

LEVELS = ("domain", "lang", "source")
#: Documents of a bucket of order keys, about; leaves have as many buckets as their rows need.
_BUCKET = 4096
#: Copies of one row that are written out at once.
_STEP = 1 << 16


def whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def token_count(text: Column) -> Column:
    """Words of the text, split at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """The document's place in an epoch: MD5 of seed, epoch and id, in hex, then the digest of its text."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.concat(place, tie)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return whole(out)


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: Column) -> DataFrame:
    """``leaves`` with their ``budget``; ``supply`` bounds it. ``total`` may use ``supply`` of the whole tree.

    ``weights`` maps a level to integer weights by name, 1 where a name is missing; weight 0 gets nothing.
    A node whose subtree lacks tokens is capped at its subtree's supply.
    """
    spent = leaves.agg(whole(F.coalesce(F.sum("supply"), F.lit(0))).alias("supply"))
    parents = spent.select(F.least(whole(total), F.col("supply")).alias("budget"))
    above: list[str] = []
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(whole(F.sum("supply")).alias("supply")).withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("supply", F.when(F.col("w") > 0, F.col("supply")).otherwise(whole(F.lit(0))))
        if above:
            nodes = nodes.join(parents.withColumnRenamed("budget", "b"), above)
        else:
            nodes = nodes.join(F.broadcast(parents.withColumnRenamed("budget", "b")), F.lit(True))  # one row
        # By supply per weight the full children come first; each is full if its share of what is left covers it.
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        ratio = F.when(F.col("w") > 0, F.col("supply").cast("double") / F.col("w").cast("double")).otherwise(F.lit(0.0))
        queue = siblings.orderBy(ratio, level).rowsBetween(Window.unboundedPreceding, -1)
        before = nodes.withColumns(
            {
                "used": F.coalesce(whole(F.sum("supply").over(queue)), whole(F.lit(0))),
                "passed": F.coalesce(whole(F.sum("w").over(queue)), whole(F.lit(0))),
                "weights": whole(F.sum("w").over(siblings)),
                "ratio": ratio,
            }
        )
        full = F.expr("supply * (weights - passed) <= (b - used) * w")
        marked = before.withColumn("full", full)
        kept = {c: whole(F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(siblings), F.lit(0))) for c in ("supply", "w")}
        marked = marked.withColumns({"left_b": F.col("b") - kept["supply"], "left_w": F.col("weights") - kept["w"]})
        # The others share the rest; running sums are rounded, so that the parts add up.
        running = siblings.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("upto", whole(F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(running), F.lit(0))))
        share = F.expr("cast((left_b * upto) div nullif(left_w, 0) as decimal(38,0)) - cast((left_b * (upto - w)) div nullif(left_w, 0) as decimal(38,0))")
        budget = F.when(F.col("full"), F.col("supply")).otherwise(share)
        parents = marked.select(*path, whole(budget).alias("budget"))
        above = path
    return leaves.join(parents.select(*levels, F.col("budget").cast("long").alias("budget")), list(levels))


def plan(
    rows: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    percent: int,
    epochs: int,
    seed: int,
) -> DataFrame:
    """One row per leaf: ``tokens, supply, budget, whole_epochs, rest, cut, cut_before``.

    ``rows`` holds the levels (never null), ``doc_id``, ``tie`` and ``n_tokens``. The total is ``percent`` of all tokens.
    A document of the last epoch is in the prefix if its order key is below ``cut``; of the rows at ``cut``, which have
    equal ids and texts, as many as the tokens after ``cut_before`` need. Tokens are first summed by bucket of the key,
    so that only the bucket in which a prefix ends is sorted.
    """
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")).withColumn("supply", F.col("tokens") * epochs)
    leaves = stored(leaves, "leaves")
    total = F.expr(f"(supply div {epochs}) * {percent} div 100")
    planned = budgets(leaves, levels, weights, total).withColumns(
        {"whole_epochs": F.expr("coalesce(budget div nullif(tokens, 0), 0L)"), "rest": F.expr("coalesce(budget % nullif(tokens, 0), 0L)")}
    )
    planned = stored(planned, "budgets")
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / _BUCKET) / 4)).cast("int")
    open_leaves = planned.where("rest > 0").select(*levels, "whole_epochs", "rest", digits.alias("digits"))
    keyed = rows.join(small(open_leaves), list(levels)).withColumn("key", order_key(seed, F.col("whole_epochs"), F.col("doc_id"), F.col("tie")))
    keyed = keyed.withColumn("bucket", F.expr("substring(key, 1, digits)"))
    sums = keyed.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    queue = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("n").over(queue), F.lit(0)))
    last = stored(placed.where("before < rest and before + n >= rest").select(*levels, "bucket", "before"), "buckets")
    ends = keyed.join(small(last), [*levels, "bucket"]).groupBy(*levels, "key", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy(*levels).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    cuts = ends.where("before < rest and before + n >= rest").select(*levels, F.col("key").alias("cut"), F.col("before").alias("cut_before"))
    return planned.join(cuts, list(levels), "left")


def levelled(docs: DataFrame, levels: Mapping[str, Column], text: str = "text") -> DataFrame:
    """``doc_id``, ``tie`` (the digest of the text), the levels (null as empty text) and ``n_tokens``."""
    names = [F.coalesce(column.cast("string"), F.lit("")).alias(name) for name, column in levels.items()]
    return docs.select(F.col("doc_id").alias("doc_id"), text_digest(text).alias("tie"), *names, token_count(F.col(text)).alias("n_tokens"))


def text_digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    percent: int = 60,
    epochs: int = 3,
    seed: int = 1,
    text: str = "text",
) -> DataFrame:
    """``doc_id``, the levels, ``epoch, n_tokens, taken``: each document once per epoch in which it is taken.

    A leaf gives at most ``epochs`` times its tokens, and exactly its budget. Rows of equal id follow one another by their
    texts' digests; of rows with equal id and text as many are taken as the budget needs, the last in part. Null texts
    have no tokens; null levels are nodes of their own; leaves without tokens give no rows; an empty table gives no
    rows; further columns are ignored.
    """
    names = list(levels)
    rows = stored(levelled(docs, levels, text), "tokens")
    planned = stored(plan(rows, names, weights, percent, epochs, seed), "plan")
    part = planned.select(*names, "whole_epochs", "rest", "cut", "cut_before").where("whole_epochs > 0 or cut is not null")
    joined = rows.join(small(part), names)
    key = order_key(seed, F.col("whole_epochs"), F.col("doc_id"), F.col("tie"))
    joined = joined.withColumn("key", F.when(F.col("cut").isNotNull(), key))
    last = F.when(F.col("key") < F.col("cut"), F.col("whole_epochs")).otherwise(F.col("whole_epochs") - 1)
    whole_rows = joined.withColumn("last", last).where("last >= 0").withColumn("epoch", F.explode(F.expr("sequence(0L, last)")))
    whole_rows = whole_rows.withColumn("taken", F.col("n_tokens"))
    # The rows at the cut are alike, so they are counted and written out anew: one key may have very many.
    ends = joined.where("key = cut").groupBy("doc_id", *names, "whole_epochs", "n_tokens", "rest", "cut_before").agg(F.count("*").alias("times"))
    need = F.col("rest") - F.col("cut_before")
    ends = ends.withColumn("copies", F.least("times", F.expr("(rest - cut_before + n_tokens - 1) div n_tokens")))
    ends = ends.withColumn("first", F.explode(F.expr(f"sequence(1L, copies, {_STEP}L)")))
    ends = ends.withColumn("copy", F.explode(F.expr(f"sequence(first, least(copies, first + {_STEP - 1}))")))
    ends = ends.withColumn("taken", F.least(F.col("n_tokens"), need - (F.col("copy") - 1) * F.col("n_tokens"))).withColumn("epoch", F.col("whole_epochs"))
    wanted = ["doc_id", *names, F.col("epoch").cast("int").alias("epoch"), "n_tokens", "taken"]
    return whole_rows.select(*wanted).unionByName(ends.select(*wanted))


def mixed_documents(docs: DataFrame, levels: Mapping[str, Column], weights, percent: int, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that one epoch of the mixture takes, whole and with their columns as they were.

    The last document of a leaf is taken whole, so a leaf exceeds its budget by less than one document; of rows with
    equal id and text no more are kept than that. Null texts and ids, null levels and empty tables as in :func:`mix`; columns
    of any names are kept.
    """
    names = list(levels)
    rows = stored(levelled(docs, levels), "tokens")
    planned = stored(plan(rows, names, weights, percent, 1, seed), "plan")
    keys = [f"l{i}" for i in range(len(names))]
    part = planned.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), F.col("whole_epochs").alias("whole"), "cut", (F.col("rest") - F.col("cut_before")).alias("need"))
    # All columns under names of their own, so that theirs cannot clash.
    columns = [docs[name].alias(f"c{i}") for i, name in enumerate(docs.columns)]
    marks = [F.coalesce(column.cast("string"), F.lit("")).alias(k) for k, column in zip(keys, levels.values())]
    marked = docs.select(*columns, *marks, F.col("doc_id").alias("id"), text_digest("text").alias("tie"), token_count(F.col("text")).alias("n"))
    joined = marked.join(small(part.where("whole > 0 or cut is not null")), keys)
    joined = joined.withColumn("key", order_key(seed, F.lit(0), F.col("id"), F.col("tie")))
    plain = [F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)]
    kept = joined.where("whole > 0 or key < cut").select(*plain)
    # Equal rows at a cut are numbered by the parts of a stored table, so no task numbers all of them.
    ends = stored(joined.where("whole = 0 and key = cut").drop("whole", "cut", "key"), "ends")
    place = F.monotonically_increasing_id()
    ends = ends.withColumns({"place": place, "part": F.shiftright(place, 33)})
    ends = ends.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("place")))
    sizes = ends.groupBy(*keys, "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    numbered = ends.join(starts, [*keys, "part"])
    return kept.union(numbered.where("(start + at - 1) * n < need").select(*plain))
