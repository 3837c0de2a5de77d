"""Token counts through a digest cache: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, small, stored, text_bytes
from .tokens import encoder

CACHE = "tokenizer string, digest binary, n_tokens long"


def _counts(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec)
        for batch in chunks(batches, "content"):
            ids = own.encode([x.decode("utf-8", "replace") for x in batch.column("content").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([len(x) // 4 for x in ids], pa.int64())], ["digest", "n_tokens"]
            )

    return run


def _digests(spec: str):
    """SHA-256 of the content as the tokenizer normalises it, of the raw text where it may hold special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = encoder(spec).normal
        for batch in chunks(batches, "content"):
            contents = batch.column("content").to_pylist()
            digests = [sha256(normal(x)).digest() for x in contents]
            sizes = pa.array([len(x) for x in contents], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(digests, pa.binary()), batch.column("content")], ["doc_id", "n_bytes", "digest", "content"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, digest`` of every row of ``docs``.

    ``tokenizer`` is the path of a tokenizers file, read on the driver. The digest is SHA-256 of the content that the
    tokenizer's own normaliser makes, which is all that its later steps see; texts that may hold a special token, which
    is matched before, are digested raw. ``cache`` is a Parquet folder ``(tokenizer, digest, n_tokens)``, keyed
    by the digest of the tokenizer's file too; it may be absent. One text of every digest that it lacks is encoded
    and appended, however many rows hold it.

    Null and empty texts have 0 tokens, null ids stay null, every repeated row has its own result,
    an empty table gives no rows, and further columns are ignored.
    """
    spark = docs.sparkSession
    spec = Path(tokenizer).read_text("utf-8")
    version = sha256(spec.encode()).hexdigest()
    # Columns of the result must not meet columns of the table.
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("content"))
    digested = "doc_id long, n_bytes long, digest binary, content binary"
    narrow = stored(map_arrow(plain, _digests(spec), digested).select("doc_id", "n_bytes", "digest"), "digests")
    known = _read(spark, cache, version)
    lacking = narrow.join(known, "digest", "left_anti") if known is not None else narrow
    # One row to encode for every digest, by its id; the texts move once, spread by id.
    chosen = stored(lacking.groupBy("digest").agg(F.min("doc_id").alias("chosen")), "misses")
    if not chosen.isEmpty():
        # Where an id has one row, that is the row; others are told apart by their digests, and equal ones become one.
        several = narrow.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("chosen"))
        several = small(stored(several, "several"))
        single = chosen.join(several, "chosen", "left_anti").where("chosen is not null")
        misses = plain.join(single, plain["doc_id"] == single["chosen"]).select("content", "digest")
        shared = stored(chosen.join(several, chosen["chosen"].eqNullSafe(several["chosen"]), "left_semi"), "shared")
        if not shared.isEmpty():
            shared = small(shared)
            ids = small(shared.select(F.col("chosen").alias("id")).distinct())
            some = map_arrow(plain.join(ids, plain["doc_id"].eqNullSafe(ids["id"]), "left_semi"), _digests(spec), digested)
            same = some["digest"].eqNullSafe(shared["digest"]) & some["doc_id"].eqNullSafe(shared["chosen"])
            texts = some.join(shared, same, "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
            misses = misses.unionByName(texts)
        counted = map_arrow(misses, _counts(spec), "digest binary, n_tokens long")
        fresh = counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
        fresh.write.mode("append").parquet(cache)
        known = _read(spark, cache, version)
    if known is None:
        known = spark.createDataFrame([], "digest binary, n_tokens long")
    return narrow.join(known, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest")
    )


def _read(spark, cache: str, version: str) -> DataFrame | None:
    """The cache's counts for one tokenizer, once per digest (runs side by side may add the same)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
