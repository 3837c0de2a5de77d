"""Language of a text: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are the byte 3- and 4-grams of the text in lower case, everything but letters taken as one space.
As the mean of embeddings times a matrix is the mean of the products, a trained model is a table of scores by
hash bucket, which is what workers get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, chunks, lowered, map_arrow, mixed, sample, text_bytes
from .common import _LETTER as LETTER

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Rows that a model is fitted on, evenly from the languages.
SAMPLE_ROWS = 2_400
EPOCHS = 4
#: Bytes of text that are scored at once; what is held meanwhile takes some 100 times as much.
SCORED_BYTES = 1 << 17
UNKNOWN = "und"


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of a run of texts, and where each text's begin; none reaches the next text's letters."""
    low = lowered(data, accents=True)
    inside = LETTER[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    # Of a run of other bytes only the first counts; a text starts and ends with a space.
    keep = inside.copy()
    keep[1:] |= inside[:-1] & ~first[1:-1]
    at = np.flatnonzero(keep)
    letters = np.where(inside[at], low[at], 32).astype(np.uint64)
    bounds = np.searchsorted(at, offsets)
    n = len(offsets) - 1
    # Three spaces of margin before each text and after the last.
    place = np.arange(len(at)) + 3 * np.repeat(np.arange(1, n + 1), np.diff(bounds))
    padded = np.full(len(at) + 3 * n + 3, 32, np.uint64)
    padded[place] = letters
    edge = bounds + 3 * np.arange(n + 1)
    codes = []
    whole = padded
    three = whole[:-2] | (whole[1:-1] << np.uint64(8)) | (whole[2:] << np.uint64(16))
    four = three[:-1] | (whole[3:] << np.uint64(24)) | np.uint64(1 << 40)
    for grams in (three, four):
        codes.append((mixed(grams) & np.uint64(BUCKETS - 1)).astype(np.int32))
    # Text i owns the grams that start in its margin or letters; the next margin is as far as they reach.
    size = len(four)
    both = np.empty(2 * size, np.int32)
    both[0::2], both[1::2] = codes[0][:size], codes[1]
    return both, 2 * np.minimum(edge, size)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # score of every bucket for every language
    bias: np.ndarray
    sharpness: float  # of the softmax, fitted on held-back rows
    least: float  # lowest probability that is accepted

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each language for each text."""
        codes, bounds = buckets(data, offsets)
        sums = np.zeros((len(bounds) - 1, len(self.languages)))
        counts = np.diff(bounds)
        some = np.flatnonzero(counts)
        if len(some):
            values = self.table[codes[: bounds[-1]]]
            sums[some] = np.add.reduceat(values, bounds[:-1][some], axis=0, dtype=np.float64)
        return self.softmax(sums / np.maximum(counts, 1)[:, None])

    def softmax(self, mean: np.ndarray) -> np.ndarray:
        raw = self.sharpness * (mean + self.bias)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> Model | None:
    """Train by stochastic gradient descent; a fifth of the rows is held back to calibrate. None without rows."""
    if not texts:
        return None
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    bags = []
    for text in texts:
        codes, bounds = buckets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        values, counts = np.unique(codes[: bounds[-1]], return_counts=True)
        bags.append((values, (counts / max(1, counts.sum())).astype(np.float32)))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    step, total = 0, EPOCHS * len(used)
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            values, weight = bags[i]
            rate = np.float32(0.5 * (1 - step / total) + 0.01)
            step += 1
            mean = weight @ embed[values]
            raw = mean @ out + bias
            slope = np.exp(raw - raw.max())
            slope /= slope.sum()
            slope[target[i]] -= 1
            back = out @ slope
            out -= rate * np.outer(mean, slope)
            bias -= rate * slope
            # Each subword's share of the mean is small, so its step is scaled up to the number of subwords.
            embed[values] -= (rate * np.float32(len(values)) ** 0.5 * 4) * np.outer(weight, back)
    model = Model(languages, (embed @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    check = held if len(held) >= 20 else order
    means = np.stack([bags[i][1].astype(np.float64) @ model.table[bags[i][0]] for i in check])
    losses = []
    for sharpness in np.geomspace(0.25, 64, 33):
        model.sharpness = float(sharpness)
        chance = model.softmax(means)
        losses.append((-np.log(np.maximum(chance[np.arange(len(check)), target[check]], 1e-12)).mean(), model.sharpness))
    # Of nearly equal fits the mildest: rows that are all right would ask for certainty.
    model.sharpness = min(s for loss, s in losses if loss <= min(losses)[0] + 0.001)
    right = model.softmax(means)
    sure = right.max(axis=1)[right.argmax(axis=1) == target[check]]
    # Reject what is less sure than nearly all held-back rows that were right, and never above two fifths.
    model.least = float(min(0.4, np.quantile(sure, 0.002))) if len(sure) else 0.0
    return model


def train(docs: DataFrame, label: str = "lang", text: str = "text", rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on about ``rows`` whole labelled texts, evenly from the languages; what is collected does not grow with ``docs``."""
    known = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), text_bytes(text).alias("content"))
    picked = sample(known, rows, "label").collect()
    picked.sort(key=lambda r: (r["label"], bytes(r["content"])))
    return fit([bytes(r["content"]) for r in picked], [r["label"] for r in picked])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in chunks(batches, "_content", SCORED_BYTES):
            chance = model.scores(*binary(batch.column("_content")))
            lettered = np.array(batch.column("_lettered"), bool)
            score = np.where(lettered, chance.max(axis=1), 0.0)
            found = np.where(lettered, names[chance.argmax(axis=1)], UNKNOWN)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if not name.startswith("_")]
            named = [name for name in batch.schema.names if not name.startswith("_")]
            added = [pa.array(found, pa.string()), pa.array(score), pa.array(~lettered | (score < model.least))]
            yield pa.RecordBatch.from_arrays([*kept, *added], [*named, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``lang_pred, score, rejected`` of every row.

    ``lang_pred`` is a learned language, or ``und`` (score 0, rejected) where the text is null or has no letter,
    or for all rows without a model. ``rejected`` also marks texts less sure than the calibrated bound. Every
    row is returned; columns of ``docs`` that are not named in ``keep`` are ignored, whatever their names.
    """
    columns = [column.alias(name) for name, column in keep.items()]
    if model is None:
        return docs.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*columns, text_bytes(text).alias("_content"), lettered.alias("_lettered"))
    kept = rows.drop("_content", "_lettered").schema
    schema = kept.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return map_arrow(rows, _predict(model), schema)


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their columns as they were."""
    names = docs.columns
    inner = {f"c{i}": docs[name] for i, name in enumerate(names)}
    found = identify(docs, model, inner, text).where("not rejected")
    return found.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)))
