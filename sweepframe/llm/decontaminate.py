"""Benchmark items inside documents, up to a budget of edits: exact pieces first, then Myers' distance.

An item with at most e edits, cut into e + 1 pieces, keeps one piece unchanged. So a document holds an item
only around a hit of one of its pieces, which an automaton of all pieces finds in one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, text_bytes

#: Edits allowed for each 100 characters of an item.
PERCENT = 5
#: Characters of items that are looked for in one pass; more items take more passes.
PASS_CHARS = 8 << 20


def plain(text: str) -> str:
    """Lower case, every run of white space one space."""
    return " ".join(text.lower().split())


def distance_within(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any part of ``text`` and where that part ends; None beyond ``budget``.

    Myers' bit-parallel recurrence on one integer as wide as the pattern; a match may start anywhere.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, letter in enumerate(pattern):
        masks[letter] = masks.get(letter, 0) | (1 << i)
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for end, letter in enumerate(text, 1):
        equal = masks.get(letter, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= budget else None


@dataclass
class Items:
    ids: list[int | None]
    texts: list[str]
    percent: int

    def budget(self, item: int) -> int:
        return len(self.texts[item]) * self.percent // 100

    def automaton(self):
        """All pieces, each with the items and places it comes from."""
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in enumerate(self.texts):
            parts = min(self.budget(item) + 1, len(text))
            cuts = np.linspace(0, len(text), parts + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((item, a))
        found = ahocorasick.Automaton()
        for piece, sources in places.items():
            found.add_word(piece, (len(piece), sources))
        found.make_automaton()
        return found


def matches(items: Items, automaton, text: str) -> list[tuple[int, int, int, int]]:
    """``(item, distance, start of the window, end)`` of the best match of every item in ``text``."""
    regions: dict[int, list[list[int]]] = {}
    for end, (size, sources) in automaton.iter(text):
        for item, place in sources:
            budget, m = items.budget(item), len(items.texts[item])
            start = end + 1 - size - place
            a, b = max(0, start - budget), min(len(text), start + m + budget)
            spans = regions.setdefault(item, [])
            # Hits come in the order of their ends, so windows that overlap follow each other closely.
            if spans and a <= spans[-1][1] and b >= spans[-1][0]:
                spans[-1][0], spans[-1][1] = min(a, spans[-1][0]), max(b, spans[-1][1])
            else:
                spans.append([a, b])
    out = []
    for item, spans in regions.items():
        best = None
        for a, b in spans:
            found = distance_within(items.texts[item], text[a:b], items.budget(item))
            if found and (best is None or found[0] < best[1]):
                best = (item, found[0], a, a + found[1])
            if best and best[1] == 0:
                break
        if best:
            out.append(best)
    return out


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = items.automaton()
        for batch in chunks(batches, "content"):
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                text = plain(content.decode("utf-8", "replace"))
                for item, distance, start, end in matches(items, automaton, text):
                    rows.append((doc_id, items.ids[item], distance, start, end, text[start:end]))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "item_id", "distance", "window_start", "match_end", "passage"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)

    return run


def _drop(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = items.automaton()
        for batch in chunks(batches, "_content"):
            keep = [not matches(items, automaton, plain(x.decode("utf-8", "replace"))) for x in batch.column("_content").to_pylist()]
            names = [name for name in batch.schema.names if name != "_content"]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def passes(benchmark: DataFrame, percent: int = PERCENT) -> Iterator[Items]:
    """The items in runs of at most ``PASS_CHARS`` characters, so that no worker gets more at once.

    Null and blank items hold nothing to find and are left out. Equal texts are looked for once each.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    ids, texts, held = [], [], 0
    for item_id, text in rows.toLocalIterator():
        text = plain(text)
        if not text:
            continue
        if held + len(text) > PASS_CHARS and texts:
            yield Items(ids, texts, percent)
            ids, texts, held = [], [], 0
        ids.append(item_id)
        texts.append(text)
        held += len(text)
    if texts:
        yield Items(ids, texts, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, distance, window_start, match_end, passage`` for every document and item it holds.

    Texts are compared in lower case with single spaces; places count in that form. An item counts as held if
    some part of the text is within ``percent`` edits per 100 of its characters. The best match of a pair is
    given. Null and empty texts hold nothing; repeated rows each have their rows; further columns are ignored;
    empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("content"))
    schema = "doc_id long, item_id long, distance int, window_start long, match_end long, passage string"
    found = None
    for items in passes(benchmark, percent):
        part = map_arrow(rows, _search(items), schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they were."""
    names = docs.columns
    rows = docs.select(*(docs[name].alias(f"c{i}") for i, name in enumerate(names)), text_bytes().alias("_content"))
    schema = rows.drop("_content").schema
    for items in passes(benchmark, percent):
        kept = map_arrow(rows, _drop(items), schema)
        rows = kept.withColumn("_content", text_bytes(f"c{names.index('text')}"))
    return rows.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)))
