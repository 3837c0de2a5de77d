from __future__ import annotations

import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from sweepframe.llm import range_coder, token_files
from sweepframe.llm.queries import QUERIES, tokenizer
from sweepframe.llm.token_counts import token_counts
from sweepframe.llm.token_files import documents_of, read_token_files, write_token_files
from sweepframe.llm.tokens import Encoder

BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def library(path, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path, texts):
    rng = random.Random(5)
    parts = ["a", "The", " ", "  ", "\n", "\t", ".", "don't", "'S", "é", "ÉÇ", "<|", "<|endoftext|>", "12", "İ", "ſ", " ", "\x1c", "中", "😀", "'", "!!", "\r\n", "ǆ", "ª²"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    own = Encoder(Path(path).read_text("utf-8"), limit=500)
    assert own.kind
    for batch in (made[:1500], made[1500:], list(texts.values())):
        assert own.encode(batch) == library(path, batch)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_plain_characters_split_as_in_the_library(path):
    rng = random.Random(8)
    plain = [chr(x) for x in [9, 10, 13, *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x17F)]]
    made = [f"{x}a {x} {x}{x}1{x}" for x in plain] + ["".join(rng.choices(plain, k=40)) for _ in range(2000)]
    assert Encoder(Path(path).read_text("utf-8")).encode(made) == library(path, made)


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **more)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_new_parts_share_calls_and_parts_in_use_stay_known(path):
    rng = random.Random(9)
    made = [" ".join("".join(rng.choices("abcdeé", k=9)) for _ in range(500)) for _ in range(10)]
    own = Encoder(Path(path).read_text("utf-8"), limit=2000)
    counted = {name: Counted(getattr(own, name)) for name in ("library", "model") if hasattr(own, name)}
    vars(own).update(counted)
    want = library(path, made)
    assert own.encode(made) == want
    # 5,000 new words in a few calls, not a text for each.
    assert sum(x.texts for x in counted.values()) < 50
    # A part that every batch uses outlives the limit.
    for _ in range(6):
        before = sum(x.texts for x in counted.values())
        assert own.encode(made[:2]) == want[:2]
        assert sum(x.texts for x in counted.values()) == before
        own.encode([" ".join("".join(rng.choices("fghij", k=9)) for _ in range(1500))])


@pytest.mark.parametrize("lengths", [[], [0], [1], [5, 0, 300, 300, 17], [2048, 2047]])
def test_range_coder_round_trip(lengths):
    rng = np.random.default_rng(3)
    made = [(rng.zipf(1.3, n) % 65_536).astype("<u4") for n in lengths]
    made += [np.repeat(np.uint32(7), 1000), np.arange(0, 65_536, 41, dtype="<u4"), np.full(9, 65_535, "<u4")]
    coded = range_coder.encode(made)
    back = range_coder.decode(coded, [len(x) for x in made])
    assert all(np.array_equal(a, b) for a, b in zip(made, back))
    # A block does not depend on those beside it.
    assert [range_coder.encode([x])[0] for x in made] == coded
    assert len(coded[-3]) < 300


def test_range_coder_refuses_large_ids():
    with pytest.raises(ValueError):
        range_coder.encode([np.array([65_536])])


def test_a_group_of_ids_takes_little_memory():
    ids = np.random.default_rng(1).integers(0, 50_000, token_files.SMALL_GROUP).astype("<u4")
    blocks = [ids[i : i + range_coder.BLOCK] for i in range(0, len(ids), range_coder.BLOCK)]
    tracemalloc.start()
    coded = range_coder.encode(blocks)
    back = range_coder.decode(coded, [len(x) for x in blocks])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    assert most < 32e6, most


def test_carries_reach_the_words_before():
    # Long runs of sure predictions keep the interval narrow just below a word's end; every length ends elsewhere.
    rng = np.random.default_rng(6)
    made = [np.where(rng.random(n) < 0.02, rng.integers(0, 65_536, n), 65_535 - i % 3).astype("<u4") for i, n in enumerate(range(1, 2049, 8))]
    back = range_coder.decode(range_coder.encode(made), [len(x) for x in made])
    assert all(np.array_equal(a, b) for a, b in zip(made, back))


def test_no_group_is_larger_than_asked_or_far_smaller(spark, scratch, monkeypatch):
    block = range_coder.BLOCK
    # In one file: a text beyond several groups, then some that end a little after a group's end.
    rows = [(1, "a b " * 13 * block)] + [(i, "a b " * (block // 2)) for i in range(2, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        manifest = write_token_files(docs, BYTES, f"{scratch}/groups", group=8 * block).collect()
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    decode, sizes = range_coder.decode, []
    monkeypatch.setattr(token_files.range_coder, "decode", lambda coded, lengths: sizes.append(int(lengths.sum())) or decode(coded, lengths))
    found = {d: ids.tolist() for r in manifest for d, ids in documents_of(r["path"])}
    assert found == {d: ids.tolist() for d, ids in expected(rows)}
    assert len(manifest) == 1 and max(sizes) <= 8 * block and min(sizes) >= 3 * block, sizes


def expected(pairs, path=BYTES):
    ids = library(path, [t or "" for _, t in pairs])
    return [(d, np.frombuffer(x + b"\0\0\0\0", "<u4")) for (d, _), x in zip(pairs, ids)]


def test_token_files(spark, tables, texts):
    want, start = {}, 0
    for doc, ids in expected(sorted(texts.items())):
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = QUERIES["op9_token_files"](spark, tables).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want


def test_token_files_of_odd_rows(odd, none, scratch):
    manifest = write_token_files(odd, BYTES, f"{scratch}/a")
    found = [(d, ids.tolist()) for r in sorted(manifest.collect()) for d, ids in documents_of(r["path"])]
    want = [(d, x.tolist()) for d, x in expected([(r["doc_id"], r["text"]) for r in odd.collect()])]
    first = lambda pair: (pair[0] is not None, pair[0] or 0, pair[1])
    assert sorted(found, key=first) == sorted(want, key=first)
    ids = [d for d, _ in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    rows = read_token_files(manifest).orderBy("start").collect()
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    empty = write_token_files(none, BYTES, f"{scratch}/b")
    assert read_token_files(empty).count() == 0


def test_damage_is_found(odd, scratch, tmp_path):
    row = write_token_files(odd, BYTES, f"{scratch}/c").first()
    path = Path(row["path"].removeprefix("file://"))
    data = bytearray(path.read_bytes())
    data[40] ^= 4
    path.write_bytes(data)
    with pytest.raises(Exception):
        list(documents_of(row["path"]))


def test_token_counts(spark, tables, texts):
    sizes = {d: len(x) // 4 for d, x in zip(texts, library(WORDS, list(texts.values())))}
    for r in QUERIES["op10_token_counts"](spark, tables).collect():
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), sizes[r["doc_id"]], sizes[r["doc_id"]] > 2048)


def test_cache_is_used_and_kept_apart(spark, odd, none, scratch):
    cache = f"{scratch}/cache"
    rows = lambda df: sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in df.collect())
    first = rows(token_counts(odd, WORDS, cache))
    want = library(WORDS, [r["text"] or "" for r in odd.collect()])
    assert sorted(x[2] for x in first) == sorted(len(x) // 4 for x in want)
    stored = spark.read.parquet(cache)
    assert stored.count() == odd.selectExpr("coalesce(text, '')").distinct().count()
    # Planted counts show that known texts are not encoded again, and only by their own tokenizer.
    planted = f"{scratch}/planted"
    stored.selectExpr("tokenizer", "digest", "n_tokens + 1000 AS n_tokens").write.parquet(planted)
    assert [x[2] for x in rows(token_counts(odd, WORDS, planted))] == [x[2] + 1000 for x in first]
    assert spark.read.parquet(planted).count() == stored.count()
    assert min(x[2] for x in rows(token_counts(odd, BYTES, planted))) == 0
    assert token_counts(none, WORDS, f"{scratch}/new").count() == 0


def test_one_encoding_for_each_normalised_text(spark, scratch):
    rows = [(1, "A  Text, twice\n")] * 500 + [(None, "a text, TWICE ")] * 500 + [(2, "cafe\u0301"), (3, "caf\u00e9"), (4, "<|endoftext|> A"), (5, "<|endoftext|> a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = token_counts(docs, WORDS, f"{scratch}/cache")
    # Of equal texts one is encoded; special tokens are matched in the raw text, so such texts stay apart.
    assert spark.read.parquet(f"{scratch}/cache").count() == 4
    want = dict(zip([t for _, t in rows], (len(x) // 4 for x in library(WORDS, [t for _, t in rows]))))
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found.collect()))) == sorted(str((i, len(t.encode()), want[t])) for i, t in rows)
