"""Token ids as the tokenizers library gives them, with each distinct part of a text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: All but the characters whose class, case and normal form are the same everywhere (dotted I and long s are not).
_ODD = re.compile(r"[^\t\n\r -~\u00a1-\u012f\u0131-\u017e]")
_PLAIN = [x for x in map(chr, range(0x180)) if not _ODD.match(x)]
# The published split patterns of the two kinds of vocabulary.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The characters that stand for the bytes in such vocabularies. A zero byte, which no plain text has, is a space here.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [x for x in range(0x100) if x not in _SHOWN]
_BYTES = np.arange(0x100, dtype="<u2")
_BYTES[_HIDDEN] = 0x100 + np.arange(len(_HIDDEN))
_ALPHABET = [chr(x) for x in _BYTES]
_BYTES[0] = 0x20
#: New parts that one call of the library encodes.
_JOINED = 500

_encoders: dict[tuple[int, int], "Encoder"] = {}


def _plain_pattern(pattern: str) -> re.Pattern:
    """A split pattern for plain texts only, with their letters and numbers written out."""
    for kind in "LN":
        pattern = pattern.replace(f"\\p{{{kind}}}", "".join(x for x in _PLAIN if unicodedata.category(x)[0] == kind))
    return re.compile(pattern)


def encoder(spec: str, limit: int = 300_000) -> "Encoder":
    """The worker's encoder for a tokenizer file's content, with about ``limit`` known parts, twice; kept between tasks."""
    key = hash(spec), limit
    if key not in _encoders:
        _encoders[key] = Encoder(spec, limit)
    return _encoders[key]


class Encoder:
    """Whole texts to ids.

    Both known kinds split a text before they merge. So a plain text is split by the same pattern, known parts are
    looked up, and the library's model encodes the rest, many in a call. Texts with other characters or with anything
    like a special token go to the library whole, as do all texts of a tokenizer of another kind.
    """

    def __init__(self, spec: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(spec)
        normalizer, pre = parts.get("normalizer"), parts.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])]
        special = [x["content"] for x in parts.get("added_tokens", [])]
        self.kind = None
        if all(x.startswith("<|") for x in special):
            if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                self.kind, self.pattern = "bytes", _plain_pattern(_BYTE_LEVEL)
            elif kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [_WORD_LEVEL]:
                self.kind, self.pattern = "words", _plain_pattern(_WORD_LEVEL)
        suffix, vocab = parts["model"].get("end_of_word_suffix") or "", self.library.get_vocab()
        if self.kind and not all(x in vocab and x + suffix in vocab for x in _ALPHABET):
            self.kind = None
        if self.kind:
            # The same model behind a split at spaces, and the bytes that each of its ids stands for.
            bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(parts | bare | {"truncation": None, "padding": None}))
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, number in vocab.items():
                self.sizes[number] = len(token.removesuffix(suffix))
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, content: bytes) -> bytes:
        """What the library's steps after the normaliser see, marked; the raw bytes where special tokens may be found first."""
        normalizer = self.library.normalizer
        if self.kind is None or normalizer is None or b"<|" in content:
            return b"raw:" + content
        return b"normal:" + normalizer.normalize_str(content.decode("utf-8", "replace")).encode()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of plain texts, as the split pattern makes them."""
        out = []
        for i in range(0, len(parts), _JOINED):
            some = [x.encode() for x in parts[i : i + _JOINED]]
            text = _BYTES[np.frombuffer(b"\0".join(some), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(x) for x in some])
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if len(ids) != cuts[-1] + 1 or not np.array_equal(reached[cuts], ends):
                raise ValueError("the ids of joined parts do not end where the parts do")
            raw, places = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
            out += [raw[a:b] for a, b in zip(places, places[1:])]
        return out

    def _learn(self, used: set[str]) -> None:
        """Know all ``used`` parts. Those known longest without a use go when there are too many."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        missing = used.difference(self.known)
        self.known.update([(x, self.older[x]) for x in missing if x in self.older])
        new = [x for x in missing if x not in self.known]
        self.known.update(zip(new, self._parts(new)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            if self.kind is None or "<|" in text or _ODD.search(text):
                whole.append(i)
            else:
                cut.append((i, self.pattern.findall(text.lower() if self.kind == "words" else text)))
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        self._learn(set().union(*(parts for _, parts in cut)))
        get = self.known.__getitem__
        for i, parts in cut:
            out[i] = b"".join(map(get, parts))
        return out
