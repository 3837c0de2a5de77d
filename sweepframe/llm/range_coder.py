"""Token ids in independent blocks under a range coder that mixes predictions of order 0, 1 and 2.

All blocks of a call advance together, one id of each per step, so a step is a few array operations
whatever the number of blocks. A step codes one of

* an id that the order-2 or order-1 context predicts. Every context keeps one id and a confidence; its weight
  is the success rate of that confidence in this block so far, and contexts that predict the same id add
  their weights;
* a literal by order 0: the high byte by its frequency in the block so far, the low byte evenly.

The rates and frequencies made from what was seen are renewed every 64 ids. The coder's
interval has 48 bits, of which the top 16 leave as a word; a carry is added to the words before when all are there.
Decoder and encoder keep the same state and hold integers only, if in doubles (all below 2^53), so decoding is exact.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
IDS = 1 << 16
_SLOT_BITS = 9
_UNIT = 1 << 12
#: What no prediction can have of ``_UNIT``, so that a literal has room for its steps.
_REST = 256
_GAIN = 12
_RENEW = 64
_BOTTOM = float(1 << 32)
_FULL = float(1 << 48)
_WORD = float(1 << 16)


class _Model:
    """What ``lanes`` blocks have learned; blocks are ordered so that the first ``k`` are still running.

    Arrays of two rows hold order 2, then order 1.
    """

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.lane = np.arange(lanes)
        # A context holds its id, and its confidence (0 to 3) above the id's 16 bits. A slot's contexts of all blocks lie
        # side by side, as many blocks meet the same common ids.
        self.kept = np.zeros((2 * lanes) << _SLOT_BITS, np.int32)
        self.slots = np.stack([self.lane, self.lane + (lanes << _SLOT_BITS)])
        # Failures, then successes, for every order, block and confidence; and those since the rates were renewed.
        self.seen = np.repeat(np.array([3, 1]), 2 * lanes * 4)
        self.levels = (np.arange(2 * lanes) << 2).reshape(2, lanes)
        self.recent: list[np.ndarray] = []
        # Of high bytes, one row each; all of a block are below 2^16.
        self.high = np.ones((256, lanes), np.uint16)
        self.sums = np.zeros((257, lanes), np.uint16)
        self.hashes = np.zeros((2, lanes), np.uint32)
        self.before = np.zeros(lanes, np.uint32)

    def predict(self, step: int, k: int):
        """The ends of both predictions' shares of ``_UNIT``; what is left is for literals."""
        if step % _RENEW == 0:
            if self.recent:
                self.seen += np.bincount(np.concatenate(self.recent), minlength=len(self.seen))
                self.recent.clear()
            failed, right = self.seen.reshape(2, -1)
            self.rate = np.floor(right * float(_UNIT - _REST) / (failed + right))
            for count, below, sum_ in zip(self.high, self.sums, self.sums[1:]):
                np.add(count, below, out=sum_)
            self.total = self.sums[256].astype(np.float64)
        self.k = k
        self.at = (self.hashes[:, :k] >> np.uint32(32 - _SLOT_BITS)) * np.int64(self.lanes)
        self.at += self.slots[:, :k]
        self.entry = self.kept.take(self.at, mode="clip")
        self.sure = self.entry >> 16
        self.level = self.levels[:, :k] + self.sure
        self.ids = self.entry & 0xFFFF
        a, b = self.rate.take(self.level, mode="clip")
        both = a + np.floor((_UNIT - a) * b * (1 / _UNIT))
        return np.where(self.ids[0] == self.ids[1], both, a), both

    def learn(self, ids: np.ndarray, literal: np.ndarray, place: np.ndarray) -> None:
        """``place`` holds the places of the ids' high bytes in ``high``."""
        k = self.k
        right = self.ids == ids
        self.recent.append((self.level + right * np.int64(8 * self.lanes)).ravel())
        sure = np.where(right, np.minimum(self.sure + 1, 3), self.sure >> 1)
        sure <<= 16
        sure += np.where(right | (self.sure > 0), self.ids, ids)
        self.kept[self.at] = sure
        np.add.at(self.high.reshape(-1), place, literal * np.uint16(_GAIN))
        last = ids.astype(np.uint32)
        np.multiply(last, np.uint32(0x9E3779B1), out=self.hashes[1, :k])
        np.add(self.hashes[1, :k], self.before[:k], out=self.hashes[0, :k])
        np.multiply(last, np.uint32(0x85EBCA6B), out=self.before[:k])


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks by descending length, and how many of them run at each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(int(lengths.max(initial=0)))
    return order, len(lengths) - np.searchsorted(np.sort(lengths), steps, side="right")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of every block of ids, each below 65,536."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, running = _order(lengths)
    n, steps = len(blocks), len(running)
    if not steps:
        return [b""] * n
    if max(int(b.max(initial=0)) for b in blocks) >= IDS:
        raise ValueError(f"ids must be below {IDS}")
    ids = np.zeros((steps, n), np.uint16)
    for lane, b in enumerate(order):
        ids[: lengths[b], lane] = blocks[b]
    model = _Model(n)
    all_low, all_span = np.zeros(n), np.full(n, _FULL)
    # An id takes 12 bits and 23 more at most, or less than two words and a quarter.
    width = 2 * steps + steps // 4 + 8
    out, used = np.zeros(n * width, np.uint32), np.arange(n) * width
    sums = model.sums.reshape(-1)
    for step, k in enumerate(running):
        x, low, span = ids[step, :k].astype(np.int32), all_low[:k], all_span[:k]
        two, both = model.predict(step, k)
        is_two = model.ids[0] == x
        literal = ~(is_two | ((model.ids[1] == x) & (both > two)))
        unit = np.floor(span * (1 / _UNIT))
        start = np.where(literal, both, two)
        start[is_two] = 0
        part = np.where(is_two, two, np.where(literal, _UNIT, both)) - start
        high = x >> 8
        place = high * np.int64(n) + model.lane[:k]
        before = sums.take(place, mode="clip")
        size = sums.take(place + n, mode="clip") - before
        low += unit * start
        part *= unit
        unit = np.floor(part / (model.total[:k] * 256))
        low += unit * ((before * 256.0 + (x & 255) * size) * literal)
        np.copyto(span, np.where(literal, unit * size, part))
        model.learn(x, literal, place)
        due = span < _BOTTOM
        word = np.floor(low * (1 / _BOTTOM))
        # Where no word is due, the next one takes this one's place.
        out[used[:k]] = word
        used[:k] += due
        wider = np.where(due, _WORD, 1)
        low -= word * _BOTTOM * due
        low *= wider
        span *= wider
        go = np.flatnonzero(span < _BOTTOM)
        while len(go):
            word = np.floor(low[go] * (1 / _BOTTOM))
            out[used[go]] = word
            used[go] += 1
            low[go] = (low[go] - word * _BOTTOM) * _WORD
            span[go] *= _WORD
            go = go[span[go] < _BOTTOM]
    some = np.flatnonzero(lengths[order])
    out[used[some]] = np.ceil(all_low[some] * (1 / _BOTTOM))
    used = used - np.arange(n) * width + 1
    out = out.reshape(n, width)[:, : int(used.max())].copy()
    flat = out.reshape(-1)
    over = np.flatnonzero(flat >= _WORD)
    while len(over):
        flat[over] -= 1 << 16
        flat[over - 1] += 1
        over = over[flat[over - 1] >= _WORD] - 1
    coded: list[bytes] = [b""] * n
    for lane, b in enumerate(order):
        if lengths[b]:
            coded[b] = out[lane, : used[lane]].astype("<u2").tobytes()
    return coded


def decode(coded: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of every block, from its bytes and its number of ids."""
    lengths = np.asarray(lengths, np.int64)
    order, running = _order(lengths)
    n, steps = len(coded), len(running)
    width = max((len(x) for x in coded), default=0) // 2 + 8
    words = np.zeros((n, width), np.uint16)
    for lane, b in enumerate(order):
        part = np.frombuffer(coded[b], "<u2")
        words[lane, : len(part)] = part
    model = _Model(n)
    all_span = np.full(n, _FULL)
    all_code = words[:, :3] @ np.array([_BOTTOM, _WORD, 1])
    words, used = words.reshape(-1), np.arange(n) * width + 3
    ids = np.zeros((steps, n), np.uint16)
    sums = model.sums.reshape(-1)
    for step, k in enumerate(running):
        span, code = all_span[:k], all_code[:k]
        two, both = model.predict(step, k)
        unit = np.floor(span * (1 / _UNIT))
        two *= unit
        both *= unit
        is_two, literal = code < two, code >= both
        start = np.where(literal, both, two)
        start[is_two] = 0
        part = np.where(is_two, two, np.where(literal, unit * _UNIT, both)) - start
        code -= start
        total = model.total[:k] * 256
        unit = np.floor(part / total)
        value = np.minimum(np.floor(code / unit), total - 1)
        byte = (value * (1 / 256)).astype(np.uint16)
        high = np.add.reduce((model.sums[8:256:8, :k] <= byte).view(np.uint8), axis=0, dtype=np.uint8)
        place = high * np.int64(8 * n) + model.lane[:k]
        for rows in (4 * n, 2 * n, n):
            place += (sums.take(place + rows, mode="clip") <= byte) * np.int64(rows)
        before = sums.take(place, mode="clip")
        size = sums.take(place + n, mode="clip") - before
        before = before * 256.0
        byte = ((value - before) / size).astype(np.int32)
        x = np.where(literal, (place // n << 8) + byte, np.where(is_two, model.ids[0], model.ids[1]))
        code -= unit * ((before + byte * size) * literal)
        np.copyto(span, np.where(literal, unit * size, part))
        ids[step, :k] = x
        # Counts of a high byte change with literals only, whose place this is.
        model.learn(x, literal, place)
        due = span < _BOTTOM
        wider = np.where(due, _WORD, 1)
        code *= wider
        code += words.take(used[:k], mode="clip") * due
        span *= wider
        used[:k] += due
        go = np.flatnonzero(span < _BOTTOM)
        while len(go):
            code[go] = code[go] * _WORD + words.take(used[go], mode="clip")
            span[go] *= _WORD
            used[go] += 1
            go = go[span[go] < _BOTTOM]
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * n
    ids = np.ascontiguousarray(ids.T)
    for lane, b in enumerate(order):
        out[b] = ids[lane, : lengths[b]].copy()
    return out
