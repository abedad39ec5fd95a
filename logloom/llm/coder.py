"""Context-mixing range coder for token ids, many blocks in step.

Three predictions are mixed: the id that last followed the same two ids
(order 2), the one that last followed the same id (order 1), and frequencies
of ids (order 0), which are given, for example those of all blocks of a group.
How the unit is shared among them is learned for each joint state of
confidence. A block is coded from a fresh model; blocks don't depend on each
other, so one pass advances all of them by one id at a time with array
operations; all sums are integers, so that every machine decodes alike.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
LANES = 2048
_SLOTS = 512
#: Parts of a span that the predictions share, and of their rest that the ids share.
_UNIT_BITS, _PART_BITS = 30, 18
_UNIT, _PARTS = 1 << _UNIT_BITS, 1 << _PART_BITS
_SCALE, _U32, _WORD, _LOW = np.uint64(_UNIT_BITS), np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
#: Words of a coded block: an id takes one at most, and two end it.
_ROOM = BLOCK + 2
LARGEST_ID = (1 << 16) - 1
#: A state is the confidence (0 to 3) of order 2 and of order 1, and whether order 1 tells another id. What it has of shares at first.
_STATES = [(sure2, sure1, has1) for sure2 in range(4) for sure1 in range(4) for has1 in range(2)]
_FRESH = np.array([[sure2 > 0, has1, 1, 0] for sure2, _, has1 in _STATES], dtype=np.int32)
#: What an occurrence adds to its share, and the unit of a share by their sum.
_GAIN = 2
_SHARE = (_UNIT // np.maximum(np.arange(4 + _GAIN * BLOCK), 1)).astype(np.int32)
#: The shares of a state as one item, which numpy takes at once.
_ROW = np.dtype("V16")


def lanes(blocks: int) -> int:
    """How many of a group's blocks to code in step: all alike, and about LANES, so that no few are left for a pass of their own."""
    return -(-blocks // max(1, round(blocks / LANES))) or 1


class Frequencies:
    """How the parts of order 0 are shared among ids: ``ids`` that may occur, ascending, and ``parts`` of each."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray):
        self.ids, self.parts = ids, parts
        self.begin, self.size = (np.zeros(LARGEST_ID + 1, dtype=np.int32) for _ in range(2))
        self.begin[ids], self.size[ids] = np.cumsum(parts) - parts, parts
        self.owner = np.repeat(ids.astype(np.int32), parts)

    @staticmethod
    def of(stream: np.ndarray) -> Frequencies:
        """In proportion to how often ids occur, one part at least."""
        counts = np.bincount(stream, minlength=1)
        ids = np.flatnonzero(counts)
        return Frequencies(ids, 1 + counts[ids] * (_PARTS - len(ids)) // max(len(stream), 1))

    @staticmethod
    def alike() -> Frequencies:
        ids = np.arange(LARGEST_ID + 1)
        return Frequencies(ids, np.full(len(ids), _PARTS // len(ids)))

    def dump(self) -> bytes:
        """The steps between ids and the parts, byte by byte, so that the higher ones compress to nothing."""
        table = np.stack([np.diff(self.ids, prepend=0), self.parts]).astype("<u4")
        return table.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()

    @staticmethod
    def load(data: bytes) -> Frequencies:
        table = np.frombuffer(data, dtype=np.uint8).reshape(2, 4, -1).transpose(0, 2, 1).copy().view("<u4")[:, :, 0].astype(np.int64)
        return Frequencies(np.cumsum(table[0]), table[1])


class _Model:
    """The state of ``lanes`` blocks.

    Order 1 and order 2 are the rows of one array, so that one operation serves
    both. What lanes hold for the same context lies side by side: most lanes are
    at common ones, which stay in the cache.
    """

    def __init__(self, lanes: int):
        self.lanes, self.lane = lanes, np.arange(lanes, dtype=np.int32)
        self.slot = np.stack([self.lane, self.lane + lanes * _SLOTS])
        self.table = np.zeros(2 * lanes * _SLOTS, dtype=np.int32)
        self.shares = np.repeat(_FRESH, lanes, axis=0).ravel()
        self.rows = self.shares.view(_ROW)
        self.last, self.before = np.zeros(lanes, dtype=np.int32), np.zeros(lanes, dtype=np.int32)

    def predict(self, n: int) -> None:
        """For the first ``n`` lanes: both predicted ids, the parts of the unit they get, and what an order-0 part is of the rest."""
        at = np.empty((2, n), dtype=np.int32)
        np.multiply(self.last[:n], 40503, out=at[0])  # wraps, but the bits taken are below
        np.multiply(self.before[:n], 30011, out=at[1])
        at[1] += at[0]
        at[0] >>= 4
        at[1] >>= 5
        at &= _SLOTS - 1
        at *= self.lanes
        at += self.slot[:, :n]
        self.at = at.astype(np.intp)
        self.seen = self.table.take(self.at, mode="clip")
        self.sure = self.seen & 3
        self.has1 = (self.sure[0] > 0) & (self.seen[0] ^ self.seen[1] > 3)
        self.state = (self.sure[1] << 3) + (self.sure[0] << 1)
        self.state += self.has1
        self.state *= self.lanes
        self.state += self.lane[:n]
        shares = self.rows.take(self.state, mode="clip").view(np.int32).reshape(-1, 4)
        unit = _SHARE.take(shares[:, 0] + shares[:, 1] + shares[:, 2], mode="clip")
        self.part2, self.part1 = unit * shares[:, 0], unit * shares[:, 1]
        self.base = self.part2 + self.part1
        self.step = _UNIT - self.base >> _PART_BITS

    def interval(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, order0: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of what is coded: a prediction's part, or the parts of an id that both missed."""
        start = self.base + self.step * order0.begin.take(ids, mode="clip")
        width = self.step * order0.size.take(ids, mode="clip")
        start = np.where(hit2, 0, np.where(hit1, self.part2, start))
        width = np.where(hit2, self.part2, np.where(hit1, self.part1, width))
        return start.astype(np.uint64), width.astype(np.uint64)

    def learn(self, n: int, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        part = (self.state << 2) + 2
        part -= hit2.view(np.int8) * np.int8(2) + hit1.view(np.int8)
        part = part.astype(np.intp)
        self.shares[part] = self.shares.take(part, mode="clip") + _GAIN
        shifted = ids << 2
        same = self.seen ^ shifted < 4
        gain = np.minimum(self.sure, 2)
        gain *= same
        gain += shifted + 1
        self.table[self.at.ravel()] = gain.ravel()
        self.before[:n], self.last[:n] = self.last[:n], ids


def encode(blocks: list[np.ndarray], order0: Frequencies | None = None) -> list[bytes]:
    """Code blocks of at most BLOCK ids each; the longest come first. Without ``order0`` all ids are alike."""
    lengths = np.array([len(b) for b in blocks])
    lanes, longest, order0 = len(blocks), int(lengths.max(initial=0)), order0 or Frequencies.alike()
    ids = np.zeros((longest, lanes), dtype=np.int32)
    for k, block in enumerate(blocks):
        ids[: len(block), k] = block
    model = _Model(lanes)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    out, at = np.zeros(lanes * _ROOM, dtype="<u4"), np.arange(lanes) * _ROOM
    for t in range(longest):
        n = lanes if lengths[-1] > t else int(np.count_nonzero(lengths > t))
        now = ids[t, :n]
        model.predict(n)
        same = model.seen ^ now << 2 < 4
        hit2, hit1 = same[1] & (model.sure[1] > 0), same[0] & model.has1
        start, width = model.interval(now, hit2, hit1, order0)
        unit, before = span[:n] >> _SCALE, low[:n].copy()
        low[:n] += unit * start
        span[:n] = unit * width
        over = low[:n] < before
        if over.any():
            _carry(out, at[np.flatnonzero(over)] - 1)
        idx = np.flatnonzero(span[:n] < _WORD)
        place, settled = at.take(idx), low.take(idx)
        out[place] = settled >> _U32
        at[idx] = place + 1
        low[idx] = settled << _U32
        span[idx] = span.take(idx) << _U32
        model.learn(n, now, hit2, hit1)
    for word in (low >> _U32, low & _LOW):
        out[at] = word
        at += 1
    return [out[k * _ROOM : at[k]].tobytes() for k in range(lanes)]


def _carry(out: np.ndarray, place: np.ndarray) -> None:
    """Add one to the words at ``place``, and to those before where they overflow."""
    while len(place):
        out[place] += np.uint32(1)
        place = place[out[place] == 0] - 1


def decode(coded: list[bytes], lengths: list[int], order0: Frequencies | None = None) -> list[np.ndarray]:
    """The ids of blocks that ``encode`` has coded with the same ``order0``."""
    lengths = np.array(lengths)
    lanes, longest, order0 = len(coded), int(lengths.max(initial=0)), order0 or Frequencies.alike()
    sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
    data = np.concatenate([np.frombuffer(b"".join(coded), dtype="<u4"), np.zeros(_ROOM, dtype="<u4")]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes + 2
    code = (data[at - 2] << _U32) | data[at - 1]  # less what lies below the interval
    span = np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    ids, model = np.zeros((longest, lanes), dtype=np.int32), _Model(lanes)
    for t in range(longest):
        n = lanes if lengths[-1] > t else int(np.count_nonzero(lengths > t))
        model.predict(n)
        unit = span[:n] >> _SCALE
        value = np.minimum(code[:n] // unit, np.uint64(_UNIT - 1)).astype(np.int32)
        hit2 = value < model.part2
        hit1 = ~hit2 & (value < model.base)
        found = order0.owner.take(((value - model.base) / model.step).astype(np.intp), mode="clip")  # exact: all below 2^31
        told = model.seen >> 2
        now = np.where(hit2, told[1], np.where(hit1, told[0], found))
        start, width = model.interval(now, hit2, hit1, order0)
        code[:n] -= unit * start
        span[:n] = unit * width
        idx = np.flatnonzero(span[:n] < _WORD)
        place = at.take(idx)
        code[idx] = (code.take(idx) << _U32) | data.take(place)
        at[idx] = place + 1
        span[idx] = span.take(idx) << _U32
        ids[t, :n] = now
        model.learn(n, now, hit2, hit1)
    return [ids[:n, k].astype("<u4") for k, n in enumerate(lengths)]


def checksum(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes(), before)
