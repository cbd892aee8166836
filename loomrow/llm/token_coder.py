"""Adaptive context-mixing range coder for token ids: one block in, one checksummed byte string out.

A block is cut into lanes of equal length that are coded side by side, one id of each lane at a step; all lanes share one model,
which learns after each step. The model mixes three predictions: the id that followed the last two ids when they were last met, the id
that followed the last one, and the frequencies of all ids so far. How much the first two count depends on how often they
have been right before, at their present confidence. The mixture drives a carry-free range coder of 64 bits in each lane.

No id is ever without code space: the two contexts leave at least ``room`` parts of the unit, and the frequencies are scaled down,
to one at least, when they sum up to more. Blocks of version 1, which lack this, are still read.

Layout: ``TIDB``, version (1 byte), ids (8), vocabulary (4), lanes (4), CRC-32 of the ids as little-endian 32-bit integers (4),
words of each lane (4 each), then the lanes' 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TIDB", 2
HEADER = "<4sBQIII"
#: lanes at most, and ids of a lane at least
MOST_LANES, LEAST_STEPS = 4096, 256
#: parts of the unit that the mixture divides, as a power of two
UNIT_BITS = 30
UNIT = 1 << UNIT_BITS
#: a frequency grows by this for each id met; all ids begin at one
GAIN = 16
CONFIDENCES = 8
PAIR_BITS = 18
#: by twice the confidence, and one more if the guess was right: the confidence from then on, and whether the id met takes the guess's place
RENEWED = np.array([x for c in range(CONFIDENCES) for x in (max(c - 1, 1), min(c + 1, CONFIDENCES - 1))], dtype=np.int32)
REPLACED = np.array([x for c in range(CONFIDENCES) for x in (c <= 1, False)])
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
ONE, WORD_SHIFT, HIGH_SHIFT = np.uint64(1), np.uint64(16), np.uint64(48)


def u64(x: int) -> np.uint64:
    return np.uint64(x)


class Model:
    """What both sides know after each step."""

    def __init__(self, vocabulary: int, lanes: int, version: int = VERSION):
        if not 0 < vocabulary <= UNIT // 4:
            raise ValueError(f"a vocabulary of {vocabulary} ids has no place in the unit")
        # what the contexts divide, and the least that they leave
        self.divided = UNIT - 2 * vocabulary if version > 1 else UNIT
        self.room = UNIT - self.divided + self.divided // 256 if version > 1 else None
        self.frequency = np.ones(vocabulary, dtype=np.int64)
        self.scaled = np.empty(vocabulary, dtype=np.int64)
        self.cumulated = np.zeros(vocabulary + 1, dtype=np.int64)
        # the id that followed a context, and how sure it is: side by side, so that both are read and written at once
        self.after_one, self.after_two = np.zeros(vocabulary, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=np.int64)
        (self.next_one, self.sure_one), (self.next_two, self.sure_two) = (x.view(np.int32).reshape(-1, 2).T for x in (self.after_one, self.after_two))
        # rights and trials at each confidence; none at confidence 0
        self.right = np.ones((2, CONFIDENCES), dtype=np.int64)
        self.tried = np.full((2, CONFIDENCES), 2, dtype=np.int64)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.pair = np.zeros(lanes, dtype=np.int64)

    def predict(self) -> None:
        """The two predicted ids of each lane, their shares of the unit, and the cumulated frequencies."""
        (self.one, self.c1), (self.two, self.c2) = (
            x.take(at).view(np.int32).reshape(-1, 2).T for x, at in ((self.after_one, self.last), (self.after_two, self.pair))
        )
        shares = (self.divided * 15 // 16) * self.right // self.tried
        shares[:, 0] = 0
        # what a lane's two confidences give: one of a few shares of the unit
        both = self.c1 * CONFIDENCES + self.c2
        w2 = np.tile(shares[1], CONFIDENCES)
        w12 = w2 + np.repeat(shares[0], CONFIDENCES) * (self.divided - w2) // self.divided
        self.w2, self.w12 = w2.take(both), w12.take(both)
        self.rest = UNIT - self.w12
        frequency, total = self.frequency, int(self.frequency.sum())
        if self.room is not None and total > self.room:
            np.multiply(frequency, self.room - len(frequency), out=self.scaled)
            frequency = np.floor_divide(self.scaled, total, out=self.scaled)
            frequency += 1
        np.cumsum(frequency, out=self.cumulated[1:])
        self.total = int(self.cumulated[-1])

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's id lies in the unit, and how wide."""
        low = self.cumulated.take(ids) * self.rest // self.total
        high = self.cumulated[1:].take(ids) * self.rest // self.total
        first = (ids == self.two) & (self.w2 > 0)
        second = (ids == self.one) & (self.w12 > self.w2) & ~first
        start = np.where(second, self.w2, self.w12 + low)
        start[first] = 0
        size = np.where(first, self.w2, np.where(second, self.w12 - self.w2, high - low))
        if not size.all():
            # such a lane would count as settled for ever
            raise ValueError("an id has no code space")
        return start, size

    def found(self, place: np.ndarray) -> np.ndarray:
        """The id whose interval holds a place of the unit."""
        ids = np.where(place < self.w2, self.two, self.one).astype(np.int64)
        # only ids that neither context names are searched for
        free = np.flatnonzero(place >= self.w12)
        count = ((place[free] - self.w12[free] + 1) * self.total - 1) // self.rest[free]
        order = np.argsort(count)
        ids[free[order]] = np.searchsorted(self.cumulated, count[order], side="right") - 1
        return ids

    def learn(self, ids: np.ndarray) -> None:
        for row, guess, sure, table, at in ((0, self.one, self.c1, self.after_one, self.last), (1, self.two, self.c2, self.after_two, self.pair)):
            case = sure * 2 + (guess == ids)
            met = np.bincount(case, minlength=2 * CONFIDENCES)
            self.tried[row] += met[::2] + met[1::2]
            self.right[row] += met[1::2]
            now = np.empty((len(ids), 2), dtype=np.int32)
            now[:, 0] = np.where(REPLACED.take(case), ids, guess)
            now[:, 1] = RENEWED.take(case)
            # of lanes in one context the last decides
            table[at] = now.view(np.int64).ravel()
        np.add.at(self.frequency, ids, GAIN)
        self.pair = (self.last * 0x9E3779B1 + ids * 0x85EBCA77) >> 7 & ((1 << PAIR_BITS) - 1)
        self.last = ids


def shape(count: int) -> tuple[int, int]:
    """Lanes and steps for so many ids."""
    lanes = max(1, min(MOST_LANES, count // LEAST_STEPS))
    return lanes, -(-count // lanes)


def unsettled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The lanes whose first word is certain, or whose width is too small to go on without giving one out."""
    return np.flatnonzero(((low ^ (low + width)) < TOP) | (width < BOTTOM))


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block; ids are below ``vocabulary``, and there are fewer than two million or so."""
    ids = np.asarray(ids, dtype=np.int64)
    count = len(ids)
    checksum = zlib.crc32(ids.astype("<u4").tobytes())
    if not count:
        return struct.pack(HEADER, MAGIC, VERSION, 0, vocabulary, 0, checksum)
    lanes, steps = shape(count)
    padded = np.zeros(lanes * steps, dtype=np.int64)
    padded[:count] = ids
    rows = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    who, what = [], []
    for row in rows:
        model.predict()
        start, size = model.interval(row)
        part = width >> u64(UNIT_BITS)
        low += part * start.astype(np.uint64)
        width = part * size.astype(np.uint64)
        out = unsettled(low, width)
        l, w = low[out], width[out]
        while len(out):
            narrow = (l ^ (l + w)) >= TOP
            w = np.where(narrow, (~l + ONE) & (BOTTOM - ONE), w)
            who.append(out)
            what.append((l >> HIGH_SHIFT).astype(np.uint16))
            l, w = l << WORD_SHIFT, w << WORD_SHIFT
            low[out], width[out] = l, w
            again = unsettled(l, w)
            out, l, w = out[again], l[again], w[again]
        model.learn(row)
    everyone = np.arange(lanes)
    for shift in (48, 32, 16, 0):
        who.append(everyone)
        what.append((low >> u64(shift) & u64(0xFFFF)).astype(np.uint16))
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.argsort(who, kind="stable")
    sizes = np.bincount(who, minlength=lanes).astype("<u4")
    return struct.pack(HEADER, MAGIC, VERSION, count, vocabulary, lanes, checksum) + sizes.tobytes() + what[order].astype("<u2").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; a block that is not what was written is refused."""
    if len(block) < struct.calcsize(HEADER):
        raise ValueError("a block is cut off")
    magic, version, count, vocabulary, lanes, checksum = struct.unpack_from(HEADER, block)
    if magic != MAGIC or not 1 <= version <= VERSION:
        raise ValueError(f"no token block begins with {block[:5]!r}")
    if not count:
        return np.zeros(0, dtype=np.int64)
    sizes = np.frombuffer(block, dtype="<u4", count=lanes, offset=struct.calcsize(HEADER)).astype(np.int64)
    words = np.frombuffer(block, dtype="<u2", offset=struct.calcsize(HEADER) + 4 * lanes)
    if len(words) != sizes.sum():
        raise ValueError("a block is cut off")
    words = np.concatenate([words, np.zeros(4, dtype=np.uint16)]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, dtype=np.uint64)
    for i in range(4):
        code = code << u64(16) | words[at + i]
    at += 4
    steps = -(-count // lanes)
    rows = np.empty((steps, lanes), dtype=np.int64)
    model = Model(vocabulary, lanes, version)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    for step in range(steps):
        model.predict()
        part = width >> u64(UNIT_BITS)
        place = np.minimum((code - low) // part, u64(UNIT - 1)).astype(np.int64)
        ids = np.minimum(model.found(place), vocabulary - 1)
        start, size = model.interval(ids)
        low += part * start.astype(np.uint64)
        width = part * size.astype(np.uint64)
        out = unsettled(low, width)
        l, w = low[out], width[out]
        while len(out):
            narrow = (l ^ (l + w)) >= TOP
            w = np.where(narrow, (~l + ONE) & (BOTTOM - ONE), w)
            code[out] = code[out] << WORD_SHIFT | words[np.minimum(at[out], len(words) - 1)]
            at[out] += 1
            l, w = l << WORD_SHIFT, w << WORD_SHIFT
            low[out], width[out] = l, w
            again = unsettled(l, w)
            out, l, w = out[again], l[again], w[again]
        rows[step] = ids
        model.learn(ids)
    ids = rows.T.ravel()[:count]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("the ids of a block do not have its checksum")
    return ids
