"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: all statistics start afresh, and checksums cover the stored bytes and the ids. Its ids are
dealt to LANES runs of equal length, each with a range coder of its own; the coders go forward together, one id of every
lane a step, and share the statistics, so that a step is a handful of array operations. Whatever the encoder learns from
a step, the decoder learns after it has read that step. All arithmetic is in whole numbers.

For every id there are three predictions: the id that last followed the same two ids (order 2), the one that last followed
the same id (order 1), each with a confidence of 0 to 7 that hits raise and misses halve, and the frequencies of all ids
so far (order 0). A first symbol says which of the two candidates holds, or neither; its probabilities are the counts of
such outcomes under the same pair of confidences, which is how the orders are mixed. If neither holds, the id follows
with its order-0 frequency.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PGIDBLK1"
HEADER = struct.Struct("<8sIIIII")  # magic, ids, lanes, vocabulary, checksum of the ids, checksum of what follows
BLOCK_IDS = 1 << 21
LANES = 4096
LANE_IDS = 128  # a lane has so many ids at least, if there are as many
WORD_BITS, LOW_BITS = 16, 32
WORD, LOW, FULL = (1 << WORD_BITS) - 1, (1 << LOW_BITS) - 1, 1 << (LOW_BITS + WORD_BITS)
SLOT_BITS = 20  # of the order-2 table
FLAG_BITS = 12  # of the sum of a flag's frequencies
GAIN = 32  # an id's frequency grows by so much each time
MOST = 1 << 23  # sum of frequencies at which all are halved
REFRESH = 8  # steps between two looks at the new frequencies
MAX_VOCABULARY = 1 << 21


class Model:
    """Statistics of a block, the same in the encoder and the decoder after every step."""

    def __init__(self, vocabulary: int):
        self.one = np.zeros(vocabulary + 1, dtype=np.int64)  # id * 8 + confidence
        self.two = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.outcomes = np.ones((128, 3), dtype=np.int64)
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.ids: list[np.ndarray] = []  # what was learnt since the last look: ids of order 0, and flags with their contexts
        self.seen: list[np.ndarray] = []
        self.step = 0
        self.refresh()

    def refresh(self) -> None:
        """Take the new frequencies into use."""
        if self.ids:
            self.counts += GAIN * np.bincount(np.concatenate(self.ids), minlength=len(self.counts))
        if self.seen:
            self.outcomes += GAIN * np.bincount(np.concatenate(self.seen), minlength=self.outcomes.size).reshape(self.outcomes.shape)
        self.ids, self.seen = [], []
        while self.counts.sum() > MOST:
            self.counts = (self.counts + 1) >> 1
        self.ends = np.concatenate([[0], np.cumsum(self.counts)])
        self.total = int(self.ends[-1])
        share = self.outcomes * ((1 << FLAG_BITS) - 3) // self.outcomes.sum(axis=1, keepdims=True) + 1
        # starts of the three outcomes' ranges and their end, by context
        self.flags = np.zeros((len(share), 4), dtype=np.int64)
        self.flags[:, 1], self.flags[:, 2], self.flags[:, 3] = share[:, 0], share[:, 0] + share[:, 1], 1 << FLAG_BITS

    def counts_at(self, ids: np.ndarray) -> np.ndarray:
        """Frequencies that `ends` was made from."""
        return self.ends[ids + 1] - self.ends[ids]

    def predict(self, before: np.ndarray, last: np.ndarray):
        """Context of the flag, both candidates; `before` and `last` are ids, or the vocabulary's size before any."""
        self.slot = ((before * 40503 + last) * 2654435761 >> 11) & ((1 << SLOT_BITS) - 1)
        self.last = last
        self.had2, self.had1 = self.two[self.slot], self.one[last]
        self.first, self.second = self.had2 >> 3, self.had1 >> 3
        self.sure2, self.sure1 = self.had2 & 7, self.had1 & 7
        self.context = self.sure2 * 16 + self.sure1 * 2 + (self.first == self.second)

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        """0: the order-2 candidate, 1: the order-1 candidate, 2: neither."""
        self.hit2, self.hit1 = (ids == self.first) & (self.sure2 > 0), (ids == self.second) & (self.sure1 > 0)
        return np.where(self.hit2, 0, 2 - self.hit1)

    def learn(self, ids: np.ndarray, flag: np.ndarray, fresh: np.ndarray) -> None:
        """`fresh`: the ids that no candidate gave."""
        self.seen.append(self.context * 3 + flag)
        if len(fresh):
            self.ids.append(fresh)
        new = ids * 8 + 1
        for table, at, had, sure, hit in ((self.two, self.slot, self.had2, self.sure2, self.hit2), (self.one, self.last, self.had1, self.sure1, self.hit1)):
            less = sure >> 1
            miss = np.where(less > 0, had - sure + less, new)
            table[at] = np.where(hit, had + (sure < 7), miss)  # of lanes with the same slot the last one stays
        self.step += 1
        if self.step < REFRESH or self.step % REFRESH == 0:
            self.refresh()


class Writer:
    """Range coders of all lanes; a word is stored when the top of a lane's range is settled."""

    def __init__(self, lanes: int, words: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, FULL - 1, dtype=np.int64)
        self.all = np.arange(lanes)
        self.out = np.zeros((lanes, words), dtype=np.uint16)
        self.at = np.zeros(lanes, dtype=np.int64)

    def code(self, lanes, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """`lanes`: slice or places; a symbol is the part from start on of this size, in units of the range."""
        low = self.low[lanes] + unit * start
        if (low >= FULL).any():
            self.carry(self.all[lanes][low >= FULL])
            low &= FULL - 1
        self.low[lanes] = low
        width = unit * size
        self.range[lanes] = width
        while (short := width <= LOW).any():
            places = self.all[lanes][short]
            self.put(places)
            width = self.range[lanes]

    def put(self, places: np.ndarray) -> None:
        if int(self.at[places].max(initial=0)) >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[places, self.at[places]] = self.low[places] >> LOW_BITS
        self.at[places] += 1
        self.low[places] = (self.low[places] & LOW) << WORD_BITS
        self.range[places] <<= WORD_BITS

    def carry(self, places: np.ndarray) -> None:
        at = self.at[places] - 1
        while len(places):
            self.out[places, at] += 1
            over = self.out[places, at] == 0
            places, at = places[over], at[over] - 1

    def end(self) -> None:
        places = self.all
        for _ in range(1 + LOW_BITS // WORD_BITS):
            self.put(places)


class Reader:
    """The same coders, read back."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        n = len(lengths)
        self.words = np.zeros((n, int(lengths.max(initial=0)) + 4), dtype=np.int64)
        self.words[np.arange(self.words.shape[1]) < lengths[:, None]] = words
        self.at = np.zeros(n, dtype=np.int64)
        self.all = np.arange(n)
        self.code = np.zeros(n, dtype=np.int64)
        self.range = np.full(n, FULL - 1, dtype=np.int64)
        for _ in range(1 + LOW_BITS // WORD_BITS):
            self.get(np.arange(n))

    def get(self, places: np.ndarray) -> None:
        self.code[places] = (self.code[places] << WORD_BITS) | self.words[places, np.minimum(self.at[places], self.words.shape[1] - 1)]
        self.at[places] += 1

    def take(self, lanes, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        self.code[lanes] -= unit * start
        width = unit * size
        self.range[lanes] = width
        while (short := width <= LOW).any():
            places = self.all[lanes][short]
            self.get(places)
            self.range[places] <<= WORD_BITS
            width = self.range[lanes]


def shape(n: int) -> tuple[int, int]:
    """(lanes, ids of a lane but the last) for n ids."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    length = -(-n // lanes)
    return (-(-n // length), length) if n else (0, 0)


def steps(n: int, lanes: int, length: int):
    """(step, lanes that have an id there)."""
    for t in range(length):
        yield t, lanes if (lanes - 1) * length + t < n else lanes - 1


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids below `vocabulary`."""
    n = len(ids)
    if not 0 < vocabulary <= MAX_VOCABULARY or n and int(ids.max()) >= vocabulary:
        raise ValueError(f"ids must be below the vocabulary's size, and that at most {MAX_VOCABULARY}")
    lanes, length = shape(n)
    grid = np.zeros(lanes * length, dtype=np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T) if n else grid.reshape(0, 0)
    model, writer = Model(vocabulary), Writer(lanes, length + 8)
    none = np.full(lanes, vocabulary, dtype=np.int64)
    for t, k in steps(n, lanes, length):
        now = grid[t, :k]
        model.predict((grid[t - 2] if t > 1 else none)[:k], (grid[t - 1] if t else none)[:k])
        flag, ends, own = model.outcome(now), model.flags, slice(0, k)
        start = ends[model.context, flag]
        writer.code(own, start, ends[model.context, flag + 1] - start, writer.range[own] >> FLAG_BITS)
        rest = np.flatnonzero(flag == 2)
        new = now[rest]
        if len(rest):
            writer.code(rest, model.ends[new], model.counts_at(new), writer.range[rest] // model.total)
        model.learn(now, flag, new)
    writer.end()
    lengths = writer.at.astype("<u4")
    words = writer.out[np.arange(writer.out.shape[1]) < lengths[:, None]].astype("<u2")
    body = zlib.compress(lengths.tobytes(), 1)
    body = struct.pack("<I", len(body)) + body + words.tobytes()
    return HEADER.pack(MAGIC, n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if a checksum does not hold."""
    if len(block) < HEADER.size + 4:
        raise ValueError("a block of ids is cut off")
    magic, n, lanes, vocabulary, of_ids, of_body = HEADER.unpack_from(block)
    body = block[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != of_body or lanes != shape(n)[0]:
        raise ValueError("a block of ids is damaged")
    (packed,) = struct.unpack_from("<I", body)
    lengths = np.frombuffer(zlib.decompress(body[4 : 4 + packed]), dtype="<u4").astype(np.int64)
    reader = Reader(np.frombuffer(body, dtype="<u2", offset=4 + packed), lengths) if lanes else None
    length = shape(n)[1]
    grid = np.zeros((length, lanes), dtype=np.int64)
    model, none = Model(vocabulary), np.full(lanes, vocabulary, dtype=np.int64)
    for t, k in steps(n, lanes, length):
        model.predict((grid[t - 2] if t > 1 else none)[:k], (grid[t - 1] if t else none)[:k])
        ends, own, context = model.flags, slice(0, k), model.context
        unit = reader.range[own] >> FLAG_BITS
        value = np.minimum(reader.code[own] // unit, (1 << FLAG_BITS) - 1)
        flag = (value >= ends[context, 1]).astype(np.int64) + (value >= ends[context, 2])
        start = ends[context, flag]
        reader.take(own, start, ends[context, flag + 1] - start, unit)
        now = np.where(flag == 0, model.first, model.second)
        rest = np.flatnonzero(flag == 2)
        new = now[rest]
        if len(rest):
            unit = reader.range[rest] // model.total
            new = np.searchsorted(model.ends, np.minimum(reader.code[rest] // unit, model.total - 1), side="right") - 1
            reader.take(rest, model.ends[new], model.counts_at(new), unit)
            now[rest] = new
        grid[t, :k] = now
        model.outcome(now)
        model.learn(now, flag, new)
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != of_ids:
        raise ValueError("a block of ids does not decode to what was stored")
    return ids
