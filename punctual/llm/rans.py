"""Token-ID files: static range asymmetric numeral system over interleaved lanes.

One shared frequency table (token counts of all documents, scaled to
2**PRECISION with at least 1 for every token that occurs) serves all blocks.
A block is decoded by itself: token ``i`` belongs to lane ``i % LANES``, every
lane holds one 64-bit state, and all lanes step together in numpy.  A block
carries a checkpoint (lane states and stream position) every
CHECKPOINT_STEPS steps, so that its segments can be decoded in parallel, and a
checksum of everything after its header.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PRECISION = 20
LANES = 2048
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 19

LOW = np.uint64(1 << 31)
_P, _MASK, _W = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1), np.uint64(32)
MAGIC = b"PRN2"
HEADER = struct.Struct("<4sHHIIIII")  # magic, lanes, precision, tokens, documents, checkpoints, words, checksum


class DamagedBlock(ValueError):
    """The block's header or checksum does not hold."""


class Table:
    """Frequencies scaled to 2**PRECISION, their running sums, and slot -> symbol."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        if int(self.freq.sum()) != 1 << PRECISION:
            raise ValueError("frequencies must sum to 2**PRECISION")
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Counts to frequencies: each occurring token keeps 1 or more, the commonest absorb the rest."""
        counts = np.asarray(counts, np.float64)
        if counts.sum() == 0:
            counts = counts.copy()
            counts[0] = 1
        total = 1 << PRECISION
        f = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        excess = int(f.sum()) - total
        for i in order:
            if excess == 0:
                break
            change = min(excess, int(f[i]) - 1) if excess > 0 else excess
            f[i] -= change
            excess -= change
        return f.astype(np.uint32)


def encode_block(ids: np.ndarray, documents: np.ndarray, lengths: np.ndarray, table: Table, known: np.ndarray | None = None) -> bytes:
    """One block; ``known`` is false where a document has no id (its entry of ``documents`` is then 0)."""
    n = len(ids)
    steps = -(-n // LANES)
    pad = int(table.freq.argmax())
    grid = np.full(steps * LANES, pad, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, LANES)
    x = np.full(LANES, LOW, np.uint64)
    words, marks = [], []
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[grid[t]], table.start[grid[t]]
        full = x >= f << np.uint64(63 - PRECISION)
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> _W, x)
        q = x // f
        x = (q << _P) + (x - q * f) + c
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, x))
    words.reverse()
    marks.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]) if words else np.zeros(1, np.int64)
    body = b"".join([
        np.asarray(documents, "<i8").tobytes(), (np.ones(len(lengths), bool) if known is None else known).tobytes(), np.asarray(lengths, "<u4").tobytes(),
        np.array([at[t] for t, _ in marks], "<u4").tobytes(), b"".join(s.astype("<u8").tobytes() for _, s in marks),
        b"".join(w.tobytes() for w in words)])
    return HEADER.pack(MAGIC, LANES, PRECISION, n, len(lengths), len(marks), int(at[-1]), zlib.crc32(body)) + body


class Block:
    """A parsed block; ``segment(k)`` decodes from checkpoint ``k`` to the next, ``ids()`` all."""

    def __init__(self, data: bytes):
        if len(data) < HEADER.size:
            raise DamagedBlock("short block")
        magic, self.lanes, precision, self.n, docs, marks, words, check = HEADER.unpack_from(data)
        if magic != MAGIC or precision != PRECISION:
            raise DamagedBlock("not a block of this format")
        if zlib.crc32(memoryview(data)[HEADER.size:]) != check:
            raise DamagedBlock("checksum differs")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, count, at)
            at += a.nbytes
            return a

        self.documents, self.known, self.lengths = take("<i8", docs), take("?", docs), take("<u4", docs)
        self.positions, self.states = take("<u4", marks), take("<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.words = take("<u4", words)

    def segment(self, k: int, table: Table) -> np.ndarray:
        steps = -(-self.n // self.lanes)
        first = k * CHECKPOINT_STEPS
        last = min(steps, first + CHECKPOINT_STEPS)
        x, at = self.states[k].astype(np.uint64), int(self.positions[k])
        out = np.empty((last - first, self.lanes), np.uint16)
        words = self.words.astype(np.uint64)
        for t in range(last - first):
            slot = x & _MASK
            s = table.symbol[slot]
            out[t] = s
            x = table.freq[s] * (x >> _P) + slot - table.start[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = x[low] << _W | words[at:at + len(low)]
                at += len(low)
        return out.ravel()[:self.n - first * self.lanes]

    def ids(self, table: Table) -> np.ndarray:
        parts = [self.segment(k, table) for k in range(len(self.states))]
        return np.concatenate(parts) if parts else np.empty(0, np.uint16)
