"""Static range asymmetric numeral system (rANS) over token ids, vectorised over interleaved lanes.

One static frequency table over the whole vocabulary is shared by all blocks, so that a block needs no table of its own
and can be decoded alone.

Format of a coded block, little-endian:

    u32 symbols, u16 lanes, u16 checkpoints, then for each checkpoint u32 step, u32 words read before it and the lanes'
    u64 states, and last u32 words and the u32 words.

Symbol ``i`` belongs to lane ``i % lanes``. A lane's state stays in [2**31, 2**63) and gives or takes one 32-bit word at a
time; all lanes share the one word stream, in lane order within a step. Checkpoint 0 is the start; a decoder can begin at
any checkpoint and stop at the next.
"""

from __future__ import annotations

import struct

import numpy as np

#: Frequencies add up to 2**BITS.
BITS = 20
LOW = 1 << 31


class Table:
    """``freq``: how many of the 2**20 slots each id has; at least 1, so that every id can be coded."""

    def __init__(self, freq: np.ndarray):
        if int(freq.sum()) != 1 << BITS or int(freq.min()) < 1:
            raise ValueError("frequencies must be positive and add up to 2**20")
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @classmethod
    def of_counts(cls, counts) -> Table:
        """Counts of all ids, scaled to a sum of 2**20 with at least 1 for each."""
        counts = np.asarray(counts, np.float64)
        size = 1 << BITS
        if not 0 < len(counts) < size:
            raise ValueError(f"{len(counts)} ids; a table has 1 to {size - 1}")
        freq = 1 + np.floor(counts / max(counts.sum(), 1.0) * (size - len(counts))).astype(np.int64)
        freq[int(np.argmax(counts))] += size - freq.sum()
        return cls(freq)


def checkpoints(blob: bytes) -> np.ndarray:
    """How many ids of a coded block lie before each of its checkpoints."""
    _, lanes, points = struct.unpack_from("<IHH", blob, 0)
    return np.array([struct.unpack_from("<I", blob, 8 + k * (8 + 8 * lanes))[0] * lanes for k in range(points)], np.int64)


def encode(data: np.ndarray, table: Table, lanes: int, every: int) -> bytes:
    """``data``: ids. ``every``: steps between two checkpoints."""
    n = len(data)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray, int]] = []
    bits, word_bits, written = np.uint64(BITS), np.uint64(32), 0
    freq, start = table.freq[data], table.start[data]
    limit = freq << np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        f, x = freq[at], state[: at.stop - at.start]
        full = x >= limit[at]
        if full.any():
            words.append(x[full].astype("<u4")[::-1])
            written += len(words[-1])
            x = np.where(full, x >> word_bits, x)
        q = x // f
        state[: len(x)] = (q << bits) + (x - q * f) + start[at]
        if step % every == 0:
            marks.append((step, state.astype("<u8"), written))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    if not marks:
        marks.append((0, state.astype("<u8"), 0))
    head = struct.pack("<IHH", n, lanes, len(marks))
    points = b"".join(struct.pack("<II", s, written - w) + st.tobytes() for s, st, w in reversed(marks))
    return head + points + struct.pack("<I", len(stream)) + stream.tobytes()


def decode(blob: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``first`` up to checkpoint ``last`` (None: the end), as u32."""
    n, lanes, points = struct.unpack_from("<IHH", blob, 0)
    size, at = 8 + 8 * lanes, 8
    begin, word = struct.unpack_from("<II", blob, at + first * size)
    state = np.frombuffer(blob, "<u8", lanes, at + first * size + 8).copy()
    end = -(-n // lanes) if last is None or last >= points else struct.unpack_from("<I", blob, at + last * size)[0]
    at += points * size
    (count,) = struct.unpack_from("<I", blob, at)
    stream = np.frombuffer(blob, "<u4", count, at + 4)
    out = np.empty(max(0, min(n, end * lanes) - begin * lanes), "<u4")
    bits, mask, word_bits, low = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(LOW)
    for step in range(begin, end):
        k = min(lanes, n - step * lanes)
        x = state[:k]
        slot = x & mask
        s = table.symbol[slot]
        out[(step - begin) * lanes : (step - begin) * lanes + k] = s
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        need = np.flatnonzero(x < low)
        if len(need):
            x[need] = (x[need] << word_bits) | stream[word : word + len(need)]
            word += len(need)
        state[:k] = x
    return out
