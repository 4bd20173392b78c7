"""A static range asymmetric numeral system over integer symbols, vectorised over blocks, lanes and segments.

A block of symbols is dealt to ``LANES`` interleaved states (symbol i to lane i mod LANES), which share one stream of 32-bit
words. After every ``STEPS`` symbols a lane the encoder notes a checkpoint: the states and the place in the stream, so that
a reader may begin there. Blocks are independent of each other; all share one frequency table.
"""

from __future__ import annotations

import numpy as np

LANES, STEPS, BITS = 64, 256, 20
SEGMENT = LANES * STEPS
_U = np.uint64
_LOW = _U(1 << 32)


class Frequencies:
    """Frequencies of symbols out of 2**bits, one at least for each that occurs; the last slot stays free."""

    def __init__(self, freq: np.ndarray):
        self.bits = max(BITS, len(freq).bit_length() + 3)
        if freq.sum() >= 1 << self.bits:
            raise ValueError("frequencies add up to more than the table has")
        self.freq = freq.astype(_U)
        self.below = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(_U) if len(freq) else self.freq
        self.symbol = np.zeros(1 << self.bits, np.uint16 if len(freq) <= 1 << 16 else np.uint32)
        self.symbol[: int(freq.sum())] = np.repeat(np.arange(len(freq)), freq)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Frequencies:
        total, there = counts.sum(), counts > 0
        slots = 1 << max(BITS, len(counts).bit_length() + 3)
        freq = np.where(there, np.maximum(1, np.floor(counts / max(total, 1) * (slots - there.sum() - 1))), 0).astype(np.int64)
        if len(freq) and total:
            freq[counts.argmax()] += slots - 1 - freq.sum()
        return cls(freq)


def encode(table: Frequencies, blocks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of blocks (equally many symbols, a multiple of LANES) its states and its places in the stream at every
    checkpoint, and the stream."""
    n, steps = len(blocks), blocks.shape[1] // LANES
    symbols = np.ascontiguousarray(blocks.reshape(n, steps, LANES).transpose(1, 0, 2))
    if blocks.size and not table.freq[symbols].all():
        raise ValueError("a symbol has no frequency")
    bits, x = _U(table.bits), np.full((n, LANES), _LOW)
    words, full = np.zeros((steps, n, LANES), np.uint32), np.zeros((steps, n, LANES), bool)
    states = np.zeros((-(-steps // STEPS), n, LANES), _U)
    for s in range(steps - 1, -1, -1):
        f = table.freq[symbols[s]]
        over = x >= f << (_U(64) - bits)
        words[s], full[s] = x.astype(np.uint32), over
        x = np.where(over, x >> _U(32), x)
        q = x // f
        x = (q << bits) + (x - q * f) + table.below[symbols[s]]
        if s % STEPS == 0:
            states[s // STEPS] = x
    sent = np.concatenate([np.zeros((1, n), np.int64), np.cumsum(full.sum(axis=2), axis=0)])[:steps:STEPS]
    return [(states[:, b], sent[:, b].astype(np.uint32), words[:, b][full[:, b]]) for b in range(n)]


def decode(table: Frequencies, states: np.ndarray, at: np.ndarray, stream: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of segments of equally many steps, one row each, and their states behind the last: states (segments, LANES)
    and places in the stream at the checkpoints that they begin with."""
    x, at, bits, mask = states.copy(), at.astype(np.int64)[:, None], _U(table.bits), _U((1 << table.bits) - 1)
    out = np.empty((steps, *x.shape), table.symbol.dtype)
    stream = np.append(stream.astype(_U), _U(0))  # so that a place behind the last word exists
    for s in range(steps):
        slot = x & mask
        out[s] = symbol = table.symbol[slot]
        x = table.freq[symbol] * (x >> bits) + slot - table.below[symbol]
        need = x < _LOW
        place = np.cumsum(need, axis=1)
        x = np.where(need, (x << _U(32)) | stream[np.minimum(at + place - 1, len(stream) - 1)], x)
        at = at + place[:, -1:]
    return out.transpose(1, 0, 2).reshape(len(x), steps * LANES), x
