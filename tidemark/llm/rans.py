"""Static range asymmetric numeral system (rANS) for token ids, in numpy.

A shared table gives every id that occurs a frequency; the frequencies sum to ``2**bits``.  A block encodes its
ids with ``lanes`` interleaved 64-bit states (id i goes to lane i % lanes; states in [2^31, 2^63), 32-bit words),
so that each step codes one id of every lane at once.  Blocks know nothing of each other.

Block, little-endian:  ``TMR1`` | n_ids u32 | lanes u32 | bits u32 | table_crc u32 | ids_crc u32 | n_checkpoints u32
| n_words u32 | per checkpoint: word offset u32, then lanes states u64 | words u32 ... | crc32 of all before u32.

Checkpoint c holds the states and the place in the words before step ``c * CHECKPOINT_STEPS``; decoding can start
at any of them, so the parts of a block decode in parallel and a short range needs no whole block.  The first is
the block's start.  ``table_crc`` names the frequency table, ``ids_crc`` is the CRC-32 of the ids as u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMR1"
LANES = 4096
CHECKPOINT_STEPS = 256
_HEAD = "<4s7I"
_HEAD_SIZE = struct.calcsize(_HEAD)
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Shared frequency table: ``symbols`` ascending, their ``freq``; the sum is ``2**bits``."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int):
        self.symbols, self.freq, self.bits = np.asarray(symbols, "<u4"), np.asarray(freq, "<u4"), int(bits)
        if len(self.freq) and int(self.freq.sum(dtype=np.uint64)) != 1 << self.bits:
            raise ValueError("frequencies do not sum to 2**bits")
        self.crc = zlib.crc32(self.freq.tobytes(), zlib.crc32(self.symbols.tobytes()))
        self._cum = (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint64)
        top = int(self.symbols[-1]) + 1 if len(self.symbols) else 0
        self._f, self._c = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self._f[self.symbols], self._c[self.symbols] = self.freq, self._cum
        self._slots = None

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Frequencies in proportion to ``counts``, each at least 1, by largest remainder (ties: smaller id)."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, np.int64)[order]
        if not len(symbols):
            return cls(symbols, counts, 16)
        bits = min(31, max(16, len(symbols).bit_length() + 3))
        share = counts.astype(np.float64) * ((1 << bits) / counts.sum())
        freq = np.maximum(1, np.floor(share)).astype(np.int64)
        rest = (1 << bits) - int(freq.sum())
        if rest > 0:
            freq[np.argsort(freq - share, kind="stable")[:rest]] += 1
        if rest < 0:  # many rare ids were lifted to 1: take from the others in proportion, then from the greatest
            spare = freq - 1
            freq -= np.floor(spare * (-rest / spare.sum())).astype(np.int64)
            rest = (1 << bits) - int(freq.sum())
            freq[np.argsort(-freq, kind="stable")[:-rest or 0]] -= 1
        return cls(symbols, freq, bits)

    def _slot(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq)
        return self._slots


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> bytes:
    """One block; every id must be in the table."""
    ids = np.asarray(ids)
    n = len(ids)
    w = max(1, min(lanes, n))
    steps = -(-n // w)
    bits, up = np.uint64(table.bits), np.uint64(63 - table.bits)
    if n and (int(ids.max()) >= len(table._f) or not table._f[ids].all()):
        raise ValueError("an id is not in the frequency table")
    f, c = table._f[ids], table._c[ids]
    x = np.full(w, _LOW, np.uint64)
    words, marks, out = [], [], 0  # the last step first
    for t in range(steps - 1, -1, -1):
        a, b = t * w, min(n, (t + 1) * w)
        y, ft = x[:b - a], f[a:b]
        full = y >= (ft << up)
        if full.any():
            over = y[full]
            words.append(over.astype("<u4"))  # the low 32 bits
            out += len(over)
            y[full] = over >> _WORD
        q = y // ft
        x[:b - a] = (q << bits) + (y - q * ft) + c[a:b]
        if t % checkpoint_steps == 0:
            marks.append((out, x.astype("<u8").tobytes()))
    if not marks:
        marks.append((0, x.astype("<u8").tobytes()))
    body = [struct.pack(_HEAD, MAGIC, n, w, table.bits, table.crc, zlib.crc32(ids.astype("<u4").tobytes()), len(marks), out)]
    for emitted, states in reversed(marks):
        body += [struct.pack("<I", out - emitted), states]
    body += [x.tobytes() for x in reversed(words)]
    block = b"".join(body)
    return block + struct.pack("<I", zlib.crc32(block))


def n_ids(block: bytes) -> int:
    return struct.unpack_from(_HEAD, block)[1]


def decode(block: bytes, table: Table, start: int = 0, stop: int | None = None,
           checkpoint_steps: int = CHECKPOINT_STEPS) -> np.ndarray:
    """Ids [start, stop) of a block, from the last checkpoint before ``start``; raises ValueError on damage."""
    if len(block) < _HEAD_SIZE + 4 or block[:4] != MAGIC or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("damaged token block")
    _, n, w, bits, table_crc, ids_crc, n_marks, n_words = struct.unpack_from(_HEAD, block)
    if (bits, table_crc) != (table.bits, table.crc):
        raise ValueError("the block was encoded with another frequency table")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    first = start // w // checkpoint_steps
    at = _HEAD_SIZE + first * (4 + 8 * w)
    p = struct.unpack_from("<I", block, at)[0]
    x = np.frombuffer(block, "<u8", w, at + 4).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _HEAD_SIZE + n_marks * (4 + 8 * w)).astype(np.uint64)
    slot_of, freq, cum = table._slot(), table.freq.astype(np.uint64), table._cum
    mask, b64 = np.uint64((1 << bits) - 1), np.uint64(bits)
    got = []
    for t in range(first * checkpoint_steps, -(-stop // w)):
        k = min(n, (t + 1) * w) - t * w
        y = x[:k]
        slot = y & mask
        s = slot_of[slot]
        got.append(s)
        y = freq[s] * (y >> b64) + slot - cum[s]
        low = y < _LOW
        m = int(np.count_nonzero(low))
        if m:
            y[low] = (y[low] << _WORD) | words[p:p + m]
            p += m
        x[:k] = y
    base = first * checkpoint_steps * w
    ids = table.symbols[np.concatenate(got)[start - base:stop - base]]
    if start == 0 and stop == n and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("token block does not decode to the ids it was made of")
    return ids
