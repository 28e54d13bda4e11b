"""Fixed-width bit packing in numpy: every id takes the same number of bits, so any range can be read alone."""

from __future__ import annotations

import numpy as np


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit stream of ``ids``. Eight ids fill ``bits`` whole bytes, which are built column by column."""
    n = len(ids)
    rows = -(-n // 8)
    padded = np.zeros(rows * 8, np.uint64)
    padded[:n] = ids
    lanes = padded.reshape(rows, 8).T.copy()
    out = np.zeros((rows, bits), np.uint8)
    for byte in range(bits):
        lo = byte * 8
        column = np.zeros(rows, np.uint64)
        for lane in range(lo // bits, min(7, (lo + 7) // bits) + 1):
            shift = lane * bits - lo
            column |= lanes[lane] << np.uint64(shift) if shift >= 0 else lanes[lane] >> np.uint64(-shift)
        out[:, byte] = column & np.uint64(255)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start .. start + count``; only the bytes that hold them are touched."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    first = start // 8
    skip = start - first * 8
    rows = -(-(skip + count) // 8)
    raw = np.frombuffer(payload, np.uint8)[first * bits : (first + rows) * bits]
    if len(raw) < rows * bits:
        raw = np.concatenate([raw, np.zeros(rows * bits - len(raw), np.uint8)])
    columns = raw.reshape(rows, bits).T.astype(np.uint64)
    out = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        lo = lane * bits
        value = np.zeros(rows, np.uint64)
        for byte in range(lo // 8, (lo + bits - 1) // 8 + 1):
            shift = byte * 8 - lo
            value |= columns[byte] << np.uint64(shift) if shift >= 0 else columns[byte] >> np.uint64(-shift)
        out[:, lane] = value & mask
    return out.reshape(-1)[skip : skip + count]
