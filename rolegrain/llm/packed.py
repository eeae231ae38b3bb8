"""Sorted hashes and their counts as bytes, by ranges of hashes, so that a shuffle carries few and short rows."""

from __future__ import annotations

import numpy as np


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, of four bytes each where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, rest = steps[:1], steps[1:]
    wide = bool(len(rest)) and int(rest.max()) >= 1 << 32
    return bytes([wide]) + first.tobytes() + (rest if wide else rest.astype(np.uint32)).tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    first = np.frombuffer(packed, np.uint64, min(1, (len(packed) - 1) // 8), 1)
    rest = np.frombuffer(packed, np.uint64 if packed[0] else np.uint32, -1, 9) if len(packed) > 9 else np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([first, rest.astype(np.uint64)]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(counts) or counts.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", -1, 1).astype(np.int64)


def part_of(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The part, by the highest bits: parts are ranges of keys."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)
