"""Containers of chunked sets: up to 65536 low halves of 32-bit hashes as the bytes of the public portable format.

A container of at most 4096 members is their sorted 16-bit numbers, a larger one a bitmap of 8192 bytes. All functions
take the containers of a whole batch at once; a key is the container's place in the batch above the low half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from valprint.functions.codec import ARRAY_MAX

#: Bytes of a bitmap, bits of a low half.
BITMAP, LOW = 8192, 16


def _bounds(data: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, raw


def expand(cards: np.ndarray, data: pa.BinaryArray) -> np.ndarray:
    """The sorted keys of a batch of containers without nulls."""
    if not len(data):
        return np.zeros(0, np.int64)
    offsets, raw = _bounds(data)
    whole = np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), "<u2")
    row = np.repeat(np.arange(len(data)), np.diff(offsets) // 2)
    dense = np.asarray(cards) > ARRAY_MAX
    if not dense.any():
        return (row << LOW) | whole
    plain = ~dense[row]
    keys = (row[plain] << LOW) | whole[plain]
    bits = np.frombuffer(whole[~plain].tobytes(), np.uint8).reshape(-1, BITMAP)
    which, low = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
    return np.sort(np.concatenate([keys, (np.flatnonzero(dense)[which] << LOW) | low]))


def pack(keys: np.ndarray, n: int) -> tuple[np.ndarray, pa.BinaryArray]:
    """Members and bytes of n containers from sorted distinct keys; a container without any has no bytes."""
    row, low = keys >> LOW, (keys & 0xFFFF).astype("<u2")
    cards = np.bincount(row, minlength=n)
    dense = np.flatnonzero(cards > ARRAY_MAX)
    ends = np.cumsum(cards)
    if not len(dense):
        offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
        return cards, pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(low.tobytes())])
    parts = [low[e - c : e].tobytes() for c, e in zip(cards.tolist(), ends.tolist(), strict=True)]
    for k in dense.tolist():
        bits = np.zeros(8 * BITMAP, np.uint8)
        bits[low[ends[k] - cards[k] : ends[k]]] = 1
        parts[k] = np.packbits(bits, bitorder="little").tobytes()
    return cards, pa.array(parts, pa.binary())


def from_words(row: np.ndarray, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sorted keys of 64-bit words: word is the upper ten bits of the low halves whose lower six are set in bits."""
    order = np.lexsort((word, row))
    which, place = np.nonzero(np.unpackbits(bits[order].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return (row[order][which].astype(np.int64) << LOW) | (word[order][which].astype(np.int64) << 6) | place


def combine(how: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the intersection, union or difference of two batches, container by container."""
    if how == "intersect":
        return np.intersect1d(a, b, assume_unique=True)
    if how == "union":
        return np.union1d(a, b)
    if how == "difference":
        return np.setdiff1d(a, b, assume_unique=True)
    raise ValueError(f"no such combination: {how}")
