"""Sets of 32-bit hashes in the public portable Roaring format, for exchange with other tools."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the portable format.
COOKIE, COOKIE_NO_RUNS, NO_OFFSETS, ARRAY_MAX = 12347, 12346, 4, 4096


def encode(values: np.ndarray) -> bytes:
    """Bytes of a set of unsigned 32-bit numbers; each container takes its smallest form."""
    values = np.unique(np.asarray(values, np.uint32))
    high, low = (values >> 16).astype(np.uint16), (values & 0xFFFF).astype(np.uint16)
    keys, at = np.unique(high, return_index=True)
    parts, runs, cards = [], [], []
    for part in np.split(low, at[1:]) if len(keys) else []:
        n = len(part)
        cut = np.flatnonzero(np.diff(part.astype(np.int32)) != 1)
        starts = part[np.append(0, cut + 1)]
        lengths = part[np.append(cut, n - 1)] - starts
        plain = 2 * n if n <= ARRAY_MAX else 8192
        run = 2 + 4 * len(starts) < plain
        runs.append(run)
        cards.append(n)
        if run:
            parts.append(struct.pack("<H", len(starts)) + np.stack([starts, lengths], axis=1).astype("<u2").tobytes())
        elif n <= ARRAY_MAX:
            parts.append(part.astype("<u2").tobytes())
        else:
            bits = np.zeros(65536, np.uint8)
            bits[part] = 1
            parts.append(np.packbits(bits, bitorder="little").tobytes())
    count = len(keys)
    if any(runs):
        head = struct.pack("<HH", COOKIE, count - 1) + np.packbits(np.array(runs, np.uint8), bitorder="little").tobytes()
        offsets = count >= NO_OFFSETS
    else:
        head = struct.pack("<II", COOKIE_NO_RUNS, count)
        offsets = True
    head += np.stack([keys, np.array(cards, np.int64) - 1], axis=1).astype("<u2").tobytes() if count else b""
    if offsets and count:
        first = len(head) + 4 * count
        head += (first + np.cumsum([0, *map(len, parts[:-1])])).astype("<u4").tobytes()
    return head + b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """The sorted numbers of encode(); a ValueError for bytes that are none."""
    try:
        (cookie,) = struct.unpack_from("<I", data, 0)
        if cookie & 0xFFFF == COOKIE:
            count = (cookie >> 16) + 1
            at = 4 + (count + 7) // 8
            run = np.unpackbits(np.frombuffer(data, np.uint8, (count + 7) // 8, 4), bitorder="little")[:count]
            offsets = count >= NO_OFFSETS
        elif cookie == COOKIE_NO_RUNS:
            (count,) = struct.unpack_from("<I", data, 4)
            at, run, offsets = 8, np.zeros(count, np.uint8), True
        else:
            raise ValueError("not a portable set")
        heads = np.frombuffer(data, "<u2", 2 * count, at).reshape(count, 2).astype(np.int64)
        at += 4 * count + (4 * count if offsets else 0)
        out = []
        for (key, less), is_run in zip(heads.tolist(), run.tolist(), strict=True):
            n = less + 1
            if is_run:
                (k,) = struct.unpack_from("<H", data, at)
                pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
                low = np.concatenate([np.arange(s, s + m + 1) for s, m in pairs.tolist()]) if k else np.zeros(0, np.int64)
                at += 2 + 4 * k
            elif n <= ARRAY_MAX:
                low = np.frombuffer(data, "<u2", n, at).astype(np.int64)
                at += 2 * n
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            out.append((key << 16) + low)
        return np.concatenate(out) if out else np.zeros(0, np.int64)
    except struct.error as e:
        raise ValueError("not a portable set") from e


@F.pandas_udf(T.BinaryType())
def to_portable(sets: pd.Series) -> pd.Series:
    """Portable bytes of each set; null stays null."""
    return sets.map(lambda s: None if s is None else encode(np.asarray(s, np.int64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def from_portable(blobs: pd.Series) -> pd.Series:
    """The set of portable bytes; null for bytes that are none."""

    def read(b: bytes | None):
        try:
            return None if b is None else decode(bytes(b))
        except ValueError:
            return None

    return blobs.map(read)


def to_base64(s: Column) -> Column:
    return F.translate(F.base64(to_portable(s)), "\r\n", "")


def from_base64(text: Column) -> Column:
    """The set of base64 text; null if it is none."""
    return from_portable(F.try_to_binary(text, F.lit("base64")))


def checksum(s: Column) -> Column:
    """SHA-256 of the portable bytes, the same for any order of building."""
    return F.sha2(to_portable(s), 256)
