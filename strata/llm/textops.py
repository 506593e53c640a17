"""Vectorised scanning of Arrow string columns: whole batches of texts as one byte array, no loop over rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Work on so many text bytes at a time; a longer single text makes a batch of its own.
BATCH_BYTES = 1 << 20


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry truth table of byte values in these inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F] by UTF-8 bytes: bytes of longer characters belong to both.
NOT_SPACE = ~table_of((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``taken`` has, whatever its case."""
    low = {c.lower() for c in taken}
    mark = "_"
    while any((mark + w).lower() in low for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more entry at the end). Null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``inside`` bytes; runs end where rows do."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def group_starts(row: np.ndarray, rows: int) -> np.ndarray:
    """For sorted row numbers: where each of ``rows`` rows begins, with the total at the end."""
    return np.searchsorted(row, np.arange(rows + 1))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of one byte array at once; slices beyond 256 bytes go to the C library one by one."""
    n = len(start)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    long = length > 256
    if long.any():
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh64_intdigest(view[s : s + k], seed) for s, k in zip(start[long].tolist(), length[long].tolist())]
        keep = np.flatnonzero(~long)
        out[keep] = xxh64(data, start[keep], length[keep], seed)
        return out
    pad = np.concatenate([data, np.zeros(16, np.uint8)])
    u64 = np.ndarray((len(data) + 8,), "<u8", pad, strides=(1,))
    u32 = np.ndarray((len(data) + 8,), "<u4", pad, strides=(1,))
    at, left = start.astype(np.int64), length.astype(np.int64)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):

        def lane(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
            return _rot(acc + x * _P2, 31) * _P1

        h = np.full(n, s + _P5, np.uint64)
        big = np.flatnonzero(left >= 32)
        if len(big):
            acc = [np.full(len(big), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            where, more = at[big].copy(), left[big].copy()
            live = np.arange(len(big))
            while len(live):
                for i in range(4):
                    acc[i][live] = lane(acc[i][live], u64[where[live] + 8 * i])
                where[live] += 32
                more[live] -= 32
                live = live[more[live] >= 32]
            g = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                g = (g ^ lane(np.zeros(len(a), np.uint64), a)) * _P1 + _P4
            h[big] = g
            at, left = at.copy(), left.copy()
            at[big], left[big] = where, more
        h += length.astype(np.uint64)
        for _ in range(3):
            m = np.flatnonzero(left >= 8)
            if not len(m):
                break
            h[m] = _rot(h[m] ^ lane(np.zeros(len(m), np.uint64), u64[at[m]]), 27) * _P1 + _P4
            at[m] += 8
            left[m] -= 8
        m = np.flatnonzero(left >= 4)
        h[m] = _rot(h[m] ^ (u32[at[m]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[m] += 4
        left[m] -= 4
        for _ in range(3):
            m = np.flatnonzero(left > 0)
            if not len(m):
                break
            h[m] = _rot(h[m] ^ (pad[at[m]].astype(np.uint64) * _P5), 11) * _P1
            at[m] += 1
            left[m] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h
