"""Columns of integers packed into one binary value, so that a shuffle moves a few compressed blocks instead of many small rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def pack(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length. Ascending ones are stored as differences; bytes of equal weight stand together, so high zero bytes cost nothing."""
    n = len(columns[0])
    head, body = [n, len(columns)], []
    for c in columns:
        c = c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)
        u = c.view(np.uint64)
        rising = bool(n and (u[1:] >= u[:-1]).all())
        least = int(c[0] if rising else c.min()) if n else 0
        flat = np.diff(u, prepend=u[:1]) if rising else (u - np.array([least], np.int64).view(np.uint64))
        planes = np.ascontiguousarray(flat.view(np.uint8).reshape(n, 8).T)
        used = 8
        while used and not planes[used - 1].any():
            used -= 1
        head += [int(rising), least, used]
        body.append(planes[:used].tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns, as int64."""
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    head = np.frombuffer(raw, np.int64, 3 * k, 16).reshape(k, 3).tolist()
    at, out = 16 + 24 * k, []
    for rising, least, used in head:
        planes = np.zeros((8, n), np.uint8)
        planes[:used] = np.frombuffer(raw, np.uint8, used * n, at).reshape(used, n)
        at += used * n
        flat = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
        base = np.array([least], np.int64).view(np.uint64)
        out.append(((np.cumsum(flat, dtype=np.uint64) if rising else flat) + base).view(np.int64))
    return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The hash range of each 64-bit hash, so that ascending hashes have ascending shards."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
