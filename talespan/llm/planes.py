"""Integer blocks as byte or bit planes, each plane compressed with zstandard."""

from __future__ import annotations

import numpy as np
import zstandard

LEVEL = 1


def to_planes(block: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of unsigned integers, lowest first: plane b holds byte (or bit) b of every integer."""
    width = block.dtype.itemsize
    by_byte = np.ascontiguousarray(block).view(np.uint8).reshape(len(block), width).T
    if not bits:
        return [np.ascontiguousarray(p).tobytes() for p in by_byte]
    return [np.packbits((p >> np.uint8(b)) & np.uint8(1)).tobytes() for p in by_byte for b in range(8)]


def from_planes(planes: list[bytes], count: int, dtype: type, bits: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    out = np.zeros((count, width), dtype=np.uint8)
    for i, plane in enumerate(planes):
        if bits:
            out[:, i // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count) << np.uint8(i % 8)
        else:
            out[:, i] = np.frombuffer(plane, np.uint8)
    return out.reshape(-1).view(dtype)


def pack(block: np.ndarray, bits: bool = False) -> bytes:
    """count, number of planes, the compressed size of each plane, then the planes."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    parts = [squeeze.compress(p) for p in to_planes(block, bits)]
    head = np.array([len(block), len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return b"".join([head, *parts])


def unpack(data: bytes, dtype: type, bits: bool = False, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers and where the next block begins."""
    count, n = np.frombuffer(data, "<u4", 2, at)
    sizes = np.frombuffer(data, "<u4", int(n), at + 8)
    at += 8 + 4 * int(n)
    open_ = zstandard.ZstdDecompressor()
    planes = []
    for s in sizes.tolist():
        planes.append(open_.decompress(data[at : at + s]))
        at += s
    return from_planes(planes, int(count), dtype, bits), at


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    steps, at = unpack(data, np.uint64, at=at)
    return np.cumsum(steps, dtype=np.uint64), at
