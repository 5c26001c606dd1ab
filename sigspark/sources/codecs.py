"""Signal and record codecs of the binary signal container."""

from __future__ import annotations

import zlib

import numpy as np
import zstandard

# Codec numbers in the file header.
RECORD_CODECS = {"none": 0, "zlib": 1, "zstd": 2}
SIGNAL_CODECS = {"none": 0, "svb-zd": 1}


def encode_signal(samples: np.ndarray) -> bytes:
    """Zigzag of the differences, each in one to four bytes with its size in a leading key."""
    x = samples.astype(np.int64)
    d = np.diff(x, prepend=0)
    z = ((d << 1) ^ (d >> 63)).astype(np.uint32)
    n_bytes = 1 + (z > 0xFF).astype(np.uint8) + (z > 0xFFFF) + (z > 0xFFFFFF)
    codes = np.zeros(-(-len(z) // 4) * 4, np.uint8)
    codes[:len(z)] = n_bytes - 1
    keys = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    every = z.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = every[np.arange(4) < n_bytes[:, None]]
    return np.uint32(len(z)).tobytes() + keys.tobytes() + data.tobytes()


def decode_signal(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    keys = np.frombuffer(blob, np.uint8, -(-n // 4), 4)
    n_bytes = ((keys[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n] + 1
    data = np.frombuffer(blob, np.uint8, offset=4 + len(keys))
    if int(n_bytes.sum()) != len(data):
        raise ValueError("corrupt signal block")
    every = np.zeros((n, 4), np.uint8)
    every[np.arange(4) < n_bytes[:, None]] = data
    z = every.reshape(-1).view("<u4").astype(np.int64)
    return np.cumsum((z >> 1) ^ -(z & 1)).astype(np.int16)


def compress_record(data: bytes, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.compress(data)
    return zstandard.ZstdCompressor().compress(data) if codec == "zstd" else data


def expand_record(data: bytes, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if codec == "zstd" else data


def record_head(data: bytes, codec: str, size: int = 256) -> bytes:
    """The first bytes of a record, expanding no more than needed."""
    if codec == "zlib":
        return zlib.decompressobj().decompress(data, size)
    if codec == "zstd":
        with zstandard.ZstdDecompressor().stream_reader(data) as reader:
            return reader.read(size)
    return data[:size]
