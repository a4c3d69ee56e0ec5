"""Numpy views of Arrow string arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more at the end). No nulls."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each begins (one more at the end). No nulls."""
    raw, _ = raw_bytes(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    return points, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of characters other than ASCII white space, and where each text's begin (one more at the end). No nulls."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(real).dictionary_encode(), np.concatenate([[0], kept[ends]])


def mixed(x: np.ndarray) -> np.ndarray:
    """Scattered 64-bit values, one for each different input."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def owners(at: np.ndarray) -> np.ndarray:
    """For each item, the number of the text it is in."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])
