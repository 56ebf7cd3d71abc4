"""Packed arrays on their way between tasks: one row for each task and bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def sliced(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of ``data`` cut at ``ends`` (in elements)."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.dtype.itemsize
    assert offsets[-1] < 2**31
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def planes(data: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """The ``width`` low bytes of each number, byte by byte, cut at ``ends``: bytes that are
    mostly zero stand together, where the shuffle's compression removes them."""
    low = np.ascontiguousarray(data).view(np.uint8).reshape(len(data), -1)[:, :width]
    return pa.array([low[a:b].T.tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())


def unplaned(data: bytes, width: int, dtype: str) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(dtype).ravel()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of elements that are equal in all keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)
