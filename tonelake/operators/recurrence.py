"""Filters whose every output depends on the one before, over chunks of a stream in parallel.

A filter's state moves affinely, so a chunk's effect on any state is known without the frames before it: see ``scan``. Within a
chunk, blocks of frames are filtered by matrix products; only the state goes from block to block in turn.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.operators.scan import scanned

#: Frames that one matrix product filters together.
BLOCK = 64
#: Frames of a stream that a task filters at a time.
CHUNK = 1 << 16


@functools.lru_cache(64)
def _block(c: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a section: outputs by inputs and by the state before, the state after a number of frames by inputs and by state."""
    b0, b1, b2, a1, a2 = c
    step = np.array([[-a1, 1.0], [-a2, 0.0]])  # transposed direct form II
    gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    pulse = np.array([b0, *((p @ gain)[0] for p in powers[: BLOCK - 1])])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    return np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0), np.array([p[0] for p in powers[:BLOCK]]), np.array([p @ gain for p in powers[:BLOCK]]), np.array(powers)


def biquad(x: np.ndarray, c: tuple[float, float, float, float, float], z: np.ndarray) -> np.ndarray:
    """A second-order section over frames by channels, BLOCK frames at a time; ``z`` (2 by channels) is read and updated."""
    by_input, by_state, into, powers = _block(tuple(c))
    y = np.empty_like(x)
    whole = len(x) // BLOCK * BLOCK
    parts = x[:whole].reshape(-1, BLOCK, x.shape[1])
    out = by_input @ parts
    left = np.einsum("kn,bkc->bnc", into[::-1], parts)  # what each block adds to the state after it
    for k in range(len(parts)):
        out[k] += by_state @ z
        z[:] = powers[BLOCK] @ z + left[k]
    y[:whole] = out.reshape(whole, x.shape[1])
    if n := len(x) - whole:
        y[whole:] = by_input[:n, :n] @ x[whole:] + by_state[:n] @ z
        z[:] = powers[n] @ z + np.einsum("kn,kc->nc", into[:n][::-1], x[whole:])
    return y


def _cascade(x: np.ndarray, sections: list[tuple], z: np.ndarray) -> np.ndarray:
    """Frames by channels through all sections; ``z`` (sections by 2 by channels) is read and updated."""
    for c, state in zip(sections, z):
        x = biquad(x, c, state)
    return x


def transition(sections: list[tuple], n: int) -> np.ndarray:
    """What ``n`` frames of silence make of a cascade's state (2 numbers a section): a matrix."""
    size = 2 * len(sections)
    unit = np.eye(size).reshape(len(sections), 2, size).copy()
    _cascade(np.zeros((1, size)), sections, unit)
    return np.linalg.matrix_power(unit.reshape(size, size), n)


def per_stream(pcm: DataFrame, sections: list[tuple], pre_gain: float, chunk: int = CHUNK) -> DataFrame:
    """(stream_id, frame_no, left, right) through a cascade of sections, held within 32 bits.

    A chunk of frames maps the cascade's state affinely: its summary is the state that it ends in from silence and its
    number of frames, whose transition matrix says what becomes of any other state.
    """
    size = 2 * len(sections)

    def samples(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(c).to_numpy() for c in ("left", "right")], axis=1) * float(pre_gain)

    def summarise(table: pa.Table) -> bytes:
        z = np.zeros((len(sections), 2, 2))
        _cascade(samples(table), sections, z)
        return np.array([len(table), *z.ravel()]).tobytes()

    def advance(state: bytes | None, summary: bytes) -> bytes:
        n, *end = np.frombuffer(summary)
        end = np.array(end).reshape(size, 2)
        return (end if state is None else end + transition(sections, int(n)) @ np.frombuffer(state).reshape(size, 2)).tobytes()

    def run(table: pa.Table, start: bytes | None) -> list[pa.Array]:
        z = np.zeros((len(sections), 2, 2)) if start is None else np.frombuffer(start).reshape(len(sections), 2, 2).copy()
        out = np.clip(_cascade(samples(table), sections, z), -(2.0**31), 2.0**31 - 1).astype(np.int64).astype(np.int32)
        return [pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())]

    rows = pcm.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("frame_no").cast("long").alias("frame_no"), "left", "right")
    out = scanned(rows, ("stream_id",), "frame_no", chunk, summarise, advance, run, T.StructType.fromDDL("out_left int, out_right int"))
    return out.select("stream_id", "frame_no", F.col("out_left").alias("left"), F.col("out_right").alias("right"))
