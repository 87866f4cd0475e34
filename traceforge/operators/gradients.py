"""A separation matrix by gradient descent over all samples: each step is one pass whose k x k sums combine in the tasks.

Samples are standardised, separated by the matrix, cut at zero, and judged by softmax cross entropy with a penalty on what
stands off the diagonal. The samples never leave the tasks; the driver holds k * k numbers and takes Adam's steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHANNELS

#: Adam's decays and its guard against division by zero; the guard of deviations.
DECAY, DECAY_SQUARES, GUARD = 0.9, 0.999, 1e-7
LEAST_DEVIATION = 1e-8


@dataclass(frozen=True)
class Separation:
    """``values @ matrix + offset`` separates raw samples; ``standard`` does standardised ones. ``losses`` holds each step's loss before it."""

    matrix: np.ndarray
    offset: np.ndarray
    standard: np.ndarray
    losses: list[float]


def loss_and_gradient(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over some samples: cross entropy, and its gradient by the matrix."""
    z = x @ s
    logits = np.maximum(z, 0.0)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -np.log(p[at, y]).sum()
    p[at, y] -= 1.0
    return float(loss), x.T @ (p * (z >= 0))


def _sums(data: DataFrame, channels: list[str], s: np.ndarray) -> np.ndarray:
    """The loss and the gradient of all samples, each task's added up before anything is sent."""
    k = len(channels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k * k)
        for b in batches:
            if b.num_rows:
                x = np.stack([b.column(c).to_numpy() for c in channels], axis=1)
                loss, g = loss_and_gradient(x, b.column("_y").to_numpy(), s)
                total += np.concatenate(([loss], g.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"_{i}" for i in range(1 + k * k)])

    parts = data.mapInArrow(run, ", ".join(f"_{i} double" for i in range(1 + k * k)))
    return np.array(parts.agg(*[F.sum(f"_{i}") for i in range(1 + k * k)]).first(), float)


def gradient_matrix(samples: DataFrame, label: str, channels: list[str] = CHANNELS, steps: int = 5000, rate: float = 0.001, penalty: float = 0.01, noise: float = 0.0, seed: int = 42) -> Separation:
    """Fit the matrix. ``label``: 0 to k - 1, the channel that should be greatest; rows with other labels or nulls have no say.

    Starts from the identity plus seeded noise of deviation ``noise``. Samples stay in the executors' memory and disks; blocks of a lost executor are computed again.
    """
    k = len(channels)
    known = samples.select(*[F.col(c).cast("double").alias(c) for c in channels], F.col(label).cast("long").alias("_y")).where(F.col("_y").between(0, k - 1)).dropna()
    stats = known.agg(F.count(F.lit(1)), *[F.avg(c) for c in channels], *[F.stddev_pop(c) for c in channels]).first()
    n = stats[0]
    if not n:
        raise ValueError("no labelled samples to fit a matrix to")
    mean, deviation = np.array(stats[1 : 1 + k], float), np.array(stats[1 + k :], float) + LEAST_DEVIATION
    data = known.select(*[((F.col(c) - float(m)) / float(d)).alias(c) for c, m, d in zip(channels, mean, deviation)], "_y").persist(StorageLevel.MEMORY_AND_DISK)
    s = np.eye(k) + noise * np.random.default_rng(seed).standard_normal((k, k))
    first, second, losses = np.zeros((k, k)), np.zeros((k, k)), []
    try:
        for step in range(1, steps + 1):
            sums = _sums(data, channels, s)
            off = s * (1 - np.eye(k))
            losses.append(float(sums[0] / n + penalty * (off**2).sum()))
            g = sums[1:].reshape(k, k) / n + 2 * penalty * off
            first, second = DECAY * first + (1 - DECAY) * g, DECAY_SQUARES * second + (1 - DECAY_SQUARES) * g**2
            s = s - rate * np.sqrt(1 - DECAY_SQUARES**step) / (1 - DECAY**step) * first / (np.sqrt(second) + GUARD)
    finally:
        data.unpersist()
    raw = s / deviation[:, None]
    return Separation(raw, -mean @ raw, s, losses)
