"""Training of rating factors: gradients summed by the cluster, steps taken by the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Adam:
    rate: float = 0.05
    state: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    count: int = 0

    def step(self, values: dict[str, np.ndarray], slopes: dict[str, np.ndarray], clip: float | None = None) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
        scale = min(1.0, clip / norm) if clip and norm else 1.0
        self.count += 1
        for name, g in slopes.items():
            m, v = self.state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g * scale - m)
            v += 0.001 * ((g * scale) ** 2 - v)
            values[name] -= self.rate * (m / (1 - 0.9**self.count)) / (np.sqrt(v / (1 - 0.999**self.count)) + 1e-8)


@dataclass
class Schedule:
    """Halts when nothing improves: after `patience` steps without a better score the rate decays, at the least rate training ends."""

    patience: int = 5
    decay: float = 0.5
    least: float = 1e-3
    best: float = float("inf")
    waited: int = 0

    def stop(self, score: float, adam: Adam) -> bool:
        if score < self.best:
            self.best, self.waited = score, 0
            return False
        self.waited += 1
        if self.waited >= self.patience:
            if adam.rate <= self.least:
                return True
            adam.rate, self.waited = max(self.least, adam.rate * self.decay), 0
        return False


def fit_bilinear(rows: DataFrame, dim: int, steps: int = 30, rate: float = 0.05, clip: float | None = 1.0, valid: DataFrame | None = None, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """A dim x dim map M so that a M b approximates the standardised truth; rows are (a, b, truth), vectors and a number.

    Each step is one aggregate: every partition sums its own gradient over Arrow batches, so that dim * dim numbers a
    partition reach the driver, whatever the number of rows.
    """
    values = {"m": np.random.default_rng(seed).normal(0, 0.1, (dim, dim))}
    adam, schedule, scores = Adam(rate), Schedule(), []
    spark = rows.sparkSession

    def summed(data: DataFrame) -> tuple[np.ndarray, float, int]:
        sent = spark.sparkContext.broadcast(values["m"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, loss, n = np.zeros((dim, dim)), 0.0, 0
            for batch in batches:
                a, b = (np.asarray(batch.column(k).flatten(), np.float64).reshape(-1, dim) for k in (0, 1))
                error = np.einsum("ni,ij,nj->n", a, sent.value, b) - batch.column(2).to_numpy()
                g += np.einsum("n,ni,nj->ij", error, a, b)
                loss, n = loss + float(error @ error), n + len(error)
            yield pa.record_batch([pa.array(np.arange(dim * dim + 2)), pa.array(np.r_[g.ravel(), loss, float(n)])], names=["i", "x"])

        found = data.select("a", "b", F.col("truth").cast("double")).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(dim * dim + 2)
        for r in found:
            flat[r["i"]] = r["x"]
        sent.unpersist()
        return flat[:-2].reshape(dim, dim), flat[-2], int(flat[-1])

    for _ in range(steps):
        g, loss, n = summed(rows)
        if not n:
            break
        if valid is not None:
            _, loss, n_valid = summed(valid)
            scores.append(float(np.sqrt(loss / max(1, n_valid))))
        else:
            scores.append(float(np.sqrt(loss / n)))
        if schedule.stop(scores[-1], adam):
            break
        adam.step(values, {"m": g / n}, clip)
    return values["m"], scores
