"""The best rows of each query within a task, kept as batches come."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


class Best:
    """The k largest scores of each of n queries with their keys; scores are compared by nine decimals, and ties go by key.

    ``least`` holds what a score has to reach to be among them, so that callers pass on few; what is held stays within some k a query.
    """

    def __init__(self, n: int, k: int, least: float = -np.inf) -> None:
        self.k, self.least = k, np.full(n, least)
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.size = [0] * n

    def add(self, q: int, score: np.ndarray, key: np.ndarray) -> None:
        self.held[q].append((score, key))
        self.size[q] += len(score)
        if self.size[q] > 2 * self.k + 200:
            self._cut(q)

    def _cut(self, q: int) -> None:
        s, key = (np.concatenate(x) for x in zip(*self.held[q]))
        r = np.round(s, 9)
        if len(s) > self.k:
            at = np.flatnonzero(r >= np.partition(r, len(r) - self.k)[len(r) - self.k])
            at = at[np.lexsort((key[at], -r[at]))[: self.k]]
            s, key, self.least[q] = s[at], key[at], r[at[-1]] - 1e-9
        self.held[q], self.size[q] = [(s, key)], len(s)

    def rows(self, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of the queries a to b."""
        some = [q for q in range(a, len(self.held) if b is None else min(b, len(self.held))) if self.size[q]]
        for q in some:
            self._cut(q)
        if not some:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        s, key = (np.concatenate(x) for x in zip(*(self.held[q][0] for q in some)))
        return np.repeat(np.array(some, np.int32), [self.size[q] for q in some]), key, s


def few_tasks(rows: DataFrame) -> DataFrame:
    """Two tasks a core: each sends the best of every query, so that what is shuffled grows with their number."""
    return rows.coalesce(max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism))
