"""Exact vector search for a stated set of queries, and offline embeddings."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.operators.best import Best, few_tasks
from folioforge.session import cut_by
from folioforge.settings import DEFAULT

#: Queries that are held against all rows at once; more go in further blocks.
QUERIES = 4096
#: Rows of a cell that are read at once, in sixteenths.
BLOCK = 1024


def normalized(v: Column) -> Column:
    """A vector of unit length; null for all-zero ones."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float")))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of the usable vectors: dim finite numbers, not all zero; rows of unit length."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(n == dim)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[column.offsets.to_numpy()[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    at, x = at[good], x[good]
    return at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(queries: DataFrame, qid: str, vector: str, dim: int) -> Iterator[tuple[list[str], np.ndarray]]:
    ids: list[str] = []
    rows: list[list[float]] = []
    for r in queries.select(F.col(qid).cast("string"), F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).toLocalIterator():
        if len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]):
            ids.append(r[0])
            rows.append(r[1])
        if len(ids) == QUERIES:
            yield ids, np.array(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows)


def knn(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, qid: str = "qid", query_vector: str = "query_vector", dim: int = DEFAULT.dim) -> DataFrame:
    """(qid, key, score, rank): the k rows with the largest (1 + cosine) / 2 of each query.

    A block of queries is multiplied with every batch of rows; only each task's k best leave it, of two tasks a core. Rows are filtered before.
    """
    if k > DEFAULT.result_window:
        raise ValueError(f"k is above the result window of {DEFAULT.result_window}")
    spark = rows.sparkSession
    source = few_tasks(rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")))
    out = None
    for ids, q in _blocks(queries, qid, query_vector, dim):
        shared = spark.sparkContext.broadcast(q / np.linalg.norm(q, axis=1, keepdims=True))

        def run(batches, shared=shared):
            q = shared.value
            kept = Best(len(q), k)
            for b in batches:
                at, x = _matrix(b.column(1), dim)
                names = b.column(0).to_numpy(zero_copy_only=False)[at]
                for a in range(0, len(x), 2048):
                    s, some = (1 + q @ x[a : a + 2048].T) / 2, names[a : a + 2048]
                    for i, row in enumerate(s):
                        hit = np.flatnonzero(row >= kept.least[i])
                        if len(hit):
                            kept.add(i, row[hit], some[hit])
            for a in range(0, len(q), 1000):
                i, some, score = kept.rows(a, a + 1000)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(some, pa.int64()), pa.array(score, pa.float64())], ["_q", key, "score"])

        w = Window.partitionBy("_q").orderBy(F.round("score", 9).desc(), key)
        best = source.mapInArrow(run, f"_q int, `{key}` long, score double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"_q": pa.array(range(len(ids)), pa.int32()), "qid": pa.array(ids, pa.string())}))
        part = best.join(names, "_q").select("qid", key, "score", "rank")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"qid string, `{key}` long, score double, rank int") if out is None else out


class VectorIndex:
    """An approximate index for queries: vectors in cells around sampled centers, of which a query reads the nearest few.

    Centers are 4 sqrt(n) of the vectors, in the order of a hash, so that cells hold about sqrt(n) / 4 rows; a cell of over ``BLOCK`` rows is read in
    blocks. Defined cases: as of `knn`; an empty table gives an empty index.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, dim: int = DEFAULT.dim, centers: float = 4.0) -> None:
        self.key, self.dim, self.spark = key, dim, rows.sparkSession
        source = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
        n = source.count()
        number = math.ceil(centers * math.sqrt(n))
        sample = source.select("v", F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(number).select("v").toArrow().column("v").combine_chunks()
        self.centers = _matrix(sample, dim)[1].astype(np.float32)  # grows as the root of the rows
        shared = self.spark.sparkContext.broadcast(self.centers)

        def place(batches):
            c = shared.value
            for b in batches:
                at, x = _matrix(b.column(1), dim)
                cell = np.argmax(x.astype(np.float32) @ c.T, axis=1) if len(x) and len(c) else np.zeros(0, np.int64)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b.column(0).take(pa.array(at)), unit], ["cell", key, "v"])

        self.rows = cut_by(source.mapInArrow(place, f"cell long, `{key}` long, v array<float>"), "cell", "cells")

    def search(self, queries: DataFrame, k: int, probes: int = 64, qid: str = "qid", query_vector: str = "query_vector") -> DataFrame:
        """(qid, key, score, rank) as of `knn`, of the rows in each query's ``probes`` nearest cells."""
        key, dim, shared = self.key, self.dim, self.spark.sparkContext.broadcast(self.centers)

        def cells(batches):
            c = shared.value
            for b in batches:
                at, x = _matrix(b.column(1), dim)
                m = min(probes, len(c))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :m] if m else np.zeros((len(x), 0), np.int64)
                i = np.repeat(np.arange(len(x)), m)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * dim), pa.array(x[i].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int64()), b.column(0).take(pa.array(at[i])), unit], ["cell", "qid", "q"])

        asked = queries.select(F.col(qid).cast("string"), F.col(query_vector).cast("array<double>")).mapInArrow(cells, "cell long, qid string, q array<double>")
        block = F.pmod(F.xxhash64(key), F.col("blocks"))
        sizes = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / (BLOCK * 16)).alias("blocks"))
        held = self.rows.join(sizes, "cell").withColumn("block", block)
        wanted = asked.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def best(q: pa.Table, rows: pa.Table) -> pa.Table:
            names = rows.column(key).to_numpy()
            x = rows.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            y = q.column("q").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            s = (1 + y @ x.T) / 2 if len(x) and len(y) else np.zeros((len(y), 0))
            m = min(k, s.shape[1])
            o = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.zeros((len(y), 0), np.int64)
            return pa.table({"qid": q.column("qid").combine_chunks().take(pa.array(np.repeat(np.arange(len(y)), m))), key: names[o].ravel(), "score": np.take_along_axis(s, o, 1).ravel()})

        found = wanted.select("cell", "block", "qid", "q").groupBy("cell", "block").cogroup(held.select("cell", "block", key, "v").groupBy("cell", "block")).applyInArrow(best, f"qid string, `{key}` long, score double")
        w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_embedding(text: str, dim: int, query: bool = False) -> np.ndarray:
    """A deterministic stand-in for a model: hashed words, queries and passages apart by a marker word."""
    v = np.zeros(dim)
    for w in [("query:" if query else "passage:"), *text.lower().split()]:
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] & 1 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else np.eye(1, dim)[0]


def embed(df: DataFrame, text: str, to: str, dim: int = DEFAULT.dim, query: bool = False, embedder=hash_embedding, failed: str | None = None, tries: int = 3) -> DataFrame:
    """Adds a vector column by any embedder (text, dim, query) -> array; null texts get null.

    A text is tried up to ``tries`` times, with a doubling wait after errors of the connection; one that fails gets null, and its reason in the column ``failed`` if named.
    """

    @F.pandas_udf("vector array<float>, reason string")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(t):
            for n in range(tries):
                try:
                    return (None if t is None else embedder(t, dim, query).astype(np.float32)), None
                except OSError as e:  # connections and time-outs
                    why = e
                    if n + 1 < tries:
                        time.sleep(0.1 * 2**n)
                except Exception as e:  # noqa: BLE001 - a text that can't be embedded fails alone
                    return None, f"{type(e).__name__}: {e}"
            return None, f"{type(why).__name__}: {why}"

        both = [one(t) for t in s]
        return pd.DataFrame({"vector": [v for v, _ in both], "reason": [w for _, w in both]})

    out = df.withColumn("_embedded", run(F.col(text))).withColumn(to, F.col("_embedded.vector"))
    return (out if failed is None else out.withColumn(failed, F.col("_embedded.reason"))).drop("_embedded")


def embed_distinct(df: DataFrame, text: str, to: str, dim: int = DEFAULT.dim, embedder=hash_embedding) -> DataFrame:
    """As `embed`, each distinct text once; for titles, which repeat in all chunks of a document."""
    once = embed(df.select(F.col(text).alias("_t")).where("_t is not null").distinct(), "_t", to, dim, False, embedder)
    return df.join(once, df[text] == once["_t"], "left").drop("_t")
