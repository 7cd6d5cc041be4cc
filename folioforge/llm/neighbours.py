"""The k most similar vectors of every vector by a permutation index.

Pivots are a bounded sample of the vectors, as many as ``PIVOTS`` times the root of their number. A vector is posted in the inverted files of
its ``post`` nearest pivots. A query reads the files of its ``probe`` nearest pivots. In each file the vectors are represented by the order of
the ``near`` pivots around the file's own, and are ranked by the footrule distance to the query's order, with places
counted in steps (`EDGES`), so that the distance is a number of differing bits. The best ``rerank`` times the root of the file's length are reranked by cosine; no other
cosine is computed. What a query has met in a file is left out of its later ones. Files so large that they would not fit one task are split: queries and postings of a file go to
blocks of bounded size, each pair of blocks is one group.

Vectors are unit-normalised and held as 16-bit fixed point, so cosines are exact to about 1e-4.
Equal vectors are one vector of the index; their copies come back at the end.

Defined cases: vectors that are null, of another length, all zero, or hold NaN or infinite numbers
take no part; rows with a key seen before count once; ties are ordered by key; fewer than k others
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioforge.session import cut

PIVOTS, POST, PROBE, NEAR, RERANK = 3.0, 10, 3, 768, 8.0
#: Shares of the near pivots at which places are counted one step further.
EDGES = (1 / 6, 5 / 12)
QUERY_BLOCK, POST_BLOCK = 4096, 16384
_SCALE = 32767.0


def _units(codes: pa.Array, dim: int) -> np.ndarray:
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    if not len(codes):
        return np.zeros((0, dim), np.float32)
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.int16).reshape(len(codes), dim).astype(np.float32)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)


def _rows(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(a.tobytes())])


def codes(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(uid, code): the usable vectors, one for each key."""

    def run(batches):
        for b in batches:
            v = b.column(1)
            n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            at = v.offsets.to_numpy()
            rows = np.flatnonzero((n == dim) & ~b.column(0).is_null().to_numpy(zero_copy_only=False))
            x = flat[at[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            rows, x = rows[good], x[good]
            big = np.abs(x).max(1, keepdims=True) if len(x) else np.ones((0, 1))
            x = x / big
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _rows(np.rint(x * _SCALE).astype(np.int16))], ["uid", "code"])

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(run, "uid long, code binary").groupBy("uid").agg(F.min("code").alias("code"))


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, words): the places of the pivots in the order of each vector, as bits that say which edges a place lies below.

    The footrule distance of two orders, in steps, is the number of bits that differ.
    """
    o = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    place = np.empty(o.shape, np.int32)
    np.put_along_axis(place, o, np.arange(o.shape[1], dtype=np.int32)[None, :], 1)
    bits = np.concatenate([place < max(1, round(e * o.shape[1])) for e in EDGES], 1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def ranked(q: np.ndarray, x: np.ndarray, wq: np.ndarray, wx: np.ndarray, out: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in x, cosines) of the best of each query, -1 where there are fewer.

    wq, wx: orders; out: (queries, rows) what isn't to be met. Cosines are computed of the ``rerank`` rows with the least footrule distance.
    """
    k, r = min(k, len(x)), min(rerank, len(x))
    best, how = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2, np.float32)
    wx = np.ascontiguousarray(wx.T)
    for a in range(0, len(q), 64):
        b = min(a + 64, len(q))
        if r < len(x):
            f = np.zeros((b - a, len(x)), np.uint16)
            for w in range(len(wx)):
                f += np.bitwise_count(wq[a:b, w, None] ^ wx[w])
            f[out[a:b]] = 65535
            top = np.sort(np.argpartition(f, r - 1, axis=1)[:, :r], axis=1)
        else:
            top = np.broadcast_to(np.arange(len(x)), (b - a, len(x)))
        c = np.matmul(x[top], q[a:b, :, None])[:, :, 0]
        c[np.take_along_axis(out[a:b], top, 1)] = -2
        t = np.argpartition(-c, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(c, t, 1)
        o = np.argsort(-v, axis=1, kind="stable")
        best[a:b], how[a:b] = np.take_along_axis(np.take_along_axis(top, t, 1), o, 1), np.take_along_axis(v, o, 1)
    best[how <= -1.5] = -1
    return best, how


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, dim: int = 64, pivots: float = PIVOTS, post: int = POST, probe: int = PROBE, near: int = NEAR, rerank: float = RERANK) -> DataFrame:
    """(uid, neighbour BIGINT, cosine DOUBLE, rank INT) for every usable vector of ``df``."""
    spark = df.sparkSession
    all_codes = cut(codes(df, key, vector, dim), "codes")
    salted = all_codes.groupBy("code", F.pmod(F.xxhash64("uid"), F.lit(64)).alias("s")).agg(F.slice(F.array_sort(F.collect_list("uid")), 1, k + 1).alias("u"), F.count("*").alias("n"))
    classes = cut(salted.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("u"))), 1, k + 1).alias("members"), F.sum("n").alias("n")).withColumn("uid", F.col("members")[0]), "classes")
    held = classes.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    n, copies = held.n, (held.most or 1) > 1
    number = max(1, min(n, math.ceil(pivots * math.sqrt(n))))
    post = min(post, number)
    probe = min(probe, post)
    sample = classes.select("code", F.xxhash64("uid").alias("h"), "uid").orderBy("h", "uid").limit(number).select("code").toArrow()
    shared = spark.sparkContext.broadcast(_units(sample.column("code"), dim))  # grows as the root of the rows: 24 MB for a billion

    def placed(batches):
        p = shared.value
        for b in batches:
            x = _units(b.column(1), dim)
            out = np.zeros((len(x), post), np.int32)
            for a in range(0, len(x), 4096):
                s = -(x[a : a + 4096] @ p.T)
                o = np.argpartition(s, post - 1, axis=1)[:, :post]
                out[a : a + 4096] = np.take_along_axis(o, np.argsort(np.take_along_axis(s, o, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _rows(out)], ["uid", "code", "files"])

    ordered = cut(classes.select("uid", "code").mapInArrow(placed, "uid long, code binary, files binary"), "orders")

    def counted(batches):
        x, q = np.zeros(number, np.int64), np.zeros(number, np.int64)
        for b in batches:
            f = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32).reshape(-1, post)
            x += np.bincount(f.ravel(), minlength=number)
            q += np.bincount(f[:, :probe].ravel(), minlength=number)
        some = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(x[some]), pa.array(q[some])], ["file", "x", "q"])

    sizes = ordered.select("files").mapInArrow(counted, "file long, x long, q long").groupBy("file").agg(F.sum("x").alias("x"), F.sum("q").alias("q")).collect()  # a row for each pivot
    qb, xb = np.ones(number, np.int64), np.ones(number, np.int64)
    for r in sizes:
        qb[r.file], xb[r.file] = max(1, -(-r.q // QUERY_BLOCK)), max(1, -(-r.x // POST_BLOCK))
    most_q, most_x = int(qb.max(initial=1)), int(xb.max(initial=1))
    blocks = spark.sparkContext.broadcast((qb, xb))

    def postings(batches):
        """role: -1 a posting, r a query that reads its r-th file, 100 + r both."""
        qb, xb = blocks.value
        for b in batches:
            uid = b.column(0).to_numpy()
            files = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int32).reshape(len(uid), post).astype(np.int64)
            mixed = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            rows, group, role = [], [], []

            def emit(i, f, my_q, my_x, what):
                rows.append(i)
                group.append((f * most_q + my_q) * most_x + my_x)
                role.append(np.full(len(i), what, np.int16))

            for place in range(post):
                f = files[:, place]
                my_x, my_q = mixed % xb[f], mixed % qb[f]
                plain = (qb[f] == 1) & (xb[f] == 1)
                i = np.flatnonzero(plain)
                emit(i, f[i], 0, 0, 100 + place if place < probe else -1)
                for j in range(most_q if (~plain).any() else 0):
                    i = np.flatnonzero(~plain & (qb[f] > j))
                    emit(i, f[i], j, my_x[i], -1)
                for j in range(most_x if place < probe and (~plain).any() else 0):
                    i = np.flatnonzero(~plain & (xb[f] > j))
                    emit(i, f[i], my_q[i], j, place)
            i = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(group), pa.int64()), pa.array(np.concatenate(role), pa.int16()), *(b.column(c).take(i) for c in range(3))], ["file", "role", "uid", "code", "files"])

    def search(t: pa.Table) -> pa.Table:
        p, file = shared.value, t.column("file")[0].as_py() // (most_q * most_x)
        around = p @ p[file]
        local = p[np.argpartition(-around, near - 1)[:near]] if near < len(p) else p
        role, uid = t.column("role").to_numpy(), t.column("uid").to_numpy()
        o = np.argsort(uid, kind="stable")
        role, uid = role[o], uid[o]
        v = _units(t.column("code"), dim)[o]
        files = np.frombuffer(b"".join(t.column("files").to_pylist()), np.int32).reshape(-1, post)[o]
        isq, isx = role >= 0, (role < 0) | (role >= 100)
        xu, qu, probed = uid[isx], uid[isq], role[isq] % 100
        out = qu[:, None] == xu[None, :]
        fx, fq = files[isx], files[isq]
        for e in range(int(probed.max(initial=0))):
            late = np.flatnonzero(probed > e)
            for j in range(post):
                out[late] |= fq[late, e, None] == fx[None, :, j]
        w = orders(v, local)
        best, how = ranked(v[isq], v[isx], w[isq], w[isx], out, k, math.ceil(rerank * math.sqrt(len(xu)))) if len(xu) and len(qu) else (np.full((len(qu), 0), -1), np.zeros((len(qu), 0)))
        got = best >= 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(got.sum(1))]).astype(np.int32))
        return pa.table({"uid": pa.array(qu, pa.int64()), "found": pa.ListArray.from_arrays(offsets, pa.array(xu[best[got]] if len(xu) else [], pa.int64())), "cosines": pa.ListArray.from_arrays(offsets, pa.array(how[got].astype(np.float32), pa.float32()))})

    hits = ordered.mapInArrow(postings, "file long, role short, uid long, code binary, files binary").groupBy("file").applyInArrow(search, "uid long, found array<long>, cosines array<float>")
    # at most probe times the blocks of a file lists of k each
    near_first = F.array_sort(F.flatten(F.collect_list(F.zip_with("found", "cosines", lambda u, c: F.struct((-c).alias("far"), u.alias("neighbour"))))))
    merged = hits.groupBy("uid").agg(F.slice(near_first, 1, k).alias("m"))
    pairs = merged.select("uid", F.posexplode("m").alias("place", "p")).select("uid", F.col("p.neighbour").alias("neighbour"), (-F.col("p.far")).cast("double").alias("cosine"), (F.col("place") + 1).alias("rank"))
    if not copies:
        return pairs
    pairs = cut(pairs.drop("rank"), "neighbours")
    several = classes.where("n > 1")
    # a neighbour stands for its first k + 1 copies; each copy of a vector has its other copies and its vector's neighbours
    wide = pairs.join(several.select(F.col("uid").alias("neighbour"), "members"), "neighbour", "left").select("uid", F.explode(F.coalesce("members", F.array("neighbour"))).alias("neighbour"), "cosine")
    best = Window.partitionBy("uid").orderBy(F.desc("cosine"), "neighbour")
    wide = wide.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    # a vector's lists, k + 1 members and k neighbours, are repeated for each salt, so that no task gets all copies of one vector
    lists = several.select("code", F.col("uid").alias("of"), "members").join(wide.groupBy(F.col("uid").alias("of")).agg(F.collect_list(F.struct("neighbour", "cosine")).alias("others")), "of", "left")
    lists = lists.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(63))))
    member = all_codes.withColumn("s", F.pmod(F.xxhash64("uid"), F.lit(64)).cast("int")).join(lists, ["code", "s"])
    own = F.transform(F.filter("members", lambda m: m != F.col("uid")), lambda m: F.struct(m.alias("neighbour"), F.lit(1.0).alias("cosine")))
    every = F.array_sort(F.transform(F.concat(own, F.coalesce("others", F.array().cast("array<struct<neighbour:bigint,cosine:double>>"))), lambda x: F.struct((-x["cosine"]).alias("far"), x["neighbour"].alias("neighbour"))))
    of_copies = member.select("uid", F.explode(F.slice(every, 1, k)).alias("x")).select("uid", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cosine"))
    pairs = wide.join(several.select("uid"), "uid", "left_anti").unionByName(of_copies)
    return pairs.select("uid", "neighbour", "cosine", F.row_number().over(best).alias("rank"))


def alike(neighbours: DataFrame, least: float) -> DataFrame:
    """(uid_a, uid_b): pairs of which one is among the other's neighbours with at least this cosine."""
    return neighbours.where(F.col("cosine") >= least).select(F.least("uid", "neighbour").alias("uid_a"), F.greatest("uid", "neighbour").alias("uid_b")).distinct()
