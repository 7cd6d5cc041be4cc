"""Groups of texts that repeat one another apart from small edits, insertions or changed order.

1. Words become 64-bit values once; texts with the same words are one class from there on.
2. Order MinHash: a sketch holds the ``DEPTH`` smallest k-mers of a text under one hash function. In ``ORDERED`` sketches k-mers
   are labelled by their occurrence and kept in text order, which follows the edit similarity. As links are defined by the Jaccard
   of distinct k-mers, which knows neither order nor repeats, ``PLAIN`` further sketches hold distinct k-mers without order. One
   equal sketch makes two texts candidates: of a Jaccard of 0.6 in plain prose all 64 differ with a chance of 2e-7, and the
   40 plain ones alone differ with 6e-5.
3. The members of one sketch's bucket meet with parity bitmaps of their k-mers: two bitmaps differ in at most as many bits
   as the texts in k-mers, so that the bound is exact and drops no link. Buckets of more than ``BUCKET`` members are first parted by deeper sketches
   (``DEEPER`` for each of up to ``LEVELS`` levels); what stays large is compared in salted blocks, whole.
4. A candidate is decided by the exact Jaccard of its distinct k-mers. Banded alignments along the diagonals that shared k-mers lie
   on tell how much of both texts they cover (`NearCopies.alignments`); they decide nothing, as moved passages would be lost.

A sketch that many texts of one batch share is spread before it is shuffled, so that no task gets a hot bucket whole. All hash
functions are fixed, so that the rows don't depend on partitions.

Defined cases: null texts and texts of under ``min_words`` words are alike to none; ids stored twice
count once; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.session import cut, cut_by

#: Sketches with and without order, and k-mers of each.
ORDERED, PLAIN, DEPTH = 24, 40, 3
#: Members of a bucket that are compared as one block.
BUCKET = 2_000
#: Sketches, k-mers of each and levels by which larger buckets are parted; families of hash functions among which buckets are shared out,
#: so that two texts that miss each other in one bucket meet in the next.
DEEPER, DEEPER_DEPTH, LEVELS, FAMILIES = 8, 2, 3, 8
#: Texts of up to FEW distinct k-mers are also in the buckets of FEWER sketches of one k-mer each, as they may hold less than DEPTH.
FEW, FEWER = 13, 8
#: 64-bit parts of the small and of the large bitmap.
SMALL, LARGE = 4, 16
BAND = 8
#: Member pairs of two classes up to which all are written; above, those of the representatives of either.
EXPAND = 10_000

_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 20) - 1)
_ONES = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def kmers(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of all k-mers in text order, number in each text) of texts laid end to end."""
    n = np.maximum(ends - starts - k + 1, 0)
    h = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _A + _mix(w[j : len(w) - k + 1 + j] + np.uint64(j + 1) * _C)
    h = _mix(h)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return h[at], n


def word_table(df: DataFrame, min_words: int) -> DataFrame:
    """(kind, id, grp, text_key, words BINARY) of the texts that are long enough; df: kind, id, grp, text."""

    def run(batches):
        memo: dict[str, int] = {}
        for b in batches:
            keys, rows, data = [], [], []
            if len(memo) > 2_000_000:
                memo.clear()
            kinds = b.column(0).to_pylist()
            for i, t in enumerate(b.column(3).to_pylist()):
                w = words_of(t) if t else ()
                if len(w) < min_words:
                    continue
                for x in set(w):
                    if x not in memo:
                        memo[x] = xxhash.xxh64_intdigest(x)
                v = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)).tobytes()
                rows.append(i)
                data.append(v)
                keys.append(xxhash.xxh3_64_intdigest(v + (kinds[i] or "").encode()) - 2**63)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows, pa.int64())) for c in range(3)), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["kind", "id", "grp", "text_key", "words"])

    return df.select("kind", F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp"), "text").where("id is not null").mapInArrow(run, "kind string, id long, grp string, text_key long, words binary")


class _Texts:
    """The k-mers of a batch of texts, laid end to end; texts without k-mers are left out of ``rows``."""

    def __init__(self, raw: list[bytes], k: int) -> None:
        n = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
        self.rows = np.flatnonzero(n >= k)
        n, ends = n[self.rows], np.cumsum(n[self.rows])
        self.all, self.n = kmers(np.frombuffer(b"".join(raw[i] for i in self.rows), np.uint64), ends - n, ends, k)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        o = np.lexsort((self.all, doc))
        h, d = self.all[o], doc[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.set, self.doc = h[new], d[new]
        self.size = np.bincount(self.doc, minlength=len(self.n))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        occurrence = np.empty(len(h), np.uint64)
        occurrence[o] = (np.arange(len(h)) - first).astype(np.uint64)
        with np.errstate(over="ignore"):
            self.labelled = _mix(self.all + occurrence * _B)

    def sketches(self, seed: int, number: int, depth: int, ordered: bool) -> np.ndarray:
        """(texts, number): a value for the smallest k-mers of each text under each hash function."""
        values, n = (self.labelled, self.n) if ordered else (self.set, self.size)
        starts = np.cumsum(n) - n
        # beyond the packed range positions would wrap; there the k-mer's own order decides
        at = np.minimum(np.arange(len(values)) - np.repeat(starts, n), int(_LOW)).astype(np.uint64)
        out = np.zeros((len(n), number), np.uint64)
        if not len(n):
            return out
        far = int(n.max()) > int(_LOW)
        for i in range(number):
            a = _mix(np.uint64([seed * 1_000_003 + i]))[0] | np.uint64(1)
            with np.errstate(over="ignore"):
                v = ((values * a) & ~_LOW) | at
                keys, places = [], []
                for _ in range(depth):
                    m = np.minimum.reduceat(v, starts)
                    keys.append(m & ~_LOW)
                    if far:
                        hit = np.flatnonzero(v == np.repeat(m, n))
                        p = hit[np.searchsorted(hit, starts)]
                    else:
                        p = starts + np.where(m == _ONES, 0, m & _LOW).astype(np.int64)
                    places.append(p)
                    v[p] = _ONES
                if ordered:
                    o = np.argsort(np.stack(places), axis=0, kind="stable")
                    keys = np.take_along_axis(np.stack(keys), o, 0)
                s = np.full(len(n), np.uint64(seed + 1) * _C + np.uint64(i))
                for x in keys:
                    s = _mix(s * _A + x)
            out[:, i] = s
        return out

    def bitmaps(self, parts: int) -> np.ndarray:
        """(texts, parts): the parity of the distinct k-mers of each bit."""
        bit = (self.set >> np.uint64(64 - (parts * 64).bit_length() + 1)).astype(np.int64)
        odd = np.bincount(self.doc * (parts * 64) + bit, minlength=len(self.n) * parts * 64).astype(np.uint8) & 1
        return np.packbits(odd.reshape(-1, parts, 64), axis=2, bitorder="little").reshape(-1, parts, 8).copy().view(np.int64)[:, :, 0]


def profiles(classes: DataFrame, k: int) -> DataFrame:
    """Adds size, the number of distinct k-mers, and bitmaps b0.. and large; classes: text_key, kind, words."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                b = whole.slice(a, 4000)
                t = _Texts(b.column(2).to_pylist(), k)
                small, large = t.bitmaps(SMALL), t.bitmaps(LARGE)
                c = b.take(pa.array(t.rows, pa.int64()))
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(large) + 1, dtype=np.int32) * LARGE), pa.array(large.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(t.size, pa.int32()), *(pa.array(small[:, i].copy(), pa.int64()) for i in range(SMALL)), wide], ["text_key", "kind", "words", "size", *(f"b{i}" for i in range(SMALL)), "large"])

    return classes.select("text_key", "kind", "words").mapInArrow(run, "text_key long, kind string, words binary, size int, " + ", ".join(f"b{i} long" for i in range(SMALL)) + ", large array<long>")


#: What a posting is: one to be counted, one of a bucket known to be large, or the note that a bucket is large.
_PLAIN, _HOT, _NOTE = 0, 1, 2
_POST = "bucket long, text_key long, role tinyint"


def _posted(bucket: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Postings of a batch; those of a bucket with over BUCKET members here are marked as hot."""
    v, inverse, n = np.unique(bucket, return_inverse=True, return_counts=True)
    large = n > BUCKET
    role = np.where(large[inverse], _HOT, _PLAIN).astype(np.int8)
    notes = v[large]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket, notes]).view(np.int64)), pa.array(np.concatenate([key, np.zeros(len(notes), np.int64)])), pa.array(np.concatenate([role, np.full(len(notes), _NOTE, np.int8)]))], ["bucket", "text_key", "role"])


def postings(classes: DataFrame, k: int) -> DataFrame:
    """(bucket, text_key, role): each text in the bucket of each of its sketches; texts of different kinds never meet."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 10_000):
                b = whole.slice(a, 10_000)
                t = _Texts(b.column(1).to_pylist(), k)
                s = np.concatenate([t.sketches(0, ORDERED, DEPTH, True), t.sketches(1, PLAIN, DEPTH, False)], 1)
                of_kind = {x: xxhash.xxh64_intdigest(x or "") for x in b.column(2).unique().to_pylist()}
                s ^= np.array([of_kind[x] for x in b.column(2).to_pylist()], np.uint64)[t.rows][:, None]
                key = b.column(0).to_numpy()[t.rows]
                yield _posted(s.ravel(), np.repeat(key, s.shape[1]))
                if (t.size <= FEW).any():
                    few = _Texts([b.column(1)[int(i)].as_py() for i in t.rows[t.size <= FEW]], k).sketches(1 + LEVELS + 1, FEWER, 1, False)
                    few ^= np.array([of_kind[x] for x in b.column(2).to_pylist()], np.uint64)[t.rows][t.size <= FEW][:, None]
                    yield _posted(few.ravel(), np.repeat(key[t.size <= FEW], FEWER))

    return classes.select("text_key", "words", "kind").mapInArrow(run, _POST)


def deeper(large: DataFrame, classes: DataFrame, k: int, level: int) -> DataFrame:
    """Postings of the members of large buckets in the buckets of deeper sketches; large: bucket, text_key."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                b = whole.slice(a, 4000)
                t = _Texts(b.column(1).to_pylist(), k)
                s = t.sketches(1 + level, DEEPER * FAMILIES, DEEPER_DEPTH, False).reshape(-1, FAMILIES, DEEPER)
                held = [b.column(2)[int(i)].as_py() for i in t.rows]
                n = np.fromiter(map(len, held), np.int64, len(held))
                above = np.fromiter((x for h in held for x in h), np.int64, int(n.sum())).view(np.uint64)
                with np.errstate(over="ignore"):
                    own = s[np.repeat(np.arange(len(n)), n), (above % np.uint64(FAMILIES)).astype(np.int64)]
                    bucket = _mix(own + (above * _B)[:, None])
                yield _posted(bucket.ravel(), np.repeat(np.repeat(b.column(0).to_numpy()[t.rows], n), DEEPER))

    held = large.groupBy("text_key").agg(F.collect_list("bucket").alias("held"))  # at most the sketches of one text
    return classes.select("text_key", "words").join(held, "text_key").mapInArrow(run, _POST)


def buckets(posts: DataFrame) -> DataFrame:
    """(bucket, text_key, large): the members of buckets of two and more, in one pass over the sorted postings."""

    def run(batches):
        # the rows of the bucket at the end of what was read; a bucket known to be large isn't held
        at, large, kept = None, False, np.zeros(0, np.int64)
        for b in batches:
            bucket, key, role = (b.column(i).to_numpy() for i in range(3))
            if not len(bucket):
                continue
            edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            v, lo, hi = bucket[edge[:-1]], edge[:-1], edge[1:]
            out_b, out_k, out_l = [], [], []

            def tell(name, keys, is_large):
                out_b.append(np.full(len(keys), name))
                out_k.append(keys)
                out_l.append(np.full(len(keys), is_large))

            whole = np.ones(len(v), bool)
            whole[[0, -1]] = False
            several = whole & (hi - lo > 1)
            odd = np.zeros(len(v), bool)
            odd[np.unique(np.searchsorted(edge, np.flatnonzero(role != _PLAIN), side="right") - 1)] = True
            odd |= hi - lo > BUCKET
            few = np.repeat(several & ~odd, hi - lo)
            out_b.append(bucket[few]), out_k.append(key[few]), out_l.append(np.zeros(int(few.sum()), bool))
            for i in [0, *np.flatnonzero(several & odd).tolist(), *([len(v) - 1] if len(v) > 1 else [])]:
                r, x = role[lo[i] : hi[i]], key[lo[i] : hi[i]]
                if at is not None and v[i] != at:
                    if len(kept) > 1 or large:
                        tell(at, kept, large)
                    at = None
                if at is None:
                    at, large, kept = v[i], False, np.zeros(0, np.int64)
                large |= bool((r != _PLAIN).any())
                kept = np.concatenate([kept, x[r != _NOTE]])
                if len(kept) > BUCKET:
                    large = True
                if large:
                    tell(at, kept, True)
                    kept = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_b)), pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_l))], ["bucket", "text_key", "large"])
        if at is not None and (len(kept) > 1 or large):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), at)), pa.array(kept), pa.array(np.full(len(kept), large))], ["bucket", "text_key", "large"])

    n = max(8, int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = posts.where(f"role = {_HOT}").select("bucket", "text_key", F.lit(True).alias("large"))
    counted = posts.where(f"role <> {_HOT}").repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("role"))
    return counted.mapInArrow(run, "bucket long, text_key long, large boolean").unionByName(hot)


_BITS = [f"b{i}" for i in range(SMALL)]


def _near(a: str, b: str, least: float, bits: Column) -> Column:
    """Whether sizes and bitmaps allow the Jaccard: of sizes x and y, at most (1 - least) / (1 + least) (x + y) k-mers differ."""
    x, y = F.col(a), F.col(b)
    return (F.least(x, y) >= least * F.greatest(x, y) - 1e-6) & (bits <= (1 - least) / (1 + least) * (x + y) + 1e-6)


def met(members: DataFrame, on: list[str], other: DataFrame, least: float) -> DataFrame:
    """(key_a, key_b): the pairs with equal ``on`` that sizes and small bitmaps allow; members, other: on, text_key, size, bitmaps."""
    a, b = (d.select(*on, *(F.col(c).alias(c + x) for c in ("text_key", "size", *_BITS))) for d, x in ((members, "_x"), (other, "_y")))
    bits = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in _BITS[1:]), F.bit_count(F.col(f"{_BITS[0]}_x").bitwiseXOR(F.col(f"{_BITS[0]}_y"))))
    return a.join(b, on).where((F.col("text_key_x") < F.col("text_key_y")) & _near("size_x", "size_y", least, bits)).select(F.col("text_key_x").alias("key_a"), F.col("text_key_y").alias("key_b"))


def candidate_pairs(classes: DataFrame, k: int, least: float) -> DataFrame:
    """(key_a, key_b): the pairs of classes that share a bucket and that the small bitmaps allow; classes: as of `profiles`, bucketed."""
    seen = cut(buckets(postings(classes, k)), "buckets")
    marks = classes.select("text_key", "size", *_BITS)
    found = met(few := seen.where("not large").select("bucket", "text_key").join(marks, "text_key"), ["bucket"], few, least)
    large = seen.where("large").select("bucket", "text_key")
    for level in range(1, LEVELS + 1):
        if not large.limit(1).count():
            return found.distinct()
        seen = cut(buckets(deeper(large, classes, k, level)), "buckets")
        found = found.unionByName(met(few := seen.where("not large").select("bucket", "text_key").join(marks, "text_key"), ["bucket"], few, least))
        large = seen.where("large").select("bucket", "text_key")
    return found.unionByName(in_blocks(large, marks, least)).distinct()


def in_blocks(large: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """As `met`, of buckets of any size: members lie in one block each and meet all blocks of their bucket."""
    number = large.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"))
    m = large.join(number, "bucket").join(marks, "text_key")
    salted = m.withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    every = m.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met(salted, ["bucket", "block"], every, least)


def _banded(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> int:
    """The longest common subsequence of a and b within a band around the diagonal j = i + shift."""
    width = 2 * band + 1
    padded = np.zeros(len(a) + len(b) + 2 * width + abs(shift) + 2, np.uint64)
    inside = np.zeros(len(padded), bool)
    base = width + abs(shift)
    padded[base : base + len(b)] = b
    inside[base : base + len(b)] = True
    row = np.zeros(width + 1, np.int64)
    for i in range(len(a)):
        at = base + i + shift - band
        if at < 0 or at + width > len(padded):
            continue
        step = (padded[at : at + width] == a[i]) & inside[at : at + width]
        row[:width] = np.maximum.accumulate(np.maximum(row[:width] + step, row[1:]))
    return int(row.max())


def aligned(a: np.ndarray, b: np.ndarray, ka: np.ndarray, kb: np.ndarray, k: int, band: int = BAND) -> float:
    """Share of the words of both texts that banded alignments along their shared k-mers cover."""
    va, ia = np.unique(ka, return_index=True)
    vb, ib = np.unique(kb, return_index=True)
    _, x, y = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    i, j = ia[x], ib[y]
    o = np.argsort(i)
    i, j = i[o], j[o]
    edge = np.flatnonzero((np.abs(np.diff(j - i)) > band) | (np.diff(j) < 0)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(i)]])
    covered, done = 0, 0
    for p, q in zip(lo.tolist(), hi.tolist()):
        a0, a1 = max(int(i[p]), done), int(i[q - 1]) + k
        b0, b1 = int(j[p:q].min()), int(j[p:q].max()) + k
        if a1 <= a0:
            continue
        if q - p == 1 or (a1 - a0 == b1 - b0 and np.array_equal(a[a0:a1], b[b0:b1])):
            covered += min(a1 - a0, b1 - b0)
        else:
            covered += _banded(a[a0:a1], b[b0:b1], 0 if a0 == int(i[p]) else a0 - int(i[p]), band)
        done = a1
    return 2 * covered / (len(a) + len(b))


def _shared(sets: np.ndarray, starts: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of values that the a-th and the b-th set of each pair share."""
    n = size[a] + size[b]
    begin = np.cumsum(n) - n
    pair = np.repeat(np.arange(len(a)), n)
    place = np.arange(int(n.sum())) - begin[pair]
    first = place < size[a][pair]
    v = sets[np.where(first, starts[a][pair] + place, starts[b][pair] + place - size[a][pair])]
    o = np.lexsort((v, pair))
    v, pair = v[o], pair[o]
    return np.bincount(pair[1:][(v[1:] == v[:-1]) & (pair[1:] == pair[:-1])], minlength=len(a))


def verify(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """(key_a, key_b, similarity) of the pairs that are alike; pairs: key_a, key_b, words_a, words_b."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                c = whole.slice(at, 1000)
                keys = np.concatenate([c.column(i).to_numpy() for i in (0, 1)])
                distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
                t = _Texts([c.column(2 + int(i) // c.num_rows)[int(i) % c.num_rows].as_py() for i in first], k)
                a, b = which[: c.num_rows], which[c.num_rows :]
                both = _shared(t.set, np.cumsum(t.size) - t.size, t.size, a, b)
                j = both / np.maximum(t.size[a] + t.size[b] - both, 1)
                good = np.flatnonzero(j >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(good)), c.column(1).take(pa.array(good)), pa.array(j[good])], ["key_a", "key_b", "similarity"])

    return pairs.select("key_a", "key_b", "words_a", "words_b").mapInArrow(run, "key_a long, key_b long, similarity double")


def coverage(pairs: DataFrame, k: int) -> DataFrame:
    """(key_a, key_b, aligned) of all pairs; pairs: key_a, key_b, words_a, words_b."""

    def run(batches):
        for b in batches:
            cover = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                cover.append(aligned(x, y, *(kmers(t, np.array([0]), np.array([len(t)]), k)[0] for t in (x, y)), k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cover, pa.float64())], ["key_a", "key_b", "aligned"])

    return pairs.select("key_a", "key_b", "words_a", "words_b").mapInArrow(run, "key_a long, key_b long, aligned double")


class NearCopies:
    """The classes of a collection of texts and the links between them.

    members: kind, id, grp, text_key, one row for each id; links: key_a < key_b, similarity. ``min_words`` is at least the words of
    one k-mer.
    """

    def __init__(self, df: DataFrame, k: int = 5, least: float = 0.8, min_words: int = 5) -> None:
        t = cut(word_table(df, max(min_words, k)), "words")
        self.members = cut(t.select("kind", "id", "grp", "text_key").dropDuplicates(["kind", "id"]), "members")
        classes = self._classes = cut_by(profiles(t.select("text_key", "kind", "words").dropDuplicates(["text_key"]), k), "text_key", "classes")
        self.k = k
        pairs = cut(candidate_pairs(classes, k, least), "candidates")
        large = pairs.join(classes.select(F.col("text_key").alias("key_a"), F.col("size").alias("size_a"), F.col("large").alias("large_a")), "key_a").join(classes.select(F.col("text_key").alias("key_b"), F.col("size").alias("size_b"), F.col("large").alias("large_b"), F.col("words").alias("words_b")), "key_b")
        bits = F.aggregate(F.zip_with("large_a", "large_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        near = large.where(_near("size_a", "size_b", least, bits)).select("key_a", "key_b", "words_b")
        self.links = cut(verify(near.join(classes.select(F.col("text_key").alias("key_a"), F.col("words").alias("words_a")), "key_a"), k, least), "links")

    def alignments(self) -> DataFrame:
        """(key_a, key_b, aligned): the share of the words of both texts of each link that alignments cover."""
        pairs = self.links.select("key_a", "key_b")
        for x in "ab":
            pairs = pairs.join(self._classes.select(F.col("text_key").alias(f"key_{x}"), F.col("words").alias(f"words_{x}")), f"key_{x}")
        return coverage(pairs, self.k)

    def pairs(self) -> DataFrame:
        """(kind, id_a, id_b): alike ids of different groups; of copies of few, all, of copies of many, each with a representative.

        Representatives of a class are its first id and the first id of another group than that one's, so that each member with a
        partner in another group has one among them.
        """
        m = self.members
        order = Window.partitionBy("text_key").orderBy("lo")
        sizes = m.groupBy("text_key", "grp").agg(F.count("*").alias("c"), F.min("id").alias("lo")).withColumn("place", F.row_number().over(order))
        sizes = sizes.groupBy("text_key").agg(F.sum("c").alias("n"), *(F.max(F.when(F.col("place") == i, F.col("lo"))).alias(name) for i, name in ((1, "first"), (2, "other"))))
        m = m.join(sizes, "text_key").withColumn("stands", F.col("id").eqNullSafe(F.col("first")) | F.col("id").eqNullSafe(F.col("other")))
        a, b = (m.select(*(["kind"] if x == "a" else []), F.col("text_key").alias(f"key_{x}"), F.col("id").alias(f"i{x}"), F.col("grp").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("stands").alias(f"s{x}")) for x in "ab")
        links = self.links.select("key_a", "key_b").join(sizes.select(F.col("text_key").alias("key_a"), F.col("n").alias("la")), "key_a").join(sizes.select(F.col("text_key").alias("key_b"), F.col("n").alias("lb")), "key_b")
        few, many = links.where(F.col("la") * F.col("lb") <= EXPAND).drop("la", "lb"), links.where(F.col("la") * F.col("lb") > EXPAND).drop("la", "lb")
        linked = (
            few.join(a, "key_a").join(b, "key_b")
            .unionByName(many.join(a.where("sa"), "key_a").join(b, "key_b"))
            .unionByName(many.join(a, "key_a").join(b.where("sb"), "key_b"))
        )
        copies = a.where(F.col("na") > 1)
        small = copies.where(F.col("na") <= 100)
        same = small.join(b.where("nb > 1 and nb <= 100"), F.col("key_a") == F.col("key_b")).where("ia < ib").unionByName(copies.where("na > 100 and sa").join(b.where("nb > 100"), F.col("key_a") == F.col("key_b")))
        every = linked.unionByName(same)
        apart = F.col("ga").isNull() | F.col("gb").isNull() | (F.col("ga") != F.col("gb"))
        return every.where(apart & (F.col("ia") != F.col("ib"))).select("kind", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(kind, id, group_id, n_links): the smallest id of the connected texts and the number of ids that `pairs` links the id to, copies expanded.

        Copies and near copies within one document are one group, but no links.
        """
        links = self.links.select("key_a", "key_b")
        ends = links.select(F.col("key_a").alias("x"), F.col("key_b").alias("y")).unionByName(links.select(F.col("key_b").alias("x"), F.col("key_a").alias("y")))
        label = cut(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("label")), "labels")
        while True:
            near = ends.join(label.select(F.col("x").alias("y"), F.col("label").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
            step = label.join(near, "x").select("x", "label", F.least("label", "m").alias("next"))
            jump = cut(step.join(label.select(F.col("x").alias("next"), F.col("label").alias("far")), "next").select("x", "label", F.least("next", "far").alias("next")), "labels")
            changed = jump.where("label <> next").limit(1).count()
            label = jump.select("x", F.col("next").alias("label"))
            if not changed:
                break
        # a member has a link to each member of its own and of linked classes that isn't of its own document
        held = self.members.groupBy("text_key", "grp").agg(F.count("*").alias("c"))
        held = cut(held, "held")
        own = held.select(F.col("text_key").alias("x"), F.col("text_key").alias("y")).distinct()
        met = ends.unionByName(own).join(held.select(F.col("text_key").alias("y"), F.col("grp").alias("g"), "c"), "y")
        every = met.groupBy("x").agg(F.sum("c").alias("every"))
        same = met.where("g is not null").join(held.where("grp is not null").select(F.col("text_key").alias("x"), F.col("grp").alias("g")), ["x", "g"]).groupBy("x", "g").agg(F.sum("c").alias("same"))
        m = self.members.withColumnsRenamed({"text_key": "x", "grp": "g"}).join(label, "x", "left").join(every, "x").join(same, ["x", "g"], "left")
        m = m.select("kind", "id", F.coalesce("label", "x").alias("label"), (F.col("every") - F.when(F.col("g").isNull(), 1).otherwise(F.col("same"))).alias("n_links"))
        smallest = m.groupBy("kind", "label").agg(F.min("id").alias("group_id"))
        return m.join(smallest, ["kind", "label"]).select("kind", "id", "group_id", "n_links")


__all__ = ["NearCopies", "aligned", "kmers", "words_of"]
