"""Filling containers of fixed capacity: best fit in decreasing order, planned over runs of equal sizes.

Documents of one size are interchangeable, so that all there is to plan is a histogram of at most ``capacity`` sizes, whatever the
corpus: documents are runs (size, number), open containers runs (gap, number). The plan takes the largest size left, finds the
smallest gap that holds it, gives the run of documents to the run of containers by rank, so that no two claim one gap, and turns
the filled containers into a run of their new gap; without a gap it opens containers. The result is that of best-fit
decreasing. This takes the place of sweeps over range-sorted documents and gaps on all executors: those need a round, of several shuffles each, for
every document that the fullest container gets, and find what this plan finds from the histogram on the driver.
The plan's rules "ranks r0..r1 of this size go to containers c0, c0 + 1, ..." go to all tasks while they are few, and are joined by size where they are many;
every document finds its container from its size and its rank among the documents of that size. Ranks are counted in buckets,
so that a size that a third of all documents have isn't one task.

Defined cases: an item above the capacity is cut into pieces of exactly the capacity and a rest;
null and empty texts have size 0 and a null container; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioforge.llm.tokens import TOKENIZER_DIR, token_counts
from folioforge.session import cut

#: Documents of one size that are ranked in one task.
BUCKET_ROWS = 100_000
#: Rules, of 32 bytes, that are sent to all tasks; more are joined.
RULES_SENT = 500_000


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rules (size, r0, r1, c0, q): the documents of that size with ranks r0 <= r < r1 go to container c0 + (r - r0) // q."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    rules, opened = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    for size in sorted((s for s in sizes if s > 0), reverse=True):
        left, rank = sizes[size], 0
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // size))
                opened += number
            q = gap // size
            full = min(number, left // q)
            if full:
                rules.append((size, rank, rank + full * q, first, q))
                put(gap - q * size, first, full)
                rank, left = rank + full * q, left - full * q
            if full < number:
                if left and left < q:
                    rules.append((size, rank, rank + left, first + full, left))
                    put(gap - left * size, first + full, 1)
                    left, full = 0, full + 1
                put(gap, first + full, number - full)
    return rules


def containers(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece INT, piece_start BIGINT, piece_size BIGINT, container_id BIGINT), one row for each piece."""
    n = F.col("_n")
    pieces = (
        sized.select(F.col(key).alias("_k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_n"))
        .select("_k", "_n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / capacity).cast("long")))).alias("piece", "_p"))
        .select("_k", "piece", (F.col("_p") * capacity).alias("piece_start"), F.greatest(F.lit(0).cast("long"), F.least(F.lit(capacity).cast("long"), n - F.col("_p") * capacity)).alias("piece_size"))
    )
    pieces = cut(pieces, "pieces")
    held = {int(r.piece_size): int(r.c) for r in pieces.groupBy("piece_size").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    buckets = -(-max(held.values(), default=1) // BUCKET_ROWS)
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("_k", "piece"), F.lit(buckets)))
    ranked = pieces.withColumn("_r", F.row_number().over(Window.partitionBy("piece_size", "_b").orderBy("_k", "piece")) - 1)
    if buckets > 1:
        before = Window.partitionBy("piece_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = pieces.groupBy("piece_size", "_b").agg(F.count("*").alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
        ranked = ranked.join(starts, ["piece_size", "_b"]).withColumn("_r", F.col("_r") + F.col("_s"))
    rules = sorted(plan(held, capacity))
    ranked = ranked.select("_k", "piece", "piece_start", "piece_size", F.col("_r").cast("long").alias("_r"))
    if len(rules) > RULES_SENT:
        return _by_join(ranked, rules).select(F.col("_k").alias(key), "piece", "piece_start", "piece_size", "container_id")
    shift = 40
    table = np.array(rules, np.int64).reshape(-1, 5)
    begin, rank0, first, per = (table[:, 0] << shift) | table[:, 1], table[:, 1], table[:, 3], table[:, 4]
    shared = sized.sparkSession.sparkContext.broadcast((begin, rank0, first, per))
    kind = ranked.schema["_k"].dataType.simpleString()

    def assign(batches):
        begin, rank0, first, per = shared.value
        for b in batches:
            s, r = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            c = np.zeros(len(s), np.int64)
            if len(begin):
                at = np.maximum(np.searchsorted(begin, (s << shift) | r, side="right") - 1, 0)
                c = first[at] + (r - rank0[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(c, pa.int64(), mask=s == 0)], [key, "piece", "piece_start", "piece_size", "container_id"])

    return ranked.mapInArrow(assign, f"`{key}` {kind}, piece int, piece_start long, piece_size long, container_id long")


def _by_join(ranked: DataFrame, rules: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Adds container_id by a join: the rules of a size as sorted arrays, of which a row searches its own."""
    held = ranked.sparkSession.createDataFrame(rules, "piece_size long, r0 long, r1 long, c0 long, q long")
    # ranks in spans, so that the rules of one size are many rows
    span = 65_536
    held = held.withColumn("_s", F.explode(F.sequence(F.floor(F.col("r0") / span), F.floor((F.col("r1") - 1) / span)))).groupBy("piece_size", "_s").agg(F.array_sort(F.collect_list(F.struct("r0", "r1", "c0", "q"))).alias("rules"))
    j = ranked.withColumn("_s", F.floor(F.col("_r") / span)).join(held, ["piece_size", "_s"], "left")
    mine = F.filter("rules", lambda x: (x["r0"] <= F.col("_r")) & (F.col("_r") < x["r1"]))[0]
    return j.withColumn("_m", mine).withColumn("container_id", F.col("_m.c0") + F.floor((F.col("_r") - F.col("_m.r0")) / F.col("_m.q")))


def pack_documents(df: DataFrame, key: str, text: str, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Containers of ``capacity`` tokens of a public tokenizer."""
    return containers(cut(token_counts(df, key, text, tokenizer, tokenizer_dir), "sizes"), key, "n_tokens", capacity)
