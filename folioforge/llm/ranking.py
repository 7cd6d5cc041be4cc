"""One ranking from scores on different scales: a rank-walk Markov chain.

From an item the walk picks a kind of score, each alike, and jumps uniformly to the items that
this kind ranks at least as high; an item without a usable score of the kind stands below all that
have one. With probability 1 - damping it jumps anywhere. Only ranks matter, so no kind
outweighs another by its range. Items are ordered by stationarity.

With the items of a kind sorted by score, the mass that reaches an item is a prefix sum, so one step costs
the number of scores. Queries of up to ``GROUP_ROWS`` scores are walked each in one task; larger ones
in Spark, where equal scores are summed first, and prefix sums are taken over distinct scores within range partitions and carried over by the
partitions' totals. Both walk until the same tolerance.

Defined cases: null and NaN scores are not usable; of a score reported again the latest usable one counts;
items without any usable score stay, at the end; ties go by the sum of standings, then by item; null
queries or items are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.session import cut

DAMPING, TOLERANCE, STEPS = 0.85, 1e-7, 200
GROUP_ROWS = 200_000


def stationary(item: np.ndarray, kind: np.ndarray, score: np.ndarray, n: int, kinds: int, damping: float = DAMPING) -> tuple[np.ndarray, np.ndarray]:
    """(stationarity, sum of standings) of items 0..n-1; the scores are usable, one for each item and kind."""
    parts, standing = [], np.zeros(n)
    for k in range(kinds):
        at = np.flatnonzero(kind == k)
        o = at[np.argsort(score[at], kind="stable")]
        s, who = score[o], item[o]
        least = np.searchsorted(s, s, side="left")  # items strictly lower
        upto = np.searchsorted(s, s, side="right")  # items not higher
        standing[who] += upto / max(len(s), 1)
        without = np.ones(n, bool)
        without[who] = False
        parts.append((who, 1.0 / (len(s) - least), upto, without, len(s)))
    pi = np.full(n, 1.0 / n)
    for _ in range(STEPS):
        new = np.zeros(n)
        for who, out, upto, without, m in parts:
            if m:
                new[who] += np.cumsum(pi[who] * out)[upto - 1] + pi[without].sum() / m
            else:
                new += 1.0 / n
        new = (1 - damping) / n + damping * new / max(kinds, 1) if kinds else np.full(n, 1.0 / n)
        moved = np.abs(new - pi).sum()
        pi = new
        if moved < TOLERANCE:
            break
    return pi, standing


def _running(df: DataFrame, keys: list[str], order: str, partitions: int) -> DataFrame:
    """Adds _part, in which all rows with equal keys and order lie; parts of one key follow one another in order."""
    return cut(df.repartitionByRange(partitions, *keys, order).withColumn("_part", F.spark_partition_id()), "ranges")


def _prefix(df: DataFrame, keys: list[str], order: str, value: Column, name: str, at_least: bool = False) -> DataFrame:
    """Sum of value over the rows of the same keys with order not above (or not below) the row's own.

    Rows of equal order are added up before the shuffle, so that ties are one row however many they are; equal orders lie in one _part.
    """
    by = F.desc(order) if at_least else F.asc(order)
    level = df.groupBy(*keys, "_part", order).agg(F.sum(value).alias("_v"))
    local = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(F.desc("_part") if at_least else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = level.groupBy(*keys, "_part").agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(outer), F.lit(0.0))).drop("_s")
    level = level.withColumn("_local", F.sum("_v").over(local)).join(before, [*keys, "_part"]).select(*keys, order, (F.col("_local") + F.col("_before")).alias(name))
    return df.join(level, [*keys, order])


def _walk_split(scores: DataFrame, items: DataFrame, damping: float, partitions: int, steps: int = STEPS) -> DataFrame:
    """The walk over queries of any size; scores: q, item, kind, score; items: q, item."""
    levels = _running(scores.select("q", "kind", "score").distinct(), ["q", "kind"], "score", partitions)
    s = scores.join(levels, ["q", "kind", "score"])
    s = _prefix(_prefix(s, ["q", "kind"], "score", F.lit(1.0), "upto"), ["q", "kind"], "score", F.lit(1.0), "higher", at_least=True)
    sizes = cut(scores.groupBy("q", "kind").agg(F.count("*").cast("double").alias("m")), "kinds")
    of_query = cut(items.groupBy("q").agg(F.count("*").cast("double").alias("n")).join(sizes.groupBy("q").agg(F.count("*").cast("double").alias("kinds")), "q", "left"), "queries")
    s = cut(s.join(sizes, ["q", "kind"]), "ranked")
    pi = cut(items.join(of_query, "q").select("q", "item", (1 / F.col("n")).alias("pi")), "walk")
    standing = cut(s.groupBy("q", "item").agg(F.sum(F.col("upto") / F.col("m")).alias("standing")), "standings")
    for _ in range(steps):
        mass = s.join(pi, ["q", "item"])
        held = mass.groupBy("q", "kind").agg(F.sum("pi").alias("held"))
        # what stands without a score of the kind spreads over all that have one
        rest = sizes.join(held, ["q", "kind"]).select("q", "kind", ((1 - F.col("held")) / F.col("m")).alias("rest"))
        step = _prefix(mass, ["q", "kind"], "score", F.col("pi") / F.col("higher"), "got").join(rest, ["q", "kind"]).groupBy("q", "item").agg(F.sum(F.col("got") + F.col("rest")).alias("got"))
        new = pi.join(of_query, "q").join(step, ["q", "item"], "left").select("q", "item", "pi", F.when(F.col("kinds").isNull(), 1 / F.col("n")).otherwise((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0)) / F.col("kinds")).alias("new"))
        new = cut(new, "walk")
        moved = new.groupBy("q").agg(F.sum(F.abs(F.col("new") - F.col("pi"))).alias("d")).agg(F.max("d")).first()[0]
        pi = new.select("q", "item", F.col("new").alias("pi"))
        if moved is None or moved < TOLERANCE:
            break
    return pi.join(standing, ["q", "item"], "left").select("q", "item", F.col("pi").alias("stationarity"), F.coalesce("standing", F.lit(0.0)).alias("standing"))


def rank_walk(hits: DataFrame, query: str = "qid", item: str = "chunk_uid", kind: str = "score_kind", score: str = "score", at: str = "returned_at", damping: float = DAMPING, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(q, item, stationarity, standing, rank) of every item of every query."""
    rows = hits.select(F.col(query).cast("string").alias("q"), F.col(item).cast("long").alias("item"), F.col(kind).cast("string").alias("kind"), F.col(score).cast("double").alias("score"), F.col(at).alias("at")).where("q is not null and item is not null")
    usable = F.col("score").isNotNull() & ~F.isnan("score") & F.col("kind").isNotNull()
    # one row for each query, item and kind; score is null where none is usable
    one = cut(rows.groupBy("q", "item", "kind").agg(F.max(F.when(usable, F.struct("at", "score"))).alias("m")).select("q", "item", "kind", F.col("m.score").alias("score")), "scores")
    sizes = one.groupBy("q").agg(F.count("*").alias("rows"))
    hot = cut(sizes.where(F.col("rows") > group_rows).select("q"), "hot")
    some = hot.limit(1).count() > 0
    few = one.join(hot, "q", "left_anti") if some else one

    def walk(t: pa.Table) -> pa.Table:
        ids, which = np.unique(t.column("item").to_numpy(), return_inverse=True)
        s = t.column("score")
        good = ~s.is_null().to_numpy()
        names, k = np.unique(np.array(t.column("kind").fill_null("").to_pylist())[good], return_inverse=True)
        pi, standing = stationary(which[good], k, s.to_numpy()[good].astype(float), len(ids), len(names), damping)
        return pa.table({"q": pa.array([t.column("q")[0].as_py()] * len(ids), pa.string()), "item": ids, "stationarity": pi, "standing": standing})

    done = few.groupBy("q").applyInArrow(walk, "q string, item long, stationarity double, standing double")
    if some:
        large = one.join(hot, "q")
        partitions = max(2, int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        done = done.unionByName(_walk_split(large.where("score is not null"), large.select("q", "item").distinct(), damping, partitions))
    return done


def ranked(walked: DataFrame) -> DataFrame:
    """Adds the rank within each query: places within range partitions, carried over by the partitions' counts.

    Stationarities count as equal if they differ by less than a 10^6th of their mean, whatever the number of items.
    """
    sizes = walked.groupBy("q").agg(F.count("*").alias("_items"))  # a row for each query
    walked = walked.join(sizes, "q")
    key = F.struct((-F.round(F.col("stationarity") * F.col("_items"), 6)).alias("a"), (-F.round("standing", 9)).alias("b"), F.col("item").alias("c"))
    partitions = max(2, int(walked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = _running(walked.withColumn("_key", key), ["q"], "_key", partitions)
    local = F.row_number().over(Window.partitionBy("q", "_part").orderBy("_key"))
    outer = Window.partitionBy("q").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy("q", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0))).drop("_n")
    return r.withColumn("_local", local).join(before, ["q", "_part"]).withColumn("rank", F.col("_local") + F.col("_before")).drop("_key", "_part", "_local", "_before", "_items")


def best_by_standing(walked: DataFrame, k: int) -> DataFrame:
    """The k items of each query with the largest sums of standings; the limit is taken in every task before the shuffle."""
    w = Window.partitionBy("q").orderBy(F.round("standing", 9).desc(), "item")
    return walked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
