"""Normalising, weighting and fusing ranked lists of a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.settings import DEFAULT


def candidates(hits: DataFrame, key: str, n: int | None = DEFAULT.candidates) -> DataFrame:
    """The best n usable hits of each (qid, sub), all where n is None, one for each row; hits: qid, sub, key, score."""
    good = hits.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("qid", "sub", key).agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid", "sub").orderBy(F.round("score", 9).desc(), key)
    placed = good.withColumn("rank", F.row_number().over(w))
    return placed if n is None else placed.where(F.col("rank") <= n)


def min_max(c: DataFrame, floor: float = DEFAULT.minmax_floor) -> DataFrame:
    """Adds norm: 1 for the best, a small floor for the worst, 1 where all are equal."""
    w = Window.partitionBy("qid", "sub")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return c.withColumn("norm", F.when(hi == lo, 1.0).otherwise(F.greatest(F.lit(floor), (F.col("score") - lo) / (hi - lo))))


def z_score(c: DataFrame) -> DataFrame:
    """Adds norm: deviations from the mean; 0 where all are equal."""
    w = Window.partitionBy("qid", "sub")
    sd = F.stddev_pop("score").over(w)
    return c.withColumn("norm", F.when(sd == 0, 0.0).otherwise((F.col("score") - F.avg("score").over(w)) / sd))


def weighted_mean(normed: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(qid, key, score): the weighted mean, with nothing for the lists that don't hold the row."""
    if not weights or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    w: Column = reduce(lambda a, kv: a.when(F.col("sub") == kv[0], kv[1]), list(weights.items())[1:], F.when(F.col("sub") == list(weights)[0], list(weights.values())[0]))
    return normed.withColumn("w", w).where("w is not null").groupBy("qid", key).agg(F.sum(F.col("w") * F.col("norm")).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank(lists: DataFrame, key: list[str], k: int = DEFAULT.rrf_k) -> DataFrame:
    """(qid, key, rrf, score, position): weighted reciprocal rank fusion.

    lists: qid, list_idx, weight, rank, key, score. A row keeps the score of its first occurrence. Ties go by the rank
    in the first list that holds it, then by that list.
    """
    first = F.struct("list_idx", "rank")
    fused = lists.groupBy("qid", *key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf"), F.min_by("score", first).alias("score"), F.min(first).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), F.col("first.rank"), F.col("first.list_idx"), *key)
    return fused.withColumn("position", F.row_number().over(w)).drop("first")


def deduplicate_queries(variants: DataFrame) -> DataFrame:
    """variants: qid, pos, text, weight; equal texts without case become one: first spelling and place, weights added."""
    return variants.groupBy("qid", F.lower("text").alias("folded")).agg(F.min_by("text", "pos").alias("text"), F.sum("weight").alias("weight"), F.min("pos").alias("pos")).drop("folded")


def weighted_variants(queries: DataFrame) -> DataFrame:
    """(qid, kind, text, weight, alpha, pos), heaviest first.

    queries: qid, text, rephrase STRING, keywords ARRAY, model ARRAY. The keyword variants are deduplicated apart from the others and
    carry their own alpha; the original weighs 1 if there is no expansion.
    """
    v = DEFAULT.variant_weights
    none = F.array().cast("array<string>")
    expanded = F.col("rephrase").isNotNull() | (F.size(F.coalesce("keywords", none)) > 0)
    one = lambda kind, weight: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"), weight.alias("weight"))
    parts = [
        F.transform(F.filter(F.array("rephrase"), lambda x: x.isNotNull()), one("semantic", F.lit(v["rephrase"]))),
        F.transform(F.coalesce("model", none), one("semantic", F.lit(v["model"]))),
        F.transform(F.array("text"), one("semantic", F.when(expanded, v["original"]).otherwise(v["only"]))),
        F.transform(F.coalesce("keywords", none), one("keyword", F.lit(v["keyword"]))),
    ]
    flat = queries.select("qid", F.posexplode(F.concat(*parts)).alias("pos", "x")).select("qid", "pos", "x.*")
    w = Window.partitionBy("qid").orderBy(F.desc("weight"), "pos")
    d = flat.groupBy("qid", "kind", F.lower("text").alias("folded")).agg(F.min_by("text", "pos").alias("text"), F.sum("weight").alias("weight"), F.min("pos").alias("pos")).drop("folded")
    return d.withColumn("alpha", F.when(F.col("kind") == "keyword", DEFAULT.keyword_alpha).otherwise(F.lit(0.5))).withColumn("order", F.row_number().over(w))


def combine(lists: DataFrame, key: list[str]) -> DataFrame:
    """The best-scored occurrence of each row over all lists; null counts as 0, the first wins ties. lists: qid, seq, key, score."""
    w = Window.partitionBy("qid", *key).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "seq")
    return lists.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
