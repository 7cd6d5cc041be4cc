"""Quality of rankings and of cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioforge.session import cut


def _judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    return ranked.join(qrels.select("qid", "document_id", "relevance"), ["qid", "document_id"], "left").fillna({"relevance": 0})


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10, once: bool = False) -> DataFrame:
    """(qid, ndcg) of every judged query; linear gain. ranked: qid, document_id, rank, a row for each section.

    A document may stand in the list more than once, as its sections do; ``once`` keeps its best place and closes the ranks.
    """
    if once:
        ranked = ranked.groupBy("qid", "document_id").agg(F.min("rank").alias("rank")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "document_id")))
    gain = _judged(ranked, qrels).where(F.col("rank") <= k).groupBy("qid").agg(F.sum(F.col("relevance") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = qrels.where("relevance > 0").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "document_id"))).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("relevance") / F.log2(F.col("r") + 1)).alias("ideal"))
    q = qrels.select("qid").distinct().join(gain, "qid", "left").join(best, "qid", "left")
    return q.select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def recall(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of relevant documents among the first k; 0 without any."""
    found = _judged(ranked, qrels).where((F.col("rank") <= k) & (F.col("relevance") > 0)).select("qid", "document_id").distinct().groupBy("qid").agg(F.count("*").alias("found"))
    have = qrels.groupBy("qid").agg(F.count_if(F.col("relevance") > 0).alias("relevant"))
    return have.join(found, "qid", "left").select("qid", F.when(F.col("relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("recall"))


def mrr(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    first = _judged(ranked, qrels).where((F.col("rank") <= k) & (F.col("relevance") > 0)).groupBy("qid").agg(F.min("rank").alias("r"))
    return qrels.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("mrr"))


def latency(times: DataFrame, column: str) -> DataFrame:
    """(p50, p95) with the ranks of a sorted list: n * 0.5 and n * 0.95 - 1."""
    # equal times are counted first; places are counted within range partitions and carried over by the partitions' counts
    c = times.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    parts = max(2, int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    c = cut(c.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()), "times")
    before = c.groupBy("_part").agg(F.sum("c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    n = before.agg(F.sum("_n")).first()[0] or 0
    c = c.join(before, "_part").withColumn("upto", F.sum("c").over(Window.partitionBy("_part").orderBy(column)) + F.col("_before"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(column)))
    return c.agg(at(n // 2).alias("p50"), at(max(0, int(n * 0.95) - 1)).alias("p95"))


def citation_quality(answers: DataFrame) -> DataFrame:
    """(answer_id, hit, precision, retrieved): answers: answer_id, cited, gold, retrieved_ids, all ARRAY<STRING>."""
    both = F.size(F.array_intersect("cited", "gold"))
    return answers.select("answer_id", (both > 0).alias("hit"), F.when(F.size("cited") > 0, both / F.size(F.array_distinct("cited"))).alias("precision"), F.coalesce(F.arrays_overlap("retrieved_ids", "gold"), F.lit(False)).alias("retrieved"))
