"""From ranked chunks to sections: merging, expansion, windows, budgets, numbering and the context given to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.settings import DEFAULT, SECTION_SEPARATOR


def merge_adjacent(ranked: DataFrame) -> DataFrame:
    """(qid, document_id, first_chunk, last_chunk, center_chunk, center_rank, position, chunks): runs of consecutive chunks of a document.

    ranked: qid, document_id, chunk_index, rank, unique. The center is the best-ranked member; sections stand in its order.
    """
    w = Window.partitionBy("qid", "document_id").orderBy("chunk_index")
    g = ranked.withColumn("island", F.col("chunk_index") - F.row_number().over(w))
    s = g.groupBy("qid", "document_id", "island").agg(F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"), F.min_by("chunk_index", "rank").alias("center_chunk"), F.min("rank").alias("center_rank"), F.array_sort(F.collect_list("chunk_index")).alias("chunks")).drop("island")
    return s.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("center_rank", "document_id", "first_chunk")))


def merge_overlapping(sections: DataFrame) -> DataFrame:
    """(qid, document_id, first_chunk, last_chunk, center_chunk, position, n_merged): sections that overlap or touch become one.

    sections: qid, document_id, first_chunk, last_chunk, center_chunk, position. The center is the earliest input's.
    """
    w = Window.partitionBy("qid", "document_id").orderBy("first_chunk", "last_chunk", "position")
    reach = F.max("last_chunk").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = sections.withColumn("new", F.coalesce(F.col("first_chunk") > reach + 1, F.lit(True)))
    g = g.withColumn("island", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = g.groupBy("qid", "document_id", "island").agg(F.min("first_chunk").alias("first_chunk"), F.max("last_chunk").alias("last_chunk"), F.min_by("center_chunk", "position").alias("center_chunk"), F.min("position").alias("first_position"), F.count("*").alias("n_merged")).drop("island")
    return m.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("first_position", "document_id", "first_chunk"))).drop("first_position")


def expand(sections: DataFrame, chunks: DataFrame, radius: int = DEFAULT.near_radius) -> DataFrame:
    """(qid, document_id, position, chunk_index): the chunks of each section and its neighbours within the radius.

    Neighbours are looked up without the viewer's access, whose document is visible already, but hidden chunks stay out. The wanted
    indexes are exploded, so that it is an equi-join and no range join.
    """
    want = sections.select("qid", "document_id", "position", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first_chunk") - radius), F.col("last_chunk") + radius)).alias("chunk_index"))
    have = chunks.where(~F.coalesce("hidden", F.lit(False)) & (F.col("max_chunk_size") == 512)).select("document_id", "chunk_index").distinct()
    return want.join(have, ["document_id", "chunk_index"]).select("qid", "document_id", "position", "chunk_index")


def relevance_window(chunks: Column, center: Column, n: int) -> Column:
    """At most n of the chunks around the center, even on both sides; what one side lacks the other takes, before first."""
    if n <= 0:
        return F.slice(chunks, 1, 0)
    at = F.array_position(chunks, center).cast("int")
    before, after, need = at - 1, F.size(chunks) - at, F.lit(n - 1)
    half = F.lit((n - 1) // 2)
    b = F.least(half, before)
    a = F.least(half, after)
    b2 = b + F.least(need - b - a, before - b)
    a2 = a + F.least(need - b2 - a, after - a)
    return F.when(at > 0, F.slice(chunks, F.greatest(F.lit(1), at - b2), F.greatest(F.lit(0), a2 + b2 + 1))).otherwise(F.array(center))


def trim_by_tokens(sections: DataFrame, tokens: str, budget: int) -> DataFrame:
    """The sections of each query up to the first that doesn't fit the budget; a budget of 0 or less keeps all."""
    if budget <= 0:
        return sections
    w = Window.partitionBy("qid").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def number_citations(sections: DataFrame, limit: int | None = None, start: int = 1) -> DataFrame:
    """Adds citation: one number for each document in the order of its first section; the limit comes first."""
    s = sections if limit is None else sections.where(F.col("position") <= limit)
    s = s.withColumn("_first", F.min("position").over(Window.partitionBy("qid", "document_id")))
    return s.withColumn("citation", F.dense_rank().over(Window.partitionBy("qid").orderBy("_first")) + (start - 1)).drop("_first")


def with_content(expanded: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, document_id, position, content): the contents of a section's chunks in order, parted by blank lines."""
    text = chunks.select("document_id", "chunk_index", "content")
    j = expanded.join(text, ["document_id", "chunk_index"])
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return j.groupBy("qid", "document_id", "position").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), SECTION_SEPARATOR).alias("content"))


def context_rows(sections: DataFrame) -> DataFrame:
    """(qid, position, document, json): each section as the JSON object that a model is given; absent fields are left out.

    sections: qid, position, citation, title, updated_at, authors, source_type, url, content.
    """
    return sections.select("qid", "position", F.col("citation").alias("document"), F.to_json(F.struct(F.col("citation").alias("document"), "title", "updated_at", "authors", "source_type", "url", "content")).alias("json"))
