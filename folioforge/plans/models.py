"""Where models take part: protocols, offline stand-ins, and what happens without or after a failing model.

A model is called from Arrow functions over distinct inputs, so that one text is sent once; a failure is a null, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import n_words
from folioforge.operators import citations, sections
from folioforge.session import cut
from folioforge.settings import DEFAULT, Settings

Text = Callable[[str], str | None]


def apply(df: DataFrame, column: str, to: str, model: Text | None, binary: bool = False) -> DataFrame:
    """Adds ``to``: the model's answer for each distinct value of a column; null without a model, for null and for failures."""
    if model is None:
        return df.withColumn(to, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return model(x)
            except Exception:  # noqa: BLE001 - a failing call leaves its row without an answer
                return None

        return s.map(one)

    once = df.select(F.col(column).alias("_in")).where("_in is not null").distinct().withColumn("_out", run("_in"))
    return df.join(once, F.col(column).eqNullSafe(F.col("_in")), "left").withColumn(to, F.col("_out")).drop("_in", "_out")


def expansion_lines(answer: Column, most: int = 3) -> Column:
    """The first non-empty lines of a model's keyword expansion, without list marks."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def expand_queries(queries: DataFrame, rephrase: Text | None = None, keywords: Text | None = None) -> DataFrame:
    """Adds rephrase and keywords to (qid, text); without models the query stands alone."""
    q = apply(apply(queries, "text", "rephrase", rephrase), "text", "_k", keywords)
    return q.withColumn("rephrase", F.when(F.trim("rephrase") != "", F.trim("rephrase"))).withColumn("keywords", expansion_lines(F.col("_k"))).drop("_k").withColumn("model", F.array().cast("array<string>"))


def select_sections(found: DataFrame, choose: Text | None, most: int = DEFAULT.max_sections) -> DataFrame:
    """The sections that a model picks, in its order; without a model, or if it picks none, the first ones.

    found: qid, position, content. The prompt of a query numbers its sections from 0.
    """
    first = found.where(F.col("position") <= most).withColumn("picked", F.col("position"))
    if choose is None:
        return first
    prompts = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: F.concat(F.lit("["), (x["position"] - 1).cast("string"), F.lit("] "), F.left(F.coalesce(x["content"], F.lit("")), F.lit(500)))), "\n").alias("prompt"), F.count("*").cast("int").alias("n"))
    answers = cut(apply(prompts, "prompt", "answer", choose), "answers")
    picks = answers.select("qid", F.slice(citations.parse_selection(F.coalesce("answer", F.lit("")), F.col("n")), 1, most).alias("picks"))
    chosen = found.join(picks, "qid").withColumn("picked", F.array_position("picks", (F.col("position") - 1).cast("int")).cast("int")).where("picked > 0").drop("picks")
    none = picks.where(F.size("picks") == 0).select("qid")
    return chosen.unionByName(first.join(none, "qid", "left_semi").select(*chosen.columns))


def expand_relevant(found: DataFrame, chunks: DataFrame, classify: Text | None) -> DataFrame:
    """(qid, document_id, position, chunk_index): each section with the neighbours its class asks for.

    Classes: 0 not relevant, which keeps the section as it is, 1 the section alone, 2 two chunks on both sides, 3 five. Class 1 without a model.
    """
    c = apply(found, "content", "_a", classify)
    c = cut(c.withColumn("_class", F.when(F.col("_a").isNull(), 1).otherwise(citations.parse_classification(F.col("_a")))).drop("_a"), "classified")
    parts = [sections.expand(c.where(w), chunks, r) for w, r in (("_class <= 1", 0), ("_class = 2", DEFAULT.near_radius), ("_class = 3", DEFAULT.full_radius))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def describe_images(sections_: DataFrame, model: Callable[[bytes], str | None] | None, content: str = "image_bytes") -> DataFrame:
    """The text of image sections from a vision model: "" without one, a placeholder where it fails; other sections stay."""
    is_image = F.col("type") == "image"
    if model is None:
        return sections_.withColumn("text", F.when(is_image, F.coalesce("text", F.lit(""))).otherwise(F.col("text")))

    @F.pandas_udf("string")
    def run(data: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(x, w):
            if not w or x is None:
                return None
            try:
                return model(bytes(x))
            except Exception:  # noqa: BLE001
                return "[image could not be described]"

        return pd.Series([one(x, w) for x, w in zip(data, wanted)])

    return sections_.withColumn("text", F.when(is_image, F.coalesce(run(content, is_image), F.lit(""))).otherwise(F.col("text")))


def contextual(chunks: DataFrame, documents: DataFrame, summary: Text | None, context: Text | None, s: Settings = DEFAULT) -> DataFrame:
    """Adds doc_summary and chunk_context to chunks of documents that don't fit one chunk; "" elsewhere and without models.

    documents: document_id, text. A document is summarised once; a chunk's context is asked for with its document's text before it.
    """
    large = documents.withColumn("_n", n_words(F.col("text"))).where(F.col("_n") > s.chunk_tokens).select("document_id", "text")
    summed = apply(large, "text", "doc_summary", summary).select("document_id", "text", "doc_summary")
    j = chunks.join(summed, "document_id", "left")
    j = apply(j.withColumn("_ask", F.when(F.col("text").isNotNull(), F.concat("text", F.lit("\n\n---\n\n"), "content"))), "_ask", "chunk_context", context)
    return j.withColumn("doc_summary", F.coalesce("doc_summary", F.lit(""))).withColumn("chunk_context", F.coalesce("chunk_context", F.lit(""))).drop("_ask", "text")


def highlights(text: Column, terms: Column, fragments: int = 4, size: int = 100) -> Column:
    """Up to four fragments of about a hundred characters around the analysed query terms, which are marked ``<hi>``; in the JVM."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    half = size // 2
    around = F.regexp_extract_all(text, F.concat(F.lit(rf"(?isu)((?<![\p{{L}}\p{{N}}]).{{0,{half}}}(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(terms, "|"), F.lit(rf")(?![\p{{L}}\p{{N}}]).{{0,{half}}})")), F.lit(1))
    marked = F.transform(F.slice(around, 1, fragments), lambda x: F.regexp_replace(x, pattern, F.lit("<hi>$1</hi>")))
    return F.when(F.size(terms) > 0, marked).otherwise(F.array().cast("array<string>"))
