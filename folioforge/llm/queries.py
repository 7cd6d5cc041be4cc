"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.llm import markup, nearcopies, neighbours, packing, ranking, splitting, subjects, tokens
from folioforge.session import table


#: Tokens that consecutive pieces share, and the limit of a section.
OVERLAP, SECTION_LIMIT = 16, 512


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "document_chunk").select(F.lit("chunk").alias("item_kind"), F.col("chunk_uid").alias("item_id"), F.lit(0).alias("section_pos"), F.col("content").alias("text"), F.col("max_chunk_size").alias("size_limit"))
    sections = table(spark, d, "ingest_document").select(F.lit("section").alias("item_kind"), F.col("delivery_id").alias("item_id"), F.posexplode("sections.text").alias("section_pos", "text"), F.lit(SECTION_LIMIT).alias("size_limit"))
    return splitting.split(chunks.unionByName(sections), ["item_kind", "item_id", "section_pos"], "text", "size_limit", OVERLAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_index = 1").select("item_kind", "item_id", "section_pos")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by their content, deliveries by the texts of their sections."""
    chunks = table(spark, d, "document_chunk").select(F.lit("chunk").alias("kind"), F.col("chunk_uid").alias("id"), F.lit(None).cast("string").alias("grp"), F.col("content").alias("text"))
    texts = F.transform(F.filter("sections", lambda s: s["text"].isNotNull()), lambda s: s["text"])
    documents = table(spark, d, "ingest_document").select(F.lit("document").alias("kind"), F.col("delivery_id").alias("id"), F.col("document_id").alias("grp"), F.array_join(texts, " ").alias("text"))
    return chunks.unionByName(documents)


def _alike(spark: SparkSession, d: str) -> nearcopies.NearCopies:
    return nearcopies.NearCopies(_texts(spark, d), k=3, least=0.6, min_words=40)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).pairs().withColumnRenamed("kind", "item_kind")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).groups().withColumnRenamed("kind", "item_kind")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_html").select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.lit(0).alias("section_pos"), F.col("cleaned_text").alias("text")).dropDuplicates(["item_id"])
    sections = table(spark, d, "ingest_document").select("delivery_id", "sections.text").dropDuplicates(["delivery_id"]).select(F.lit("section").alias("item_kind"), F.col("delivery_id").alias("item_id"), F.posexplode("text").alias("section_pos", "text"))
    return markup.cleaned(pages.unionByName(sections), ["item_kind", "item_id", "section_pos"], "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_clean(spark, d).where("markup_blocks > 0").select("item_kind", "item_id", "section_pos")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "document_chunk"), "chunk_uid", "content_vector")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.alike(p4_neighbours(spark, d), 0.96)


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(ranking.rank_walk(table(spark, d, "search_hit"))).select(F.col("q").alias("qid"), F.col("item").alias("chunk_uid"), "rank", F.round("stationarity", 6).alias("stationarity"), F.round("standing", 6).alias("standing"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_by_standing(ranking.rank_walk(table(spark, d, "search_hit")), 3).select(F.col("q").alias("qid"), F.col("item").alias("chunk_uid"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", 2048)


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    documents, names = table(spark, d, "documents"), subjects.subjects_of(table(spark, d, "subject_area"))
    model = subjects.train(subjects.labelled_documents(documents, table(spark, d, "subject_label"), names), names)
    return subjects.score(documents, model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject."""
    return p9_subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
WITH items AS (
  SELECT 'chunk' AS item_kind, chunk_uid AS item_id, 0 AS section_pos, content AS text, max_chunk_size AS size_limit FROM document_chunk
  UNION ALL
  SELECT 'section', delivery_id, CAST(pos - 1 AS INTEGER), sections[pos].text, 512
  FROM (SELECT delivery_id, sections, unnest(range(1, len(sections) + 1)) AS pos FROM ingest_document))
SELECT DISTINCT item_kind, item_id, section_pos FROM items
WHERE len(regexp_extract_all(text, '[^ \t\r\n\x{00A0}]{1,8}')) > greatest(size_limit, 1)
""",
        "p6_found": """
WITH one AS (
  SELECT qid, chunk_uid, score_kind, arg_max(score, returned_at) FILTER (WHERE score IS NOT NULL AND NOT isnan(score)) AS score
  FROM search_hit WHERE qid IS NOT NULL AND chunk_uid IS NOT NULL GROUP BY ALL),
standings AS (
  SELECT qid, chunk_uid, cume_dist() OVER (PARTITION BY qid, score_kind ORDER BY score) AS standing FROM one WHERE score IS NOT NULL),
sums AS (
  SELECT i.qid, i.chunk_uid, coalesce(sum(s.standing), 0) AS standing
  FROM (SELECT DISTINCT qid, chunk_uid FROM one) i LEFT JOIN standings s USING (qid, chunk_uid) GROUP BY ALL)
SELECT qid, chunk_uid FROM sums
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(standing, 9) DESC, chunk_uid) <= 3
""",
    }
