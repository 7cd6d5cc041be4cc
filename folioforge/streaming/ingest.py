"""Ingest of deliveries into a snapshot index, in batches or from a stream.

One batch goes through these steps: what can't be indexed is sorted out with its reason, the gates decide what is new or changed, the access of what is
skipped is compared and patched, the rest is chunked, enriched and embedded, documents of which a text fails are left out whole and become
failure rows, the index is replaced bucket by bucket in one commit, every expected document is accounted for, and the records are marked last.
A batch's commit bears its name, so a batch that is retried after a failure is committed once. Late and out-of-order versions are
dropped by the time gate against the records, which are a snapshot table too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.functions.documents import access_list, enriched, index_title, is_public, metadata_list, metadata_suffix, owner_names
from folioforge.operators import chunking, ingest, vectors
from folioforge.plans import models
from folioforge.session import cut
from folioforge.settings import DEFAULT, Settings

RECORDS = "document_id string, semantic_identifier string, first_link string, source string, doc_updated_at timestamp, content_hash string, chunk_count int, boost int, hidden boolean, external_access struct<emails:array<string>,groups:array<string>,is_public:boolean>, last_indexed_at timestamp"
OUTCOMES = "batch string, document_id string, outcome string, reason string, is_new boolean, n_chunks long"


class Ingest:
    """deliveries: as ingest_document. Tables lie under ``folder``/chunks, ``folder``/records and ``folder``/outcomes.

    Defined cases: deliveries without a document_id are left out; of several of one document the current one counts; an empty batch commits nothing new.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULT, embedder=vectors.hash_embedding, summary: models.Text | None = None, context: models.Text | None = None, buckets: int = ingest.BUCKETS, fold_hashes: bool = True) -> None:
        self.spark, self.settings, self.embedder, self.summary, self.context, self.fold_hashes = spark, settings, embedder, summary, context, fold_hashes
        self.chunks = ingest.Snapshots(spark, f"{folder}/chunks", buckets)
        self.records_at = ingest.Snapshots(spark, f"{folder}/records", buckets)
        self.outcomes_at = ingest.Snapshots(spark, f"{folder}/outcomes", max(1, buckets // 4))

    def records(self) -> DataFrame:
        now = self.records_at.current()
        return self.spark.createDataFrame([], RECORDS) if now is None else now

    def outcomes(self, batch: str | None = None) -> DataFrame:
        """(batch, document_id, outcome, reason, is_new, n_chunks): what became of every document of every batch, one row for each."""
        now = self.outcomes_at.current()
        now = self.spark.createDataFrame([], OUTCOMES) if now is None else now
        return now if batch is None else now.where(F.col("batch") == batch)

    def made(self, docs: DataFrame) -> DataFrame:
        """The index rows of documents, with vectors; failed: why a row could not be embedded."""
        s = self.settings
        texts = F.array_join(F.transform(F.filter("sections", lambda x: x["text"].isNotNull()), lambda x: x["text"]), " ")
        docs = docs.select(
            "document_id", "sections", F.col("source").alias("source_type"), index_title(F.col("title"), F.col("semantic_identifier")).alias("title"), "semantic_identifier",
            F.col("doc_updated_at").alias("last_updated"), F.col("doc_created_at").cast("timestamp").alias("created_at"), metadata_suffix(F.col("metadata"), True).alias("suffix_semantic"),
            metadata_suffix(F.col("metadata"), False).alias("suffix_keyword"), metadata_list(F.col("metadata")).alias("metadata_list"), "document_sets", owner_names(F.col("primary_owners")).alias("primary_owners"),
            is_public(F.col("external_access"), s.public_by_default).alias("public"), access_list(F.col("external_access")).alias("access_control_list"), "hidden", "global_boost")
        docs = cut(docs, "documents")
        made = chunking.chunk(docs, s)
        if self.summary is not None or self.context is not None:
            made = models.contextual(made, docs.select("document_id", texts.alias("text")), self.summary, self.context, s)
        else:
            made = made.withColumn("doc_summary", F.lit("")).withColumn("chunk_context", F.lit(""))
        of_doc = vectors.embed_distinct(docs.drop("sections", "suffix_semantic", "suffix_keyword"), "title", "title_vector", s.dim, self.embedder)
        rows = made.join(of_doc, "document_id").withColumn("chunk_uid", F.xxhash64("document_id", "max_chunk_size", "chunk_index"))
        rows = rows.withColumn("_full", enriched(F.col("content"), F.col("title_prefix"), F.col("suffix_semantic"), F.col("doc_summary"), F.col("chunk_context")))
        return vectors.embed(rows, "_full", "content_vector", s.dim, embedder=self.embedder, failed="failed").drop("_full")

    def batch(self, deliveries: DataFrame, batch_id: str) -> None:
        """One batch; a committed one is left alone."""
        if self.records_at.has_batch(batch_id):
            return
        s, records = self.settings, self.records()
        latest = cut(ingest.current_versions(deliveries.where("document_id is not null")).withColumn("doc_updated_at", F.col("doc_updated_at").cast("timestamp")), "latest")
        sorted_out = ingest.filter_documents(latest, s.max_document_chars)
        gated = cut(sorted_out.select("document_id", "outcome").join(ingest.gates(latest, records, fold=self.fold_hashes), "document_id"), "gated")
        go = latest.join(gated.where("process and outcome = 'kept'").select("document_id"), "document_id", "left_semi")
        carried = go.join(records.select("document_id", F.col("hidden").alias("was_hidden"), F.col("boost").alias("was_boost")), "document_id", "left")
        carried = carried.withColumn("hidden", F.coalesce("was_hidden", F.lit(False))).withColumn("global_boost", F.coalesce("was_boost", F.lit(0)))
        made = cut(self.made(carried), "made")
        failed = made.where("failed is not null").groupBy("document_id").agg(F.min("failed").alias("reason"))
        good = made.join(failed.select("document_id"), "document_id", "left_anti").drop("failed")
        counts = ingest.chunk_counts(good)
        outcome = F.when(F.col("outcome") != "kept", F.col("outcome")).when(~F.col("process"), "skipped").when(F.col("reason").isNotNull(), "failed").when(F.col("n_chunks").isNotNull(), "indexed").otherwise("lost")
        outcomes = cut(gated.join(failed, "document_id", "left").join(counts, "document_id", "left").select(F.lit(batch_id).alias("batch"), "document_id", outcome.alias("outcome"), "reason", "is_new", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks")), "outcomes")
        lost = [r.document_id for r in outcomes.where("outcome = 'lost'").select("document_id").limit(5).collect()]
        if lost:
            raise RuntimeError(f"documents without chunks or failure, such as {lost}; nothing of the batch was committed")
        self.chunks.replace(good, batch_id)
        skipped = latest.join(gated.where("not process and outcome = 'kept'").select("document_id"), "document_id", "left_semi")
        access = cut(ingest.access_changed(skipped, records, s.public_by_default), "access")
        self.chunks.patch(access, f"{batch_id}-access")
        self.outcomes_at.append(outcomes, batch_id)
        indexed = outcomes.where("outcome = 'indexed'").select("document_id", "n_chunks")
        done = latest.join(indexed, "document_id")
        shown = latest.join(outcomes.where("outcome in ('indexed', 'failed')").select("document_id"), "document_id", "left_semi").unionByName(latest.join(access.select("document_id"), "document_id", "left_semi"))
        rows = shown.select(F.lit(0).alias("seq"), "document_id", "semantic_identifier", F.try_element_at("sections.link", F.lit(1)).alias("first_link"), "source", "external_access")
        marks = done.select("document_id", "doc_updated_at", "content_hash", F.col("n_chunks").cast("int").alias("chunk_count"), F.current_timestamp().alias("last_indexed_at"))
        staged = ingest.upsert_pending(records, rows)
        self.records_at.commit(ingest.mark_indexed(staged, marks), batch_id)

    def stream(self, source: DataFrame, checkpoint: str):
        """Starts the stream; it ends when what is available has been read."""
        return source.writeStream.foreachBatch(lambda df, i: self.batch(df, f"batch-{i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per window and type; works on streams, where the watermark bounds the state and drops late rows."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
