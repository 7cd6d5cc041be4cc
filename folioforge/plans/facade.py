"""The verbs of the engine over one folder: extract, ingest, delete, search, answer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.operators import lexical, vectors
from folioforge.operators.filters import Filters
from folioforge.plans import answer as answers, search as plans
from folioforge.settings import DEFAULT, Settings
from folioforge.sources import files
from folioforge.streaming.ingest import Ingest


class Engine:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULT, embedder=vectors.hash_embedding) -> None:
        self.spark, self.settings, self.embedder = spark, settings, embedder
        self.store = Ingest(spark, folder, settings, embedder)
        self._index: tuple[int, lexical.TextIndex] | None = None

    def extract(self, path: str) -> DataFrame:
        """Files as documents with sections; failures are a column."""
        return files.read(self.spark, path)

    def ingest(self, deliveries: DataFrame, batch: str) -> DataFrame:
        """Ingests a batch of deliveries and gives its counters; a batch of the same name is ingested once."""
        self.store.batch(deliveries, batch)
        is_ = lambda *o: F.col("outcome").isin(*o)
        return self.store.outcomes(batch).agg(
            F.count("*").alias("total"), F.count_if(is_("indexed")).alias("indexed"), F.count_if(is_("skipped")).alias("skipped"), F.count_if(is_("indexed") & F.col("is_new")).alias("new"),
            F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.count_if(is_("failed", "too_long")).alias("failures"))

    def failures(self, batch: str | None = None) -> DataFrame:
        """(batch, document_id, outcome, reason) of the documents that were to be indexed and were not."""
        return self.store.outcomes(batch).where(F.col("outcome").isin("failed", "too_long")).select("batch", "document_id", "outcome", "reason")

    def delete(self, documents: DataFrame) -> None:
        """The index first, then the records, so that a failure between leaves nothing that can be found."""
        self.store.chunks.remove(documents)
        self.store.records_at.remove(documents)

    def index(self) -> DataFrame:
        """The current rows as a search reads them; vectors were written when they were ingested."""
        c = self.store.chunks.current()
        if c is None:
            raise ValueError("nothing is indexed yet")
        return c

    def text_index(self) -> lexical.TextIndex:
        """The stored postings of the current rows, made once for each commit."""
        number = (self.store.chunks.log.last() or {"number": 0})["number"]
        if self._index is None or self._index[0] != number:
            self._index = (number, lexical.TextIndex(self.index(), "chunk_uid"))
        return self._index[1]

    def search(self, queries: DataFrame, filters: Filters = Filters(), token_budget: int = 0, m: plans.Models = plans.Models()) -> DataFrame:
        """queries: qid, query_text."""
        q = vectors.embed(queries, "query_text", "query_vector", self.settings.dim, True, self.embedder)
        return plans.search(self.index(), q, filters, token_budget, self.settings, m, self.text_index())

    def answer(self, question: str, model: answers.Model, filters: Filters = Filters()) -> Iterator[dict]:
        def look(q: str, start: int) -> list[dict]:
            # at most the sections that a model is given
            found = self.search(self.spark.createDataFrame([("q", q)], "qid string, query_text string"), filters).orderBy("position").collect()
            return [{"number": r.citation + start - 1, "document_id": r.document_id, "link": None, "content": r.content} for r in found]

        return answers.answer(question, model, look)
