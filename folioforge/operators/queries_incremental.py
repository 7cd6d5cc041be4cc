"""The queries of the incremental run and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.operators import incremental
from folioforge.session import shared_folder, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One run over a folder that adopts what the records show to be settled: its output."""
    deliveries = table(spark, d, "ingest_document").select("document_id", "delivery_id", "doc_updated_at", "received_at", "content_hash")
    records = table(spark, d, "document_record").select("document_id", "doc_updated_at", "content_hash", "last_indexed_at")
    return incremental.to_process(deliveries, records, shared_folder(spark, "runs")).select("document_id")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """(delivery_id, run): three runs over all deliveries: the first up to the middle checkpoint of `ingest_run`, the second lost before its commit, the third over all.

    Late commits are made up for: the numbers of the third run lie between those of the first.
    """
    checkpoints = table(spark, d, "ingest_run").where("checkpoint_at is not null").select("checkpoint_at").orderBy("checkpoint_at").collect()  # a row for each run
    middle = checkpoints[(len(checkpoints) - 1) // 2][0] if checkpoints else None
    rows = table(spark, d, "ingest_document").select("delivery_id", "received_at").where("delivery_id is not null")
    run = incremental.IncrementalRun(spark, shared_folder(spark, "runs"))
    named = lambda n: lambda gaps: gaps.select("delivery_id").distinct().withColumn("run", F.lit(n))

    def lost() -> None:
        raise ConnectionError

    run.run(rows.where(F.col("received_at") <= F.lit(middle)), "delivery_id", named(1))
    try:
        run.run(rows, "delivery_id", named(2), before_commit=lost)
    except ConnectionError:
        run.vacuum()
    run.run(rows, "delivery_id", named(3))
    return run.output() if run.commits.last() else spark.createDataFrame([], "delivery_id long, run int")


QUERIES = {"p5_found": p5_found, "p5_runs": p5_runs}

SQL = {
    "p5_found": """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY doc_updated_at DESC NULLS LAST, received_at DESC NULLS LAST, delivery_id DESC) AS place
  FROM ingest_document WHERE document_id IS NOT NULL)
SELECT d.document_id
FROM ranked d LEFT JOIN document_record r ON r.document_id = d.document_id
WHERE d.place = 1 AND CASE
  WHEN r.document_id IS NULL OR r.last_indexed_at IS NULL THEN true
  WHEN d.doc_updated_at IS NOT NULL AND r.doc_updated_at IS NOT NULL
    THEN date_trunc('second', d.doc_updated_at) > date_trunc('second', r.doc_updated_at)
  ELSE r.content_hash IS NULL OR lower(trim(r.content_hash)) IS DISTINCT FROM lower(trim(d.content_hash)) END
""",
    "p5_runs": """
WITH p AS (SELECT checkpoint_at, row_number() OVER (ORDER BY checkpoint_at) AS i, count(*) OVER () AS n FROM ingest_run WHERE checkpoint_at IS NOT NULL)
SELECT delivery_id, CASE WHEN bool_or(received_at <= (SELECT checkpoint_at FROM p WHERE i = (n + 1) // 2)) THEN 1 ELSE 3 END AS run FROM ingest_document WHERE delivery_id IS NOT NULL GROUP BY 1
""",
}
