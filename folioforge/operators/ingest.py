"""Change gates, replacement, patches and bookkeeping of an index, as joins between tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioforge.functions.documents import access_list, is_public
from folioforge.operators.commits import Commits


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def gates(documents: DataFrame, records: DataFrame, ignore_time: bool = False, force: bool = False, fold: bool = False) -> DataFrame:
    """(document_id, is_new, skip_time, skip_hash, process) of each document.

    documents: document_id, doc_updated_at, content_hash. A later time than the record's passes both gates, an older or
    equal one fails the first; without both times the hash decides, with ``fold`` in any case of letters and whatever blanks around it.
    """
    d = documents.select("document_id", F.col("doc_updated_at").alias("t"), F.col("content_hash").alias("h"))
    r = records.select("document_id", F.col("doc_updated_at").alias("rt"), F.col("content_hash").alias("rh"), F.lit(True).alias("known"))
    norm = lambda x: F.lower(F.trim(x)) if fold else x
    j = d.join(r, "document_id", "left")
    advanced = _false(F.date_trunc("second", "t") > F.date_trunc("second", "rt"))
    skip_time = F.lit(not ignore_time and not force) & F.col("t").isNotNull() & F.col("rt").isNotNull() & ~advanced
    skip_hash = F.lit(not force) & ~advanced & _false(F.col("known")) & _false(norm(F.col("h")) == norm(F.col("rh")))
    return j.select("document_id", F.col("known").isNull().alias("is_new"), skip_time.alias("skip_time"), skip_hash.alias("skip_hash"), (~(skip_time | skip_hash)).alias("process"))


def filter_documents(documents: DataFrame, max_chars: int) -> DataFrame:
    """Adds outcome: kept, dropped (nothing to index) or too_long; documents: title, semantic_identifier, sections."""
    text = F.array_join(F.transform(F.coalesce("sections", F.array().cast(documents.schema["sections"].dataType)), lambda s: F.coalesce(s["text"], F.lit(""))), "")
    media = F.exists(F.coalesce("sections", F.array().cast(documents.schema["sections"].dataType)), lambda s: s["type"].isin("image", "tabular"))
    named = F.coalesce(F.col("title"), F.col("semantic_identifier"), F.lit("")) != ""
    total = F.length(text) + F.length(F.coalesce("title", F.col("semantic_identifier"), F.lit("")))
    empty = (F.trim(text) == "") & ~media
    return documents.withColumn("outcome", F.when(empty & (~named | (F.col("title") == "")), "dropped").when(total > max_chars, "too_long").otherwise("kept"))


def access_changed(skipped: DataFrame, records: DataFrame, by_default: bool = True) -> DataFrame:
    """(document_id, public, access_control_list): skipped documents whose effective access differs from their record's."""
    side = lambda df, p: df.select("document_id", is_public(F.col("external_access"), by_default).alias(f"{p}_public"), access_list(F.col("external_access")).alias(f"{p}_acl"))
    j = side(skipped, "new").join(side(records, "old"), "document_id")
    return j.where(~(F.col("new_public").eqNullSafe(F.col("old_public")) & F.col("new_acl").eqNullSafe(F.col("old_acl")))).select("document_id", F.col("new_public").alias("public"), F.col("new_acl").alias("access_control_list"))


def replace(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with all chunks of the new chunks' documents replaced; a shrunk document leaves no old chunk behind."""
    return index.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*index.columns).unionByName(new.select(*index.columns))


def delete(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*index.columns)


PATCHED = ("public", "access_control_list", "document_sets", "global_boost", "hidden")


def patch(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index with the non-null fields of ``changes`` (document_id and any of `PATCHED`) on all chunks of their documents; one row for each document."""
    fields = [c for c in PATCHED if c in changes.columns]
    if not fields:
        return index
    j = index.join(changes.select("document_id", *[F.col(c).alias(f"_{c}") for c in fields]), "document_id", "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in index.columns])


def chunk_counts(index: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    kept = index if failed is None else index.join(failed.select("document_id").distinct(), "document_id", "left_anti")
    return kept.groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def unaccounted(expected: DataFrame, *outcomes: DataFrame) -> DataFrame:
    """Expected documents that none of the outcomes mentions; a run is complete only if there are none."""
    seen = reduce(lambda a, b: a.unionByName(b), [o.select("document_id") for o in outcomes])
    return expected.select("document_id").distinct().join(seen.distinct(), "document_id", "left_anti")


def counters(gated: DataFrame, chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: total, skipped, indexed, new, chunks, failures."""
    bad = failed.select("document_id").distinct().withColumn("bad", F.lit(True))
    g = gated.join(bad, "document_id", "left").join(chunk_counts(chunks), "document_id", "left")
    done = F.col("process") & F.col("bad").isNull()
    return g.agg(F.count("*").alias("total"), F.count_if(~F.col("process")).alias("skipped"), F.count_if(done).alias("indexed"), F.count_if(done & F.col("is_new")).alias("new"), F.coalesce(F.sum(F.when(done, F.coalesce("n_chunks", F.lit(0)))), F.lit(0)).alias("chunks"), F.count_if(F.col("bad").isNotNull()).alias("failures"))


def upsert_pending(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records with the display fields and access of ``incoming``; gates, boost and hidden stay as they are.

    incoming: seq, document_id, semantic_identifier, first_link, source, external_access; of repeated ids the last wins.
    """
    own = ["semantic_identifier", "first_link", "source", "external_access"]
    last = incoming.groupBy("document_id").agg(F.max_by(F.struct(*own), "seq").alias("n"))
    j = records.join(last, "document_id", "full_outer")
    defaults = {"boost": F.lit(0), "hidden": F.lit(False)}
    return j.select(*[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.coalesce(c, defaults[c]).alias(c) if c in defaults else F.col(c) for c in records.columns])


def mark_indexed(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Records with the gates of ``updates`` (document_id, doc_updated_at, content_hash, chunk_count, last_indexed_at); unknown ids are ignored."""
    own = ["doc_updated_at", "content_hash", "chunk_count", "last_indexed_at"]
    j = records.join(updates.select("document_id", F.struct(*own).alias("n")), "document_id", "left")
    return j.select(*[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in records.columns])


#: Buckets of a snapshot table, by a hash of the document.
BUCKETS = 16


class Snapshots:
    """A table as immutable files in buckets by document, with a log of commits; readers see a commit whole or not at all.

    A commit names the folder of each bucket, and only the buckets of the documents it touches are written anew. A batch that
    was committed before is not committed again, which makes a stream's retries harmless. Of two writers one gets a `Conflict`.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.log = Commits(spark, f"{self.folder}/_commits")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*sorted(paths))

    def current(self) -> DataFrame | None:
        last = self.log.last()
        return self._read([p for ps in last["paths"].values() for p in ps]) if last and last["paths"] else None

    def has_batch(self, batch: str) -> bool:
        return any(c["batch"] == batch for c in self.log.all())

    def _write(self, df: DataFrame, touched: list[int], kept: dict, batch: str, add: bool = False) -> str:
        name = f"data-{uuid.uuid4().hex}"
        last = self.log.last()
        target = f"{self.folder}/{name}"
        df.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(target)
        made = {f.rpartition("=")[2] for f in self.log.folders(target)}
        paths = {b: list(ps) for b, ps in kept.items()}
        for b in map(str, touched):
            own = [f"{target}/_bucket={b}"] if b in made else []
            # a bucket that was emptied keeps no folder
            paths[b] = (paths.get(b, []) if add else []) + own
        self.log.claim(last["number"] + 1 if last else 1, {"paths": {b: ps for b, ps in paths.items() if ps}, "batch": batch})
        return name

    def commit(self, df: DataFrame, batch: str = "none") -> str:
        """The whole table anew."""
        if batch != "none" and self.has_batch(batch):
            return batch
        return self._write(df, list(range(self.buckets)), {}, batch)

    def _touched(self, documents: DataFrame) -> list[int]:
        return [r.b for r in documents.select(self._bucket().alias("b")).distinct().collect()]  # at most a row for each bucket

    def _part(self, touched: list[int]) -> DataFrame | None:
        last = self.log.last()
        paths = [p for b in map(str, touched) for p in (last or {"paths": {}})["paths"].get(b, [])]
        return self._read(paths) if paths else None

    def _rewrite(self, documents: DataFrame, change: Callable[[DataFrame | None], DataFrame | None], batch: str) -> str | None:
        if batch != "none" and self.has_batch(batch):
            return batch
        touched = self._touched(documents)
        df = change(self._part(touched)) if touched else None
        if df is None:
            return None
        last = self.log.last()
        return self._write(df, touched, last["paths"] if last else {}, batch)

    def replace(self, chunks: DataFrame, batch: str = "none") -> str | None:
        """Replaces the chunks' documents and commits; committing a batch again does nothing."""
        return self._rewrite(chunks, lambda now: chunks if now is None else replace(now, chunks), batch)

    def remove(self, documents: DataFrame, batch: str = "none") -> str | None:
        return self._rewrite(documents, lambda now: None if now is None else delete(now, documents), batch)

    def patch(self, changes: DataFrame, batch: str = "none") -> str | None:
        return self._rewrite(changes, lambda now: None if now is None else patch(now, changes), batch)

    def append(self, rows: DataFrame, batch: str = "none") -> str:
        if batch != "none" and self.has_batch(batch):
            return batch
        last = self.log.last()
        return self._write(rows, list(range(self.buckets)), last["paths"] if last else {}, batch, add=True)

    def vacuum(self, keep: int = 2) -> None:
        """Removes the folders that none of the last ``keep`` commits names; only while nobody writes."""
        named = {p.rpartition("/_bucket=")[0] for c in self.log.all()[-keep:] for ps in c["paths"].values() for p in ps}
        for f in self.log.folders(self.folder):
            if f.startswith("data-") and f"{self.folder}/{f}" not in named:
                self.log.remove(f"{self.folder}/{f}")


def merge_corpora(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of corpora; reading it fails if two rows share a key, without a pass of its own before."""
    u = reduce(lambda a, b: a.unionByName(b), parts)
    n = F.count("*").over(Window.partitionBy(*key))
    return u.withColumn("_n", F.when(n == 1, n).otherwise(F.raise_error(F.lit("two corpora share a key")).cast("long"))).where("_n = 1").drop("_n")


def random_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash; the same on every cluster."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def current_versions(deliveries: DataFrame) -> DataFrame:
    """The last version of each document within a batch."""
    w = Window.partitionBy("document_id").orderBy(F.col("doc_updated_at").desc_nulls_last(), F.col("received_at").desc_nulls_last(), F.col("delivery_id").desc())
    return deliveries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
