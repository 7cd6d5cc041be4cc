"""Processing only new or changed records, by disjoint intervals of processed sequence numbers.

The state is a set of disjoint closed intervals of sequence numbers. A run subtracts
them from the numbers that are available, processes what is left (late commits that fill gaps
included), and commits the merged intervals together with its output: both are written to the run's own
folder, and one small commit file makes them visible at once. A run that fails before that file leaves the
state as it was, so the next one neither skips nor repeats anything.

Intervals never cross a multiple of ``SPAN``, so that all work on them is local to a bucket of bounded size.

Defined cases: null sequence numbers are left out; repeated ones count once; an empty state has no intervals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioforge.operators.commits import Commits

#: Sequence numbers of one bucket.
SPAN = 65_536


def _bucket(c: Column) -> Column:
    return F.floor(c / F.lit(SPAN)).cast("long")


def intervals(numbers: DataFrame, column: str, among: DataFrame | None = None) -> DataFrame:
    """(bucket, lo, hi): the numbers as disjoint intervals.

    With ``among``, numbers that follow one another among those are one interval, whether or
    not they are consecutive; what lies between them doesn't exist.
    """
    n = numbers.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct().withColumn("mine", F.lit(True))
    if among is not None:
        everything = among.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
        n = everything.join(n, "n", "left")
    n = n.withColumn("bucket", _bucket(F.col("n")))
    w = Window.partitionBy("bucket").orderBy("n")
    if among is None:
        n = n.withColumn("island", F.col("n") - F.row_number().over(w))
    else:
        n = n.withColumn("island", F.count_if(F.col("mine").isNull()).over(w)).where("mine")
    return n.groupBy("bucket", "island").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("island")


def merge(*sets: DataFrame) -> DataFrame:
    """The union of sets of intervals, those that touch or overlap as one."""
    u = sets[0].select("bucket", "lo", "hi")
    for s in sets[1:]:
        u = u.unionByName(s.select("bucket", "lo", "hi"))
    w = Window.partitionBy("bucket").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("new", F.coalesce(F.col("lo") > reach + 1, F.lit(True)))
    u = u.withColumn("island", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return u.groupBy("bucket", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def subtract(numbers: DataFrame, column: str, done: DataFrame) -> DataFrame:
    """(column): the distinct numbers outside all intervals; one window over each bucket, no range join."""
    n = numbers.select(F.col(column).cast("long").alias("lo")).where("lo is not null").distinct()
    n = n.select(_bucket(F.col("lo")).alias("bucket"), "lo", F.lit(None).cast("long").alias("hi"))
    w = Window.partitionBy("bucket").orderBy("lo", F.col("hi").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = n.unionByName(done.select("bucket", "lo", "hi")).withColumn("reach", F.max("hi").over(w))
    return both.where("hi is null and (reach is null or reach < lo)").select(F.col("lo").alias(column))


class IncrementalRun:
    """Runs over a growing source whose state and outputs lie in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, f"{self.folder}/_commits")

    def state(self) -> DataFrame:
        last = self.commits.last()
        if not last:
            return self.spark.createDataFrame([], "bucket long, lo long, hi long")
        return self.spark.read.schema("bucket long, lo long, hi long").parquet(f"{self.folder}/{last['run']}/intervals")

    def adopt(self, done: DataFrame) -> str:
        """Commits intervals that were processed before there was a log, as the first run without output."""
        run = f"run-{1:08d}-{uuid.uuid4().hex[:8]}"
        done.select("bucket", "lo", "hi").write.parquet(f"{self.folder}/{run}/intervals")
        self.commits.claim(1, {"run": run, "output": False})
        return run

    def run(self, source: DataFrame, column: str, process: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> str | None:
        """Processes the rows of ``source`` whose number isn't processed; the name of the run, None if there was nothing."""
        last = self.commits.last()
        done = self.state()
        number = last["number"] + 1 if last else 1
        run = f"run-{number:08d}-{uuid.uuid4().hex[:8]}"
        subtract(source, column, done).write.parquet(f"{self.folder}/{run}/gaps")
        gaps = self.spark.read.parquet(f"{self.folder}/{run}/gaps")
        if not gaps.limit(1).count():
            self.commits.remove(f"{self.folder}/{run}")
            return None
        process(source.join(gaps, column, "left_semi")).write.parquet(f"{self.folder}/{run}/output")
        merge(done, intervals(gaps, column)).write.parquet(f"{self.folder}/{run}/intervals")
        if before_commit:
            before_commit()
        self.commits.claim(number, {"run": run, "output": True})
        return run

    def output(self, run: str | None = None) -> DataFrame | None:
        """The output of all committed runs, or of one."""
        runs = [c["run"] for c in self.commits.all() if c["output"] and run in (None, c["run"])]
        return self.spark.read.parquet(*(f"{self.folder}/{r}/output" for r in runs)) if runs else None

    def vacuum(self) -> None:
        """Removes what runs that were never committed have left; only while no run is under way."""
        kept = {c["run"] for c in self.commits.all()}
        for name in self.commits.folders(self.folder):
            if name.startswith("run-") and name not in kept:
                self.commits.remove(f"{self.folder}/{name}")


def current_deliveries(deliveries: DataFrame, key: str = "document_id") -> DataFrame:
    """The current delivery of each document: latest doc_updated_at (undated last), received_at, delivery_id."""
    order = F.struct("doc_updated_at", "received_at", "delivery_id")
    return deliveries.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order.alias("o"), "content_hash")).alias("m")).select(key, "m.o.doc_updated_at", "m.o.received_at", "m.o.delivery_id", "m.content_hash")


def is_case(delivery: str = "d", record: str = "r") -> Column:
    """Whether a delivery is new or changed against its document's record."""
    c = lambda a, n: F.col(f"{a}.{n}")
    norm = lambda x: F.lower(F.trim(x))
    dated = c(delivery, "doc_updated_at").isNotNull() & c(record, "doc_updated_at").isNotNull()
    later = F.date_trunc("second", c(delivery, "doc_updated_at")) > F.date_trunc("second", c(record, "doc_updated_at"))
    changed = c(record, "content_hash").isNull() | ~norm(c(record, "content_hash")).eqNullSafe(norm(c(delivery, "content_hash")))
    return F.when(c(record, "document_id").isNull() | c(record, "last_indexed_at").isNull(), True).when(dated, later).otherwise(changed)


def settled(deliveries: DataFrame, records: DataFrame) -> DataFrame:
    """(bucket, lo, hi): the deliveries, current or not, that the records show to be processed, as intervals.

    This is how runs that kept no intervals, failed ones that finished some documents included, hand over their state.
    """
    one = deliveries.where("document_id is not null and delivery_id is not null").alias("d")
    open_ = one.join(records.alias("r"), F.col("d.document_id") == F.col("r.document_id"), "left").select("d.delivery_id", is_case().alias("open"))
    return intervals(open_.where("not open").select("delivery_id"), "delivery_id", among=one.select("delivery_id"))


def to_process(deliveries: DataFrame, records: DataFrame, folder: str, state: DataFrame | None = None) -> DataFrame:
    """(document_id, delivery_id): the current deliveries in the gaps of what is processed, as the output of one run in ``folder``.

    A folder without commits adopts what the records show to be settled, or ``state``. Superseded deliveries in the gaps are
    processed to nothing and committed with the rest. Deliveries without document or number are left out.
    """
    run = IncrementalRun(deliveries.sparkSession, folder)
    if run.commits.last() is None:
        run.adopt(settled(deliveries, records) if state is None else state)
    good = deliveries.where("document_id is not null and delivery_id is not null")
    current = current_deliveries(good).select("document_id", "delivery_id")
    done = run.run(good.select("delivery_id"), "delivery_id", lambda gaps: current.join(gaps, "delivery_id", "left_semi").select("document_id", "delivery_id"))
    return run.output(done) if done else deliveries.sparkSession.createDataFrame([], current.schema)
