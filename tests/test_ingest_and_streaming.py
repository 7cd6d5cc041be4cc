import pytest
from pyspark.sql import functions as F

from folioforge.operators import incremental, ingest, vectors
from folioforge.operators.commits import Commits, Conflict
from folioforge.operators.incremental import IncrementalRun
from folioforge.streaming.ingest import Ingest


def nums(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "n long")


def spans(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def test_intervals(spark):
    a = incremental.intervals(nums(spark, [1, 2, 3, 3, None, 7, 65_535, 65_536]), "n")
    assert spans(a) == [(1, 3), (7, 7), (65_535, 65_535), (65_536, 65_536)]
    b = incremental.intervals(nums(spark, [4, 6, 9]), "n")
    assert spans(incremental.merge(a, b)) == [(1, 4), (6, 7), (9, 9), (65_535, 65_535), (65_536, 65_536)]
    assert sorted(r.n for r in incremental.subtract(nums(spark, [0, 1, 5, 7, 7, 8, 65_536]), "n", incremental.merge(a, b)).collect()) == [0, 5, 8]
    assert incremental.subtract(nums(spark, []), "n", a).count() == 0
    assert sorted(r.n for r in incremental.subtract(nums(spark, [3, -1]), "n", incremental.intervals(nums(spark, []), "n")).collect()) == [-1, 3]
    assert spans(incremental.intervals(nums(spark, [10, 30]), "n", among=nums(spark, [10, 20, 30, 40]))) == [(10, 10), (30, 30)]
    assert spans(incremental.intervals(nums(spark, [10, 20, 40]), "n", among=nums(spark, [10, 20, 30, 40]))) == [(10, 20), (40, 40)]


def test_runs_survive_failures_and_late_commits(spark, tmp_path):
    run = IncrementalRun(spark, str(tmp_path / "state"))
    src = lambda *xs: spark.createDataFrame([(x, f"v{x}") for x in xs], "n long, v string")
    assert run.run(src(), "n", lambda d: d) is None
    run.run(src(1, 2, 5), "n", lambda d: d)

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(src(1, 2, 5, 6), "n", lambda d: d, before_commit=fail)
    assert sorted(r.n for r in run.output().collect()) == [1, 2, 5]
    run.run(src(1, 2, 3, 5, 6), "n", lambda d: d)  # 3 comes late, 6 is made up for
    assert sorted(r.n for r in run.output().collect()) == [1, 2, 3, 5, 6]
    assert run.run(src(1, 2, 3, 5, 6), "n", lambda d: d) is None
    assert spans(run.state()) == [(1, 3), (5, 6)]


DELIVERY = "delivery_id long, document_id string, doc_updated_at timestamp, received_at timestamp, content_hash string, extra string"
RECORD = "document_id string, doc_updated_at timestamp, content_hash string, last_indexed_at timestamp, extra string"


def test_what_is_to_process(spark, tmp_path):
    t = lambda s: F.lit(s).cast("timestamp")
    d = spark.createDataFrame([], DELIVERY)
    rows = [(1, "new", None, "h"), (2, "same", "2030-01-01", "x"), (3, "later", "2030-01-02", "x"), (4, "sub", "2030-01-01 00:00:00.9", "y"), (5, "undated", None, " ABC "), (6, "undated2", None, "z"), (7, "never", "2030-01-01", "h"), (8, "nohash", None, "h"), (9, None, None, "h")]
    for i, k, at, h in rows:
        d = d.unionByName(spark.range(1).select(F.lit(i).cast("long").alias("delivery_id"), F.lit(k).cast("string").alias("document_id"), t(at).alias("doc_updated_at"), t("2031-01-01").alias("received_at"), F.lit(h).alias("content_hash"), F.lit("e").alias("extra")))
    d = d.unionByName(d)
    r = spark.createDataFrame([], RECORD)
    for k, at, h, seen in [("same", "2030-01-01", "o", "2030-02-01"), ("later", "2030-01-01", "x", "2030-02-01"), ("sub", "2030-01-01", "o", "2030-02-01"), ("undated", "2030-01-01", "abc", "2030-02-01"), ("undated2", None, "q", "2030-02-01"), ("never", "2030-01-01", "h", None), ("nohash", None, None, "2030-02-01")]:
        r = r.unionByName(spark.range(1).select(F.lit(k).alias("document_id"), t(at).alias("doc_updated_at"), F.lit(h).cast("string").alias("content_hash"), t(seen).alias("last_indexed_at"), F.lit("e").alias("extra")))
    assert sorted(x.document_id for x in incremental.to_process(d, r, str(tmp_path / "a")).collect()) == ["later", "never", "new", "nohash", "undated2"]
    assert incremental.to_process(d, r, str(tmp_path / "a")).count() == 0  # committed with the output
    state = incremental.intervals(nums(spark, [1, 3, 2, 4, 5]), "n")
    assert sorted(x.document_id for x in incremental.to_process(d, r, str(tmp_path / "b"), state).collect()) == ["never", "nohash", "undated2"]
    assert incremental.to_process(d.limit(0), r, str(tmp_path / "c")).count() == 0


def test_a_commit_is_claimed_once(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "log"))
    assert c.last() is None and c.all() == []
    c.claim(1, {"a": 1})
    with pytest.raises(Conflict):
        c.claim(1, {"a": 2})
    c.claim(2, {"a": 3})
    assert [x["a"] for x in c.all()] == [1, 3] and c.last() == {"a": 3, "number": 2}


def test_snapshots(spark, tmp_path):
    s = ingest.Snapshots(spark, str(tmp_path / "t"))
    df = lambda *r: spark.createDataFrame(list(r), "document_id string, x int")
    assert s.current() is None
    s.replace(df(("a", 1), ("a", 2), ("b", 3)), "b1")
    s.replace(df(("a", 9)), "b2")
    s.replace(df(("a", 7)), "b2")
    assert sorted((r.document_id, r.x) for r in s.current().collect()) == [("a", 9), ("b", 3)]


def test_snapshots_rewrite_touched_buckets_only_and_refuse_a_second_writer(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(list(r), "document_id string, x int, public boolean")
    s = ingest.Snapshots(spark, str(tmp_path / "t"), 8)
    s.replace(df(*((f"d{i}", i, True) for i in range(40))), "b1")
    before = s.log.last()["paths"]
    s.replace(df(("d3", 99, True)), "b2")
    after = s.log.last()["paths"]
    assert sum(before[b] != after[b] for b in before) == 1
    s.patch(spark.createDataFrame([("d4", False)], "document_id string, public boolean"), "b3")
    s.remove(df(("d5", 0, None)), "b4")
    assert {r.document_id: (r.x, r.public) for r in s.current().collect()} == {f"d{i}": (99 if i == 3 else i, i != 4) for i in range(40) if i != 5}
    s.vacuum(1)
    assert s.current().count() == 39
    with pytest.raises(Conflict):
        s.log.claim(s.log.last()["number"], {"paths": {}, "batch": "x"})


def delivery(spark, data):
    """One delivery of the test data as a template."""
    return spark.read.parquet(f"{data}/ingest_document.parquet").where("size(sections) > 0").limit(1)


def test_steps_of_a_batch(spark, data, tmp_path):
    one = delivery(spark, data)
    text = lambda t: F.transform("sections", lambda x: x.withField("text", F.lit(t)).withField("type", F.lit("text")))
    make = lambda name, t, h, title="T", mail="a@x", at=None: one.withColumn("document_id", F.lit(name)).withColumn("sections", text(t)).withColumn("title", F.lit(title)).withColumn("content_hash", F.lit(h)).withColumn("doc_updated_at", F.lit(at).cast("timestamp_ntz")).withColumn("external_access", F.struct(F.array(F.lit(mail)).alias("emails"), F.array().cast("array<string>").alias("groups"), F.lit(False).alias("is_public")))

    def embedder(t, dim, query):
        if "poison" in t:
            raise ValueError("refused")
        return vectors.hash_embedding(t, dim, query)

    e = Ingest(spark, str(tmp_path / "e"), embedder=embedder)
    rows = make("good", "some words", "H1").unionByName(make("bad", "poison here", "H2")).unionByName(make("blank", " ", "H3", "")).unionByName(make("also", "more words", "H4"))
    e.batch(rows, "one")
    got = {r.document_id: (r.outcome, r.reason) for r in e.outcomes("one").collect()}
    assert got == {"good": ("indexed", None), "bad": ("failed", "ValueError: refused"), "blank": ("dropped", None), "also": ("indexed", None)}
    now = e.chunks.current()
    assert {r.document_id for r in now.collect()} == {"good", "also"} and now.where("size(content_vector) = 64 and title_vector is not null").count() == now.count()
    marks = {r.document_id: r.last_indexed_at for r in e.records().collect()}
    assert marks["bad"] is None and marks["good"] is not None
    # the same hash in another case is skipped, but its new access reaches the chunks; what failed is tried again
    e.batch(make("good", "some words", " h1 ", mail="b@x").unionByName(make("bad", "clean now", "H2")), "two")
    assert {r.document_id: r.outcome for r in e.outcomes("two").collect()} == {"good": "skipped", "bad": "indexed"}
    acl = {r.document_id: r.access_control_list for r in e.chunks.current().collect()}
    assert acl["good"] == ["user_email:b@x"] and acl["also"] == ["user_email:a@x"] and set(acl) == {"good", "bad", "also"}


def test_merge_of_corpora_is_refused_on_clashes(spark):
    a = spark.createDataFrame([("x",)], "k string")
    with pytest.raises(Exception, match="share a key"):
        ingest.merge_corpora([a, a], ["k"]).collect()


def test_streamed_ingest_equals_one_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/ingest_document.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    e = Ingest(spark, str(tmp_path / "index"))
    q = e.stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.awaitTermination()
    assert q.exception() is None
    docs = src.select("document_id").distinct().count()
    became = {r.outcome: r["count"] for r in e.outcomes("batch-0").groupBy("outcome").count().collect()}
    assert sum(became.values()) == docs and e.records().count() == became["indexed"] == e.chunks.current().select("document_id").distinct().count()
    once = e.chunks.current().count()
    e.batch(src, "batch-0")  # a retried batch changes nothing
    assert e.chunks.current().count() == once
    e.batch(src, "other")  # and nothing is new
    assert e.chunks.current().count() == once
