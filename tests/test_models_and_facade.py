from pyspark.sql import functions as F

from folioforge.operators.filters import Filters
from folioforge.operators import vectors
from folioforge.plans import models, search as plans
from folioforge.plans.answer import Scripted, Turn
from folioforge.plans.facade import Engine


def test_a_model_is_asked_once_for_each_text_and_may_fail(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "bad")], "i int, t string")

    def model(x):
        if x == "bad":
            raise ValueError
        return x.upper()

    assert {r.i: r.o for r in models.apply(df, "t", "o", model).collect()} == {1: "A", 2: "A", 3: None, 4: None}
    assert {r.o for r in models.apply(df, "t", "o", None).collect()} == {None}


def test_query_expansion(spark):
    q = spark.createDataFrame([("q", "what is x")], "qid string, text string")
    r = models.expand_queries(q, lambda t: " rephrased ", lambda t: "- one\n\n2. two\nthree\nfour").first()
    assert (r.rephrase, r.keywords) == ("rephrased", ["one", "two", "three"])
    r = models.expand_queries(q).first()
    assert (r.rephrase, r.keywords) == (None, [])


def test_selection_falls_back(spark):
    f = spark.createDataFrame([("q", i + 1, f"s{i}") for i in range(4)] + [("r", 1, "only")], "qid string, position int, content string")
    got = models.select_sections(f, lambda p: "[2, 0, 9]" if "s1" in p else "none of them", 3).collect()
    assert sorted((r.qid, r.picked, r.position) for r in got) == [("q", 1, 3), ("q", 2, 1), ("r", 1, 1)]
    assert models.select_sections(f, None, 2).count() == 3


def test_highlights(spark):
    df = spark.createDataFrame([("The red fox and the RED car. " + "x " * 200 + "a redder fox", ["red", "fox"])], "t string, w array<string>")
    h = df.select(models.highlights(F.col("t"), F.col("w")).alias("h")).first().h
    assert h[0].startswith("The <hi>red</hi> <hi>fox</hi> and the <hi>RED</hi>") and h[1].endswith("redder <hi>fox</hi>")


def test_engine_from_ingest_to_answer(spark, data, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    src = spark.read.parquet(f"{data}/ingest_document.parquet")
    c = e.ingest(src, "one").first()
    assert c.total == src.select("document_id").distinct().count() and c.indexed == c.new > 0.8 * c.total and c.failures == 0 == e.failures().count()
    again = e.ingest(src, "two").first()
    assert again.indexed == 0 and again.skipped + again.failures + c.total - c.indexed >= c.total
    text = e.store.chunks.current().where("public and length(content) > 200").orderBy("document_id").first()
    q = spark.createDataFrame([("q", " ".join(text.content.split()[:12]))], "qid string, query_text string")
    assert text.document_id in {r.document_id for r in e.search(q, Filters(access=[])).collect()}
    m = plans.Models(rephrase=lambda t: t.upper(), keywords=lambda t: t.split()[0], select=lambda p: "[0, 1]", classify=lambda t: "2")
    wide = e.search(q, Filters(access=[]), m=m).collect()
    assert 1 <= len(wide) <= 2 and {r.position for r in wide} <= {1, 2}
    # filters reach what was written
    rows = e.index()
    tag = rows.where("size(metadata_list) > 0").selectExpr("metadata_list[0] as t").first().t
    tagged = {r.chunk_uid for r in plans.hybrid(rows, vectors.embed(q, "query_text", "query_vector", 64, True), Filters(tags=[tag]), n=500).collect()}
    assert tagged == {r.chunk_uid for r in rows.where(F.array_contains("metadata_list", tag) & ~F.col("hidden")).collect()} and tagged
    some = rows.where("size(document_sets) > 0").selectExpr("document_sets[0] as t").first().t
    assert {r.chunk_uid for r in plans.hybrid(rows, vectors.embed(q, "query_text", "query_vector", 64, True), Filters(document_sets=[some]), n=500).collect()} == {r.chunk_uid for r in rows.where(F.array_contains("document_sets", some) & ~F.col("hidden")).collect()}
    assert rows.where("created_at is not null").count() > 0
    ev = list(e.answer(q.first().query_text, Scripted([Turn(searches=[q.first().query_text]), Turn(tokens=["See [1]."])]), Filters(access=[])))
    assert ev[-1]["type"] == "done" and ev[-1]["cited"]
    e.delete(spark.createDataFrame([(text.document_id,)], "document_id string"))
    assert text.document_id not in {r.document_id for r in e.store.chunks.current().select("document_id").collect()}
