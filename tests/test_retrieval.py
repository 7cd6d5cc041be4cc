from folioforge.operators import fusion, lexical, sections, vectors
from pyspark.sql import functions as F
import pytest


def test_phrases_and_slop(spark):
    rows = spark.createDataFrame([(1, "red fox runs"), (2, "red old fox"), (3, "fox red"), (4, "red very old fox"), (5, None), (6, "")], "chunk_uid long, content string")
    q = spark.createDataFrame([("q", "red fox")], "qid string, query_text string")
    got = {r.chunk_uid: r.score for r in lexical.phrases(rows, "chunk_uid", "content", q).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0


def test_bm25_of_nothing(spark):
    rows = spark.createDataFrame([], "chunk_uid long, content string")
    q = spark.createDataFrame([("q", "a")], "qid string, query_text string")
    assert lexical.bm25(rows, "chunk_uid", "content", q).count() == 0
    with pytest.raises(ValueError):
        lexical.top(rows, "chunk_uid", 10_001)


def test_knn_ignores_unusable_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [2.0, 0.0])], "k long, v array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "qid string, query_vector array<float>")
    got = vectors.knn(rows, "k", "v", q, 2, dim=2).orderBy("rank").collect()
    assert [(r.qid, r.k, r.score) for r in got] == [("a", 1, 1.0), ("a", 7, 1.0)]
    assert vectors.knn(rows, "k", "v", q.limit(0), 2, dim=2).count() == 0


def test_embeddings_repeat_and_differ_by_side(spark):
    a, b = vectors.hash_embedding("x y", 8), vectors.hash_embedding("x y", 8, True)
    assert (a == vectors.hash_embedding("x y", 8)).all() and (a != b).any() and abs((a * a).sum() - 1) < 1e-9
    df = spark.createDataFrame([("t",), ("t",), (None,)], "title string")
    assert vectors.embed_distinct(df, "title", "v", 8).where("v is not null").count() == 2


def test_rank_fusion_ties_and_scores(spark):
    lists = spark.createDataFrame([("q", 0, 1.0, 1, "a", 0.3), ("q", 0, 1.0, 2, "b", 0.2), ("q", 1, 1.0, 1, "b", 0.9), ("q", 1, 1.0, 2, "a", 0.8), ("q", 2, 0.0, 1, "z", None)], "qid string, list_idx int, weight double, rank int, k string, score double")
    got = fusion.reciprocal_rank(lists, ["k"]).orderBy("position").collect()
    assert [(r.k, r.score) for r in got] == [("a", 0.3), ("b", 0.2), ("z", None)]


def test_normalisation_of_equal_scores(spark):
    c = fusion.candidates(spark.createDataFrame([("q", "s", 1, 2.0), ("q", "s", 2, 2.0), ("q", "s", 2, 1.0), ("q", "s", 3, None), ("q", "s", 4, float("nan"))], "qid string, sub string, k int, score double"), "k")
    assert {r.norm for r in fusion.min_max(c).collect()} == {1.0} and {r.norm for r in fusion.z_score(c).collect()} == {0.0}
    with pytest.raises(ValueError):
        fusion.weighted_mean(fusion.min_max(c), "k", {"s": 0.4})


def test_relevance_windows(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 4, 5], c) for c in (0, 3, 5, 9)], "chunks array<int>, c int")
    got = df.select(sections.relevance_window(F.col("chunks"), F.col("c"), 4).alias("w")).collect()
    assert [r.w for r in got] == [[0, 1, 2, 3], [1, 2, 3, 4], [2, 3, 4, 5], [9]]


def test_merging(spark):
    r = spark.createDataFrame([("q", "d", i, n) for n, i in enumerate([4, 9, 3, 5, 1], 1)], "qid string, document_id string, chunk_index int, rank int")
    got = sections.merge_adjacent(r).orderBy("position").collect()
    assert [(x.first_chunk, x.last_chunk, x.center_chunk) for x in got] == [(3, 5, 4), (9, 9, 9), (1, 1, 1)]
    wide = sections.merge_adjacent(r).withColumn("first_chunk", F.col("first_chunk") - 1)
    m = sections.merge_overlapping(wide).orderBy("position").collect()
    assert [(x.first_chunk, x.last_chunk, x.center_chunk, x.n_merged) for x in m] == [(0, 5, 4, 2), (8, 9, 9, 1)]
    assert sections.merge_adjacent(r.limit(0)).count() == 0
    b = spark.createDataFrame([("q", i, t) for i, t in enumerate([10, 20, 30, 1], 1)], "qid string, position int, tokens int")
    assert [x.position for x in sections.trim_by_tokens(b, "tokens", 35).orderBy("position").collect()] == [1, 2]
    assert sections.trim_by_tokens(b, "tokens", 0).count() == 4


def test_query_variants(spark):
    q = spark.createDataFrame([("q", "Find x", "find X", ["a", "A"], ["m"]), ("r", "y", None, None, None)], "qid string, text string, rephrase string, keywords array<string>, model array<string>")
    got = [(r.qid, r.kind, r.text, round(r.weight, 2), r.alpha) for r in fusion.weighted_variants(q).orderBy("qid", "order").collect()]
    assert got == [("q", "keyword", "a", 2.0, 0.2), ("q", "semantic", "find X", 1.8, 0.5), ("q", "semantic", "m", 0.7, 0.5), ("r", "semantic", "y", 1.0, 0.5)]


def test_given_hits_are_fused_whole(spark, tmp_path):
    from folioforge.plans import catalogue

    spark.createDataFrame([("q", i, "keyword", float(i)) for i in range(700)], "qid string, chunk_uid long, score_kind string, score double").write.parquet(f"{tmp_path}/search_hit.parquet")
    assert catalogue.rrf_fusion(spark, str(tmp_path)).count() == 700
    best = catalogue.hybrid_minmax(spark, str(tmp_path)).where("chunk_uid = 650").first()
    assert abs(best.score - 0.5 * 650 / 699) < 1e-6


def test_approximate_search_recalls_the_exact_one(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{big}/document_chunk.parquet").dropDuplicates(["chunk_uid"])
    q = spark.read.parquet(f"{big}/search_query.parquet").select("qid", "query_vector").unionByName(rows.where("chunk_uid % 50 = 0").select(F.col("chunk_uid").cast("string").alias("qid"), F.col("content_vector").alias("query_vector")))
    pairs = lambda df: {(r.qid, r.chunk_uid) for r in df.collect()}
    exact, found = pairs(vectors.knn(rows, "chunk_uid", "content_vector", q, 10)), pairs(vectors.VectorIndex(rows, "chunk_uid", "content_vector").search(q, 10))
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)
    assert vectors.VectorIndex(rows.limit(0), "chunk_uid", "content_vector").search(q, 10).count() == 0


def test_stored_postings_serve_what_single_clauses_do(spark):
    rows = spark.createDataFrame([(1, "Red fox", "a red fox runs"), (2, None, "red red fox"), (3, "fox", ""), (4, "", "none of it")], "chunk_uid long, title string, content string")
    q = spark.createDataFrame([("q", "red fox"), ("r", "absent"), ("s", ""), ("t", None)], "qid string, query_text string")
    whole = {(r.qid, r.chunk_uid): r.score for r in lexical.fields(rows, "chunk_uid", q).collect()}
    parts = {}
    for field, (plain, phrase) in lexical.FIELDS.items():
        for df in (lexical.bm25(rows, "chunk_uid", field, q, boost=plain), lexical.phrases(rows, "chunk_uid", field, q, boost=phrase)):
            for r in df.collect():
                parts[(r.qid, r.chunk_uid)] = parts.get((r.qid, r.chunk_uid), 0) + r.score
    assert set(whole) == set(parts) == {("q", 1), ("q", 2), ("q", 3)} and all(abs(whole[x] - parts[x]) < 1e-9 for x in whole)


def _corpus(spark, folder, n=2000, asked=60):
    """Rows and queries that nearly all share words; a term twice in a query, missing texts and rows stored twice included."""
    vector = lambda i: [float((i * 7 + j * 13) % 11 - 5) for j in range(64)]
    text = lambda i: None if i % 291 == 6 else " ".join(f"w{(i * i + j * (i % 7 + 1)) % 23}" for j in range(1 + i % 9)) + " the"
    rows = [(i % (n - 10), f"d{i % (n - 10) // 4}", i % (n - 10) % 4, 512, f"W{i % (n - 10) % 23} note", text(i % (n - 10)), vector(i % (n - 10)), i % 3 != 0 if i < n - 10 else (i - n + 10) % 3 != 0, False, ["PUBLIC"]) for i in range(n)]
    spark.createDataFrame(rows, "chunk_uid long, document_id string, chunk_index int, max_chunk_size int, title string, content string, content_vector array<float>, public boolean, hidden boolean, access_control_list array<string>").write.parquet(f"{folder}/document_chunk.parquet")
    q = [(f"q{i}", f"w{i % 23} the w{(i * 5 + 1) % 23} w{i * 3 % 23} w{i * 3 % 23}", vector(i + 3)) for i in range(asked)] + [("none", None, None), ("blank", "?", vector(1))]
    spark.createDataFrame(q, "qid string, query_text string, query_vector array<float>").write.parquet(f"{folder}/search_query.parquet")


def _by_sql(sql, folder, cols):
    import duckdb

    c = duckdb.connect()
    for t in ("document_chunk", "search_query"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    r = c.execute(sql)
    at = [[x[0] for x in r.description].index(c) for c in cols]
    return sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=repr)


def _shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def shared_words(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    _corpus(spark, folder)
    return folder


@pytest.mark.parametrize("name", ["bm25_topk", "phrase_slop1", "bm25_boosted_fields", "bm25_filtered"])
def test_pairs_of_query_and_row_stay_in_their_task(spark, shared_words, name):
    from folioforge.plans import catalogue

    before = _shuffled(spark)
    df = catalogue.QUERIES[name](spark, shared_words)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == _by_sql(catalogue.SQL[name], shared_words, df.columns)
    # 120,000 pairs share a term; what is shuffled are 2,000 rows each time they are made unique and the best of each task
    assert _shuffled(spark) - before < 10_000


def test_phrases_of_long_queries_are_asked_to_their_end(spark, tmp_path):
    from folioforge.plans import catalogue

    spark.createDataFrame([(1, "u43 u44 x"), (2, "u2 y u3"), (3, "u39 u40 u41"), (4, None)], "chunk_uid long, content string").write.parquet(f"{tmp_path}/document_chunk.parquet")
    spark.createDataFrame([("q", " ".join(f"u{i}" for i in range(1, 51)), None), ("r", "", None)], "qid string, query_text string, query_vector array<float>").write.parquet(f"{tmp_path}/search_query.parquet")
    df = catalogue.phrase_slop1(spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == _by_sql(catalogue.SQL["phrase_slop1"], tmp_path, df.columns)
    assert {"q/43/2", "q/41/1", "q/39/3", "q/2/2"} <= {r[0] for r in got}


def test_hybrid_search_sends_only_the_best_of_each_task(spark, shared_words):
    from dataclasses import replace

    from folioforge.plans import search
    from folioforge.settings import DEFAULT

    rows, q = (spark.read.parquet(f"{shared_words}/{t}.parquet") for t in ("document_chunk", "search_query"))
    rows, few = rows.dropDuplicates(["chunk_uid"]), replace(DEFAULT, candidates=10)
    before = _shuffled(spark)
    got = {(r.qid, r.chunk_uid, r.rank): r.score for r in search.hybrid(rows, q, n=5, s=few).collect()}
    assert _shuffled(spark) - before < 40_000
    stored = {(r.qid, r.chunk_uid, r.rank): r.score for r in search.hybrid(rows, q, n=5, s=few, index=lexical.TextIndex(rows, "chunk_uid")).collect()}
    assert set(got) == set(stored) and all(abs(got[x] - stored[x]) < 1e-9 for x in got)
