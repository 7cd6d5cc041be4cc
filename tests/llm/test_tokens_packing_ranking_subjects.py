import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from folioforge.llm import packing, queries, ranking, subjects, tokens
from folioforge.llm.automaton import Transducer

VOCABULARY = tokens.vocabulary_file("byte_bpe_50k")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks_of(VOCABULARY), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZé '\n\t 19²½_.-'stvredlm あк😀́"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_ids_equal_the_public_tokenizer(encoder, reference, texts):
    ids, n = encoder.encode(texts)
    ends = np.cumsum(n)
    assert [ids[e - m : e].tolist() for e, m in zip(ends, n)] == [reference.encode_ordinary(t) for t in texts]
    assert encoder.counts(texts).tolist() == n.tolist()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 99), max_size=3), max_size=30), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer(tmp_path_factory, words, others):
    t = Transducer.compile(words)
    asked = [*words, *others]
    assert t.lookup(asked) == [words.get(w) if w else None for w in asked]
    t.save(path := str(tmp_path_factory.mktemp("t") / "x"))
    assert Transducer.open(path).lookup(asked) == t.lookup(asked)


def test_transducer_is_minimal():
    t = Transducer.compile({w + s: [1] for w in (b"a", b"b", b"c") for s in (b"ing", b"ed")})
    assert len(t.final) == 6  # root, one state after the first letter, i-n-g and e-d share their end


def test_encoding_with_and_without_lexicon(spark, reference):
    texts = ["the cat sat on the mat", None, "", " <|endoftext|> x", "x" * 30_000, "the the the"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for size in (100, 0):
        got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text", lexicon_size=size or 1).collect()}
        assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def check(sizes, capacity, rows):
    fill, seen = collections.Counter(), collections.Counter()
    for k, piece, start, size, c in rows:
        fill[c] += size
        seen[k] += size
    assert all(v <= capacity for v in fill.values())
    assert {k: seen[k] for k in seen} == {k: n or 0 for k, n in sizes.items()}
    return len([v for v in fill.values() if v])


@pytest.mark.parametrize("bucket, sent", [(100_000, 10**6), (7, 10**6), (100_000, 0)])
def test_containers(spark, monkeypatch, bucket, sent):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(packing, "RULES_SENT", sent)
    rng = random.Random(3)
    sizes = {i: rng.choice([rng.randint(1, 100), 37, 37, 250, None, 0]) for i in range(600)}
    df = spark.createDataFrame([(k, v, "clash") for k, v in sizes.items()], "k long, n long, piece string")
    rows = [tuple(r) for r in packing.containers(df, "k", "n", 100).collect()]
    assert all((c is None) == (size == 0) for _, _, _, size, c in rows)
    used = check(sizes, 100, rows)
    total = sum(v or 0 for v in sizes.values())
    assert used <= -(-total // 100) * 1.15
    assert all(len([r for r in rows if r[0] == k]) == max(1, -(-(n or 0) // 100)) for k, n in sizes.items())
    assert packing.containers(df.limit(0), "k", "n", 100).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(items):
    bins = []
    for s in sorted(items, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= s
        else:
            bins.append(20 - s)
    got = collections.Counter()
    for size, r0, r1, c0, q in packing.plan(collections.Counter(items), 20):
        for r in range(r0, r1):
            got[c0 + (r - r0) // q] += size
    assert sorted(20 - v for v in got.values()) == sorted(bins)


HIT = "qid string, score_kind string, chunk_uid long, score double, returned_at timestamp, rank int"


def hits(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(q, k, c, s, dt.datetime(2030, 1, 1, n // 60, n % 60), 1) for n, (q, k, c, s) in enumerate(rows)], HIT)


def walk_by_matrix(rows, d=0.85):
    items = sorted({c for _, _, c, _ in rows})
    kinds = sorted({k for _, k, _, s in rows if s is not None and s == s})
    p = np.zeros((len(items), len(items)))
    for k in kinds:
        s = {c: x for _, kk, c, x in rows if kk == k and x is not None and x == x}
        for i, a in enumerate(items):
            to = [j for j, b in enumerate(items) if b in s and (a not in s or s[b] >= s[a])]
            p[i, to] += 1 / len(to) / len(kinds)
    pi = np.full(len(items), 1 / len(items))
    for _ in range(500):
        pi = (1 - d) / len(items) + d * pi @ p
    return dict(zip(items, pi))


def test_walk_equals_the_dense_chain_both_ways(spark):
    rng = random.Random(2)
    rows = [("q", k, c, round(rng.random() * (1000 if k == "kw" else 1), 2)) for k in ("v", "t", "kw") for c in range(25) if rng.random() < 0.8]
    rows += [("q", "ties", c, 1.0) for c in range(20)]
    rows += [("q", "v", 77, None), ("q", "v", 78, float("nan")), ("q", "kw", 3, rows[-1][3])]
    rows = list({(q, k, c): (q, k, c, s) for q, k, c, s in rows}.values())
    want = walk_by_matrix(rows)
    for limit in (10**6, 1):
        got = {r.item: r.stationarity for r in ranking.rank_walk(hits(spark, rows), group_rows=limit).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    a, b = ({r.item: round(r.standing, 9) for r in ranking.rank_walk(hits(spark, rows), group_rows=g).collect()} for g in (10**6, 1))
    assert a == b


def test_scale_of_a_score_does_not_matter_and_odd_rows(spark):
    rows = [("q", "a", i, float(i)) for i in range(5)] + [("q", "b", i, float((i * 3) % 5)) for i in range(5)]
    big = [(q, k, c, s * 1e9 if k == "b" else s) for q, k, c, s in rows]
    order = lambda r: [x.item for x in sorted(ranking.ranked(ranking.rank_walk(hits(spark, r))).collect(), key=lambda x: x.rank)]
    assert order(rows) == order(big)
    odd = [("q", "a", 1, None), ("q", "a", 1, 0.5), ("q", "a", 1, None), (None, "a", 2, 1.0), ("q", None, 3, 1.0), ("r", "a", 9, None)]
    got = {(r.q, r.item): r.standing for r in ranking.rank_walk(hits(spark, odd)).collect()}
    assert got == {("q", 1): 1.0, ("q", 3): 0.0, ("r", 9): 0.0}
    assert ranking.ranked(ranking.rank_walk(hits(spark, odd).limit(0))).count() == 0


def test_subjects_on_held_out_documents(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    names = subjects.subjects_of(spark.read.parquet(f"{big}/subject_area.parquet"))
    labelled = subjects.labelled_documents(docs, spark.read.parquet(f"{big}/subject_label.parquet"), names)
    test = labelled.where("pmod(hash(doc_id), 5) = 0").cache()
    model = subjects.train(labelled.where("pmod(hash(doc_id), 5) <> 0"), names)
    truth = {r.doc_id: {names[i] for i in r.labels} for r in test.collect()}
    got = collections.defaultdict(set)
    for r in subjects.score(test.withColumnRenamed("labels", "subject"), model).collect():
        got[r.doc_id].add(r.subject)
    tp = sum(len(truth[d] & got[d]) for d in truth)
    assert tp / sum(map(len, got.values())) > 0.85 and tp / sum(map(len, truth.values())) > 0.85


def test_subjects_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "words here.", "x")], "doc_id long, text string, subject string")
    none = spark.createDataFrame([(3, "nothing known")], "doc_id long, subject string")
    model = subjects.train(subjects.labelled_documents(docs, none, ["law", "sport"]), ["law", "sport"])
    assert subjects.score(docs, model).count() == 0


def test_queries_have_their_columns(spark, data):
    assert queries.p7_ids(spark, data).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert queries.p9_found(spark, data).columns == ["doc_id", "subject"]
    assert queries.p6_found(spark, data).columns == ["qid", "chunk_uid"]
    assert queries.p1_found(spark, data).columns == queries.p3_found(spark, data).columns == ["item_kind", "item_id", "section_pos"]
