import itertools
import random

import numpy as np
import pytest

from folioforge.llm import nearcopies, neighbours, queries


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_recall_against_brute_force(spark, data):
    df = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/document_chunk.parquet").select("chunk_uid", "content_vector")
    rows = {r[0]: np.array(r[1]) for r in neighbours.codes(df, "chunk_uid", "content_vector", 64).select("uid", "code").rdd.map(lambda r: (r[0], np.frombuffer(bytes(r[1]), np.int16).tolist())).collect()}
    ids = sorted(rows)
    best, s = exact(np.array([rows[i] for i in ids], float), 10)
    got = {}
    for r in neighbours.nearest(df, "chunk_uid", "content_vector").collect():
        got.setdefault(r.uid, set()).add(r.neighbour)
    hits = [len(got[i] & {ids[j] for j in best[n]}) for n, i in enumerate(ids)]
    assert sum(hits) / (10 * len(ids)) >= 0.9
    true = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in best[a] if s[a, b] >= 0.96}
    found = {(r.uid_a, r.uid_b) for r in neighbours.alike(neighbours.nearest(df, "chunk_uid", "content_vector"), 0.96).collect()}
    assert len(found & true) >= 0.99 * len(true) and len(found - true) <= 0.01 * len(true)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>, neighbour string")


def test_odd_vectors_copies_and_few_rows(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one, "c"), (1, one, "c"), (2, None, "c"), (3, [0.0] * 4, "c"), (4, [float("nan")] * 4, "c"), (5, [1.0], "c"), (6, [2.0, 0.0, 0.0, 0.0], "c"), (7, [1.0, 0.1, 0.0, 0.0], "c"), (None, one, "c"), (8, [1.0, None, 0.0, 0.0], "c")]
    r = neighbours.nearest(frame(spark, rows), "id", "v", k=3, dim=4).collect()
    got = {i: [(x.neighbour, round(x.cosine, 3)) for x in sorted(r, key=lambda x: x.rank) if x.uid == i] for i in {x.uid for x in r}}
    assert got == {1: [(6, 1.0), (7, 0.995)], 6: [(1, 1.0), (7, 0.995)], 7: [(1, 0.995), (6, 0.995)]}
    assert neighbours.nearest(frame(spark, []), "id", "v", k=3, dim=4).count() == 0
    assert neighbours.nearest(frame(spark, rows[:1]), "id", "v", k=3, dim=4).count() == 0


def test_many_copies_and_split_files(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [0.5, 0.5, 0.5, 0.5], "c") for i in range(200)] + [(1000 + i, rng.normal(size=4).tolist(), "c") for i in range(300)]
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    monkeypatch.setattr(neighbours, "POST_BLOCK", 40)
    r = neighbours.nearest(frame(spark, rows), "id", "v", k=5, dim=4, pivots=1, post=16, probe=8).collect()
    by = {}
    for x in r:
        by.setdefault(x.uid, {})[x.neighbour] = x.cosine
    assert len(by) == 500 and all(len(v) == 5 for v in by.values())
    assert set(by[7]) == {0, 1, 2, 3, 4} and set(by[3]) == {0, 1, 2, 4, 5}
    x = np.array([v for _, v, _ in rows[200:]])
    best, s = exact(x, 5)
    near = [np.mean([by[1000 + i].get(1000 + j, 0) > 0 or min(by[1000 + i].values()) >= s[i, j] - 1e-3 for j in best[i]]) for i in range(300)]
    assert np.mean(near) > 0.97


def test_only_the_least_footrule_is_reranked():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = neighbours.orders(x, x[:64])
    apart = np.bitwise_count(w[:5, None, :] ^ w[None]).sum(2).astype(int)
    best, how = neighbours.ranked(x[:5], x, w[:5], w, np.arange(300) == np.arange(5)[:, None], 3, 40)
    for i in range(5):
        least = np.sort(np.delete(apart[i], i))[38]
        assert i not in best[i] and len(set(best[i])) == 3 and (apart[i][best[i]] <= least + 1).all() and (np.diff(how[i]) <= 0).all()


def test_recall_in_even_clusters(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, 40, 6000)] + 0.35 * rng.normal(size=(6000, 64)) / 8
    best, _ = exact(x, 10)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    got = {}
    for r in neighbours.nearest(df, "id", "v").collect():
        got.setdefault(r.uid, set()).add(r.neighbour)
    assert np.mean([len(got[i] & set(best[i].tolist())) for i in range(6000)]) >= 9


def similarity(a, b, k=3):
    g = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (nearcopies.words_of(a), nearcopies.words_of(b))]
    return len(g[0] & g[1]) / len(g[0] | g[1])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    stock = "this stock phrase is found in nearly every text of the corpus and tells nothing"
    rows = []
    for g in range(60):
        sents = [" ".join(rng.choices(vocab, k=12)) + "." for _ in range(8)]
        for v in range(4):
            s = list(sents)
            if v == 1:
                rng.shuffle(s)
            if v == 2:
                s[3] = s[3].replace(" ", " x ", 1).upper()
            if v == 3:
                s.insert(2, "An added sentence of some words.")
            rows.append(("chunk", len(rows), None, stock + ". " + " ".join(s), "extra"))
    rows += [("chunk", 900, None, "too short", "extra"), ("chunk", 901, None, None, "extra"), ("chunk", 902, None, "", "extra")]
    rows += [("document", 1, "d1", rows[0][3], "e"), ("document", 2, "d1", rows[0][3], "e"), ("document", 3, "d2", rows[0][3], "e"), ("document", 4, "d3", rows[1][3], "e")]
    return rows + rows[:3]


def test_pairs_against_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "kind string, id long, grp string, text string, text_key string")
    n = nearcopies.NearCopies(df, 3, 0.6, 40)
    items = {(k, i): (g, t) for k, i, g, t, _ in corpus if t and len(nearcopies.words_of(t)) >= 40}
    true = set()
    for (a, (ga, ta)), (b, (gb, tb)) in itertools.combinations(sorted(items.items()), 2):
        if a[0] == b[0] and (ga is None or ga != gb) and similarity(ta, tb) >= 0.6:
            true.add((a[0], a[1], b[1]))
    got = {(r.kind, r.id_a, r.id_b) for r in n.pairs().collect()}
    assert got <= true and len(got) >= 0.99 * len(true)
    groups = {(r.kind, r.id): (r.group_id, r.n_links) for r in n.groups().collect()}
    assert groups[("chunk", 5)][0] == groups[("chunk", 4)][0] == 4 and groups[("document", 4)][0] == 1
    assert ("chunk", 900) not in groups and len(groups) == len(items)


def test_empty_collection(spark, corpus):
    df = spark.createDataFrame(corpus, "kind string, id long, grp string, text string, text_key string").limit(0)
    n = nearcopies.NearCopies(df)
    assert n.pairs().count() == 0 and n.groups().count() == 0


def test_hot_group_of_copies_is_linear(spark):
    text = " ".join(f"u{i}" for i in range(60))
    df = spark.createDataFrame([("chunk", i, None, text) for i in range(400)], "kind string, id long, grp string, text string")
    n = nearcopies.NearCopies(df, 3, 0.6, 40)
    assert n.pairs().count() == 399
    assert {r.group_id for r in n.groups().collect()} == {0}


def family(size, words, edits, seed=1):
    """Texts that differ from one another by a few words each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    texts = []
    for _ in range(size):
        w = list(base)
        for j in rng.sample(range(words), edits):
            w[j] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def linked(texts, least=0.6, k=3):
    """Brute force by a matrix of shared k-mers."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in map(str.split, texts)]
    names = {x: n for n, x in enumerate(set().union(*sets))}
    m = np.zeros((len(texts), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[x] for x in s]] = 1
    both = m @ m.T
    n = m.sum(1)
    a, b = np.nonzero(np.triu(both / (n[:, None] + n[None, :] - both) >= least - 1e-6, 1))
    return set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("others, size, words, edits", [(3000, 120, 60, 2), (400, 400, 120, 3)])
def test_hot_group_of_differing_texts(spark, others, size, words, edits):
    texts = family(size, words, edits)
    true = linked(texts)
    rng = random.Random(2)
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(others)]
    n = nearcopies.NearCopies(spark.createDataFrame([("chunk", i, None, t) for i, t in enumerate(texts)], "kind string, id long, grp string, text string"), 3, 0.6, 40)
    assert {(r.id_a, r.id_b) for r in n.pairs().collect()} == true
    groups = {r.id: r for r in n.groups().collect()}
    degree = np.bincount(np.array(sorted(true)).ravel(), minlength=size)
    assert all(groups[i].n_links == degree[i] for i in range(size)) and {groups[i].group_id for p in true for i in p} == {0}


def test_large_buckets_are_parted_and_lose_no_pairs(spark, monkeypatch):
    texts = family(300, 60, 2) + family(40, 60, 2, 9)
    true = linked(texts)
    df = spark.createDataFrame([("chunk", i, None, t) for i, t in enumerate(texts)], "kind string, id long, grp string, text string")
    monkeypatch.setattr(nearcopies, "BUCKET", 20)
    for partitions in (2, 7):
        n = nearcopies.NearCopies(df.repartition(partitions), 3, 0.6, 40)
        assert {(r.id_a, r.id_b) for r in n.pairs().collect()} == true


def test_blocks_meet_whole(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BUCKET", 20)
    df = spark.createDataFrame([(7, i, 50, 1, 2, 3, 4) for i in range(100)], "bucket long, text_key long, size int, b0 long, b1 long, b2 long, b3 long")
    got = nearcopies.in_blocks(df.select("bucket", "text_key"), df.drop("bucket"), 0.6).collect()
    assert len(got) == len(set(got)) == 4950


def test_a_hot_bucket_is_told_by_its_batch_and_found_in_the_sorted_pass(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BUCKET", 4)
    rows = [(1, i, 0) for i in range(4)] + [(2, i, 0) for i in range(5)] + [(3, 1, 0)] + [(4, i, 1) for i in range(6)] + [(4, 0, 2), (4, 9, 0)]
    got = nearcopies.buckets(spark.createDataFrame(rows, "bucket long, text_key long, role tinyint")).collect()
    assert sorted((r.bucket, r.text_key, r.large) for r in got) == sorted([(1, i, False) for i in range(4)] + [(2, i, True) for i in range(5)] + [(4, i, True) for i in range(6)] + [(4, 9, True)])


def test_copies_are_counted_as_links(spark):
    words = [f"u{i}" for i in range(60)]
    near = " ".join(words[:59] + ["edit"])
    rows = [("document", i, "hot", " ".join(words)) for i in range(150)] + [("document", 500 + i, f"d{i}", " ".join(words)) for i in range(3)] + [("document", 900, "d0", near), ("document", 901, None, near)]
    groups = {r.id: r.n_links for r in nearcopies.NearCopies(spark.createDataFrame(rows, "kind string, id long, grp string, text string"), 3, 0.6, 40).groups().collect()}
    grp = {r[1]: r[2] for r in rows}
    assert groups == {i: sum(j != i and (grp[i] is None or grp[j] != grp[i]) for j in grp) for i in grp}


def test_texts_of_few_distinct_words(spark):
    texts = ["a b " * 25, "a b " * 30, "a b " * 20 + "c", "d e f " * 20, "d e f " * 15 + "g", "a " * 50]
    true = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similarity(texts[a], texts[b]) >= 0.6}
    got = nearcopies.NearCopies(spark.createDataFrame([("chunk", i, None, t) for i, t in enumerate(texts)], "kind string, id long, grp string, text string"), 3, 0.6, 40).pairs().collect()
    assert {(r.id_a, r.id_b) for r in got} == true and len(true) >= 3


def test_repeated_passages_are_decided_by_jaccard(spark):
    one = [f"p{i}" for i in range(50)]
    edited = one * 4
    edited[70] = "edit"
    texts = [" ".join(one), " ".join(one * 4), " ".join(edited), " ".join(f"q{i}" for i in range(50))]
    n = nearcopies.NearCopies(spark.createDataFrame([("chunk", i, None, t) for i, t in enumerate(texts)], "kind string, id long, grp string, text string"), 3, 0.6, 40)
    true = {(a, b) for a, b in itertools.combinations(range(4), 2) if similarity(texts[a], texts[b]) >= 0.6}
    assert {(r.id_a, r.id_b) for r in n.pairs().collect()} == true == {(0, 1), (0, 2), (1, 2)}
    assert n.alignments().count() == 3


def test_copies_within_a_hot_document_keep_partners(spark):
    words = [f"u{i}" for i in range(60)]
    near = " ".join(words[:59] + ["edit"])
    rows = [("document", i, "hot", " ".join(words)) for i in range(150)] + [("document", 500 + i, f"d{i}", " ".join(words)) for i in range(3)]
    rows += [("document", 1000 + i, "hot", near) for i in range(150)] + [("document", 2000, "far", near)]
    p = nearcopies.NearCopies(spark.createDataFrame(rows, "kind string, id long, grp string, text string"), 3, 0.6, 40).pairs().collect()
    grp = {r[1]: r[2] for r in rows}
    assert {i for r in p for i in (r.id_a, r.id_b)} == set(grp) and all(grp[r.id_a] != grp[r.id_b] for r in p)


def test_links_at_the_limit_are_candidates(spark):
    texts = [" ".join([f"a{g}x{i}" for i in range(47)] + [f"b{g}x{v}x{i}" for i in range(15)]) for g in range(300) for v in range(2)]
    df = spark.createDataFrame([("chunk", i, None, t) for i, t in enumerate(texts)], "kind string, id long, grp string, text string")
    assert similarity(texts[0], texts[1]) == 0.6
    assert {(r.id_a, r.id_b) for r in nearcopies.NearCopies(df, 3, 0.6, 40).pairs().collect()} == {(2 * g, 2 * g + 1) for g in range(300)}


def test_aligned_follows_moved_passages():
    w = np.arange(100, dtype=np.uint64)
    moved = np.concatenate([w[50:], w[:50]])
    k = lambda x: nearcopies.kmers(x, np.array([0]), np.array([len(x)]), 3)[0]
    assert nearcopies.aligned(w, moved, k(w), k(moved), 3) > 0.95
    assert nearcopies.aligned(w, w + np.uint64(1000), k(w), k(w + np.uint64(1000)), 3) == 0


def test_queries_run_on_the_small_data(spark, data):
    assert queries.p2_found(spark, data).columns == ["item_kind", "id_a", "id_b"]
    assert queries.p4_found(spark, data).columns == ["uid_a", "uid_b"]
