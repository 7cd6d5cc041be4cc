from datetime import datetime, timezone

import pytest

from folioforge.operators import filters
from folioforge.operators.filters import Filters, TimeRange


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, True, None, False, None, None), (2, False, ["user_email:a"], False, datetime(2030, 1, 1), datetime(2030, 1, 1)), (3, False, None, False, None, None), (4, None, ["external_group:g", None], True, datetime(2031, 1, 1), None)],
        "chunk_uid long, public boolean, access_control_list array<string>, hidden boolean, created_at timestamp, last_updated timestamp",
    )


def ids(rows, f):
    return sorted(r.chunk_uid for r in rows.where(filters.predicate(f)).collect())


def test_access(rows):
    assert ids(rows, Filters()) == [1, 2, 3]
    assert ids(rows, Filters(access=[])) == [1]
    assert ids(rows, Filters(access=filters.access_of("a"))) == [1, 2]
    assert ids(rows, Filters(access=filters.access_of(None, ["g", ""]), include_hidden=True)) == [1, 4]
    assert filters.access_of("a", bypass=True) is None


def test_negation_keeps_rows_with_null_access(rows):
    assert sorted(r.chunk_uid for r in rows.where(~filters.visible([])).collect()) == [2, 3, 4]


def test_undated_rows(rows):
    now = datetime(2031, 6, 1, tzinfo=timezone.utc)
    assert ids(rows, Filters(created=TimeRange(datetime(2030, 6, 1)))) == [1, 3]
    assert ids(rows, Filters(updated=TimeRange(datetime(2029, 1, 1)), now=now)) == [1, 2, 3]
    assert ids(rows, Filters(updated=TimeRange(datetime(2031, 5, 1)), now=now)) == []
    assert ids(rows, Filters(updated=TimeRange(datetime(2029, 1, 1), datetime(2031, 1, 1)), now=now)) == [2]


def test_time_ranges():
    a, b = TimeRange(datetime(2030, 1, 1)), TimeRange(end=datetime(2029, 1, 1))
    assert a.intersect(b).is_empty and a.has_bounds and not TimeRange().has_bounds
    assert a.start.tzinfo is timezone.utc


def test_exclusive_filters():
    with pytest.raises(ValueError):
        Filters(document_id="a", document_ids=["b"])


def test_evaluation_of_small_lists(spark):
    from folioforge.operators import evaluation

    t = spark.createDataFrame([(float(i),) for i in (5, 1, 2, 3, 4, 6, 7, 8, 9, 10)], "s double")
    assert tuple(evaluation.latency(t, "s").first()) == (6.0, 9.0)
    assert tuple(evaluation.latency(t.limit(0), "s").first()) == (None, None)
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "qid string, document_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 1), ("q", "c", 0), ("r", "a", 0)], "qid string, document_id string, relevance int")
    assert {r.qid: round(r.ndcg, 4) for r in evaluation.ndcg(ranked, qrels).collect()} == {"q": 0.5, "r": 0.0}
    assert {r.qid: round(r.ndcg, 4) for r in evaluation.ndcg(ranked, qrels, once=True).collect()} == {"q": 0.6309, "r": 0.0}
    assert {r.qid: r.recall for r in evaluation.recall(ranked, qrels, 2).collect()} == {"q": 0.0, "r": 0.0}
    assert {r.qid: round(r.mrr, 3) for r in evaluation.mrr(ranked, qrels).collect()} == {"q": 0.333, "r": 0.0}
