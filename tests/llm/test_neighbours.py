import numpy as np
import pytest

from cohortry.llm import neighbours
from cohortry.llm.neighbours import nearest, scan
from tests.conftest import SMALL

COLUMNS = "vec_id long, embedding array<float>, label int, entry string, list string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], COLUMNS)


def brute(rows, every, count=10, kind=np.float32):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        kept.append((i, tuple(float(kind(x)) for x in v)))
    kept = sorted(set(kept))
    found = []
    for q, u in kept:
        if q % every == 0:
            each = sorted(
                (float(np.sqrt(((np.array(u, float) - np.array(v, float)) ** 2).sum())), i) 
                for i, v in kept
                if i != q and len(u) == len(v)
            )
            found += [(q, rank + 1, i, s) for rank, (s, i) in enumerate(each[:count])]
    return found


def same(result, expected):
    rows = sorted(tuple(r) for r in result.collect())
    assert [r[:3] for r in rows] == [r[:3] for r in sorted(expected)]
    assert np.allclose([r[3] for r in rows], [r[3] for r in sorted(expected)], rtol=1e-12)


@pytest.mark.parametrize("directory", [SMALL, "/root/testdata/sf0.01"])
def test_recall_on_given_vectors(spark, directory):
    vectors = spark.read.parquet(f"{directory}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    found = {(r["query_id"], r["vec_id"]) for r in nearest(vectors, every=25).collect()}
    expected = {(q, i) for q, _, i, _ in brute(rows, 25)}
    assert len(found & expected) / len(expected) >= 0.9


def test_few_vectors_are_searched_whole(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(30)]
    same(nearest(frame(spark, rows), every=10), brute(rows, 10))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    rows += [(None, [1.0, 0.5]), (10, [1.0, 1.0]), (7, [2.0, 2.0])]
    same(nearest(frame(spark, [*rows, (8, [1.0]), (9, [])]), every=10), brute(rows, 10))


def test_ties_and_repeated_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (201, [1.0, 3.0])]
    same(nearest(frame(spark, rows), every=20), brute(rows, 20))


def test_empty_tables(spark):
    for rows in ([], [(0, [0.0, 0.0])]):
        assert nearest(frame(spark, rows), every=10).count() == 0
    assert nearest(frame(spark, [(0, [1.0])]), every=10).count() == 0


def doubles(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_vectors_that_differ_beyond_single_precision(spark):
    rows = [(i, [1.0 + i * 1e-9, 2.0]) for i in range(40)]
    same(nearest(doubles(spark, rows), every=10), brute(rows, 10, kind=float))


def test_large_components(spark):
    draw = np.random.default_rng(8)
    rows = [(i, (draw.normal(size=5) * 1e8 + 1e9).tolist()) for i in range(60)]
    same(nearest(doubles(spark, rows), every=20), brute(rows, 20, kind=float))


@pytest.mark.parametrize("lengths", [neighbours.INDEXED_LENGTHS, 1, 0])
def test_vectors_of_several_lengths(spark, monkeypatch, lengths):
    monkeypatch.setattr(neighbours, "INDEXED_LENGTHS", lengths)
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=(2, 3, 7)[i % 3]).tolist()) for i in range(120)] + [(400, [1.0])]
    same(nearest(doubles(spark, rows), every=20), brute(rows, 20, kind=float))


def test_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (0, [1.0, 0.0])]
    found = sorted(tuple(r) for r in nearest(doubles(spark, rows), every=10).collect())
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2)]


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(10_000)] + [(20_000, [1.0, 2.0, 4.0])]
    found = nearest(doubles(spark, rows), every=5000).collect()
    by_query = {q: [(r["vec_id"], r["score"]) for r in found if r["query_id"] == q] for q in (0, 5000, 20_000)}
    assert by_query[0] == [(i, 0.0) for i in range(1, 11)] and by_query[5000] == [(i, 0.0) for i in range(10)]
    assert by_query[20_000] == [(i, 1.0) for i in range(10)]


def clustered(count, clusters, size, seed):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(clusters, size)) * 10
    return middles[draw.integers(0, clusters, count)] + draw.normal(size=(count, size))


def test_clustered_vectors_need_few_lists(spark):
    values = clustered(6000, 40, 16, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    entries = neighbours.entries_of(neighbours.usable(doubles(spark, rows)), 11)
    index = neighbours.indexed(entries, 4000, 128, 10, 0.97)[16]
    assert index.probes <= len(index.centres) / 4
    found = {(r["query_id"], r["vec_id"]) for r in nearest(doubles(spark, rows), 100).collect()}
    expected = {(q, i) for q, _, i, _ in brute(rows, 100, kind=float)}
    assert len(found) == len(expected) and len(found & expected) / len(expected) >= 0.95


def test_lists_are_split_as_the_table_grows(spark):
    values = clustered(4000, 30, 8, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    entries = neighbours.entries_of(neighbours.usable(doubles(spark, rows)), 11)
    index = neighbours.indexed(entries, 1000, 16, 10, 0.97)[8]
    assert 100 <= len(index.centres) <= 128
    found = {(r["query_id"], r["vec_id"]) for r in nearest(doubles(spark, rows), 100, 10, 1000, 16).collect()}
    expected = {(q, i) for q, _, i, _ in brute(rows, 100, kind=float)}
    assert len(found) == len(expected) and len(found & expected) / len(expected) >= 0.95


def test_a_query_goes_on_until_its_answer_is_full():
    index = neighbours.Index(np.array([[0.0], [10.0], [20.0]]), 1, np.array([3, 4, 50]))
    taken, lists = index.lists(np.array([[1.0], [19.0]]), 11)
    assert list(zip(taken.tolist(), lists.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 2)]


def test_scan_finds_what_all_columns_find():
    draw = np.random.default_rng(4)
    vectors, queries = draw.normal(size=(800, 64)), draw.normal(size=(40, 64))
    turn = neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    true = np.sqrt(((vectors[None] - queries[:, None]) ** 2).sum(2))
    limits = np.sort(true, axis=1)[:, 20]
    counts = []
    for given in (None, limits):
        at, to, exact = scan(queries, vectors, turn, 11, given)
        assert np.allclose(exact, true[at, to])
        pairs = set(zip(at.tolist(), to.tolist(), strict=True))
        hits = sum((i, j) in pairs for i in range(40) for j in true[i].argsort()[:10])
        assert hits / 400 >= 0.98
        counts.append(len(pairs))
    assert counts[1] <= counts[0] and counts[1] < 40 * 800 / 4
