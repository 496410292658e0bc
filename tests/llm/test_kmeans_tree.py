import numpy as np
import pytest

from sluicegate.llm.kmeans_tree import fit_tree, left_out, nearest_neighbours
from sluicegate.llm.queries import op4_kmeans_tree

DATA = "/root/testdata/sf0.01"
ASKED = "vec_id % 10 = 0"


def exact(rows, k=10):
    """{query: [(score, id)]} by brute force over (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], dtype=np.float64)
    found = {}
    for i, v in rows:
        if i % 10 == 0:
            away = np.sqrt(((points - np.array(v, dtype=np.float64)) ** 2).sum(axis=1))
            found[i] = sorted((float(a), int(j)) for a, j in zip(away, ids) if j != i)[:k]
    return found


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, expected):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in e}) for q, e in expected.items())
    return hits / sum(map(len, expected.values()))


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_recall_and_scores(frame, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # a hot vector
    df = frame([(*r, 1.5) for r in rows], "vec_id bigint, embedding array<float>, leaf double")
    got = result(nearest_neighbours(df, ASKED, sample_rows=600, block_rows=block_rows))
    expected = exact(rows)
    assert got.keys() == expected.keys()
    assert recall(got, expected) >= 0.9
    of = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        for score, i in found:
            away = np.sqrt(((np.array(of[i], dtype=np.float64) - np.array(of[q], dtype=np.float64)) ** 2).sum())
            assert abs(score - away) < 1e-12
    assert got[2000] == [(0.0, i) for i in [5, *range(2001, 2010)]]


def test_unusable_and_repeated_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 0.5]), (2, [3.0, 0.0]),
        (10, None), (20, [0.0, 0.0]), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [None, 1.0]), (60, [1.0]), (70, []),
        (None, [1.0, 1.0]),
    ]
    got = result(nearest_neighbours(frame(rows, "vec_id bigint, embedding array<float>"), ASKED))
    assert got == {0: [(0.5, 1), (2.0, 2)]}


def test_empty_and_alone(frame):
    schema = "vec_id bigint, embedding array<float>"
    assert nearest_neighbours(frame([], schema), ASKED).collect() == []
    assert nearest_neighbours(frame([(0, None)], schema), ASKED).collect() == []
    assert nearest_neighbours(frame([(0, [1.0])], schema), ASKED).collect() == []


def test_search_visits_every_leaf_once():
    points = np.random.default_rng(2).normal(size=(500, 8))
    tree = fit_tree(points)
    order = list(tree.best_bins(points[3]))
    assert sorted(order) == list(range(tree.leaves))
    assert tree.visited(points[3], 2, [0] * tree.leaves, 1) == order
    assert tree.visited(points[3], 2, [1] * tree.leaves, 5) == order[:5]


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = result(op4_kmeans_tree(spark, DATA))
    expected = {q: e for q, e in exact(rows).items() if q % 100 == 0}
    assert got.keys() == expected.keys()
    assert recall(got, expected) >= 0.9


def test_rows_that_take_no_part_are_counted(frame):
    rows = [(i, [1.0 + i, 2.0]) for i in range(5)] + [(None, [1.0, 2.0]), (7, None), (8, [0.0, 0.0]), (9, [1.0]), (10, [float("nan"), 1.0])]
    found = left_out(frame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.reason: r.n for r in found} == {"no_id": 1, "no_vector": 3, "other_length": 1}
    assert left_out(frame([], "vec_id bigint, embedding array<double>")).collect() == []


def test_recall_on_a_table_larger_than_the_sample(frame):
    """Clustered vectors, four times as many as the tree is fitted on."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 16))
    points = centres[draw.integers(0, 40, 8000)] + 0.4 * draw.normal(size=(8000, 16))
    df = frame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in nearest_neighbours(df, ASKED, sample_rows=2000).collect():
        found.setdefault(r.query_id, []).append(r.score)
    recalls = []
    for query, scores in found.items():
        away = np.sort(np.sqrt(((points - points[query]) ** 2).sum(axis=1)))[1:11]
        recalls.append(np.mean(np.array(scores) <= away[-1] + 1e-9))
    assert np.mean(recalls) >= 0.95 and len(recalls) == 800
