import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.llm.kd_search import Part, approximate_neighbours, box_gaps, build_index, chi_square_cdf, leaves, quantile, shadows, upper_levels
from tabspark.llm.mtree import exact_top_k


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    v = (centres[rng.integers(0, 6, 700)] + 0.3 * rng.normal(size=(700, 12))).astype(np.float32)
    v[300:420] = v[300]  # a very common vector
    rows = [(i, v[i].tolist(), "x") for i in range(700)]
    odd = [
        (1000, None, "x"), (1020, [], "x"), (1040, [None] + [1.0] * 11, "x"), (1060, [float("nan")] * 12, "x"),
        (1080, [float("inf")] + [0.0] * 11, "x"), (None, [1.0] * 12, "x"), (1100, [1.0, 2.0], "x"),
        (5, v[5].tolist(), "x"),
    ]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, shard string")


def brute(df, every, k, to, drop_zero=False):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.distinct().collect()
            if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]
            and np.isfinite(r["embedding"]).all()]
    rows = [(i, to(v)) for i, v in rows if not drop_zero or v.any()]
    out = {}
    for i, q in rows:
        if i % every == 0:
            found = [(-float(q @ v), j) for j, v in rows if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard_rows", [90, 8192])
def test_mtree_equals_brute_force(vectors, shard_rows):
    found = results(exact_top_k(vectors, every=7, k=5, page_rows=16, fanout=4, shard_rows=shard_rows,
                                block_rows=40))
    expected = brute(vectors, 7, 5, lambda v: np.floor(256 * v))
    assert found == {k: v for k, v in expected.items() if v}


def test_neighbours_reach_the_recall(vectors):
    df = approximate_neighbours(vectors, every=5, k=20, page_rows=8, shard_rows=200)
    found, expected = results(df), brute(vectors, 5, 20, lambda v: v, True)
    expected = {k: v for k, v in expected.items() if v}
    assert set(found) == set(expected)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in v}) for q, v in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, rows in found.items():
        scores = [s for _, s in rows]
        assert scores == sorted(scores, reverse=True) and q not in [i for i, _ in rows]


def test_clustered_neighbours_are_found_among_few(spark):
    """Cells and the stopping test leave most vectors alone; a hot vector is dealt in parts."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[1000:2400] = v[1000]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = build_index(df, shard_rows=300, page_rows=16)
    assert index.cells.count() > 6 and index.cells.agg(F.max("parts")).first()[0] > 1
    assert index.pages.agg(F.sum(F.size("ids"))).first()[0] == 4000
    out = approximate_neighbours(df, every=40, k=10, shard_rows=300, page_rows=16)
    found, expected = results(out), brute(df, 40, 10, lambda x: x)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in rows}) for q, rows in expected.items()
               if not 1000 <= q < 2400)
    wanted = sum(len(rows) for q, rows in expected.items() if not 1000 <= q < 2400)
    assert hits >= 0.9 * wanted and set(found) == set(expected)
    # equal vectors tie, so for them only the scores are told apart
    assert all(found[q][-1][1] == pytest.approx(rows[-1][1]) for q, rows in expected.items() if 1000 <= q < 2400)
    assert out.select("query_id", "verified").distinct().agg(F.avg("verified")).first()[0] < 2000


def test_projected_neighbours_come_nearest_first():
    v = np.random.default_rng(2).normal(size=(500, 6))
    points = shadows(v, 1.0, 60.0, 4, 5)
    pages = [(6, ids, v[ids].ravel(), points[ids].min(axis=0), points[ids].max(axis=0)) for ids in leaves(points, 20)]
    part = Part((1.0, 60.0, 4, 5), pd.DataFrame(pages, columns=["dim", "ids", "v", "low", "high"]))
    at = shadows(v[:1], 1.0, 0.0, 4, 5)[0]
    rows, far, limits = zip(*part.neighbours(at))
    order, gaps = np.concatenate(rows), np.concatenate(far)
    assert (np.diff(gaps) >= 0).all() and sorted(part.ids[order]) == list(range(500))
    assert all((f <= limit).all() for f, limit in zip(far, limits)) and limits[-1] == np.inf
    # everything found where nothing may be left out
    scores, ids, verified = part.search(v[0], at, 0, 5, -np.inf, quantile(1, 4))
    exact = sorted(((-float((v[0] * x).sum()), i) for i, x in enumerate(v) if i), key=lambda t: t)[:5]
    assert ids.tolist() == [i for _, i in exact] and verified == 500


def test_upper_levels_keep_equal_points_together():
    points = np.repeat(np.random.default_rng(4).normal(size=(50, 4)), 20, axis=0)
    tree = upper_levels(points, 100)
    cells = tree.cells(points)
    assert len(set(cells)) == len(tree.axis) + 1 > 5
    assert all(len(set(cells[i : i + 20])) == 1 for i in range(0, 1000, 20))
    assert upper_levels(np.ones((500, 4)), 100) is None and upper_levels(points, 1000) is None
    assert box_gaps(np.zeros((1, 2)), np.ones((1, 2)), np.array([3.0, 0.5])).tolist() == [4.0]


def test_neighbours_of_vectors_near_the_limits_of_doubles(spark):
    rows = [(i * 20, [10.0 ** (290 + i), 1.0, -(10.0 ** (200 + i))]) for i in range(8)] + [(7, [1e-300, 0.0, 0.0])]
    df = approximate_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert df.where("rank <= 3 AND NOT isnan(score)").count() == 24


def test_no_vectors_give_no_rows(vectors):
    empty = vectors.where("vec_id = -1")
    assert exact_top_k(empty).count() == 0
    assert approximate_neighbours(empty).count() == 0


def test_huge_components_do_not_crash(spark):
    rows = [(i * 50, [1e30 * (i + 1), 1.0]) for i in range(3)]
    df = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert df.where(F.col("score") == 2**63 - 1).count() == 6


def test_chi_square():
    assert chi_square_cdf(np.array([0.0, 2.0, 1e6]), 2) == pytest.approx([0, 1 - np.exp(-1), 1])
    assert quantile(1 - np.exp(-1), 2) == pytest.approx(2) and quantile(1, 8) == np.inf
