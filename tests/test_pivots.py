"""Search by blocks around centres equals brute force, and skips what the triangle inequality rules out."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import pivots, search

ROWS = "seq long, embedding array<float>, other string"


def brute(rows, asked, k):
    out = set()
    for q, v in asked:
        found = [(float(((np.array(x, np.float32).astype(float) - np.array(v, np.float32)) ** 2).sum()), s) for s, x in rows if s is not None and x and len(x) == len(v) and None not in x and np.isfinite(x).all()]
        out |= {(q, s, r + 1) for r, (_, s) in enumerate(sorted(found)[:k])}
    return out


def got(df):
    return {(r.query_id, r.seq, r.rank) for r in df.collect()}


def clusters(n, d, parts, seed=3):
    """Vectors in clusters, a third of them in one, and some repeated."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(parts, d)) * 20
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, parts, n))
    x = (centre[of] + rng.normal(size=(n, d))).astype(np.float32)
    x[::17] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, size, k", [(1500, 32, 7), (1500, 4096, 50), (40, 8, 100)])
def test_equals_brute_force(spark, tmp_path, n, size, k):
    rows = clusters(n, 12, 9)
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(3)
    index = pivots.PivotIndex.build(df, str(tmp_path / "i"), n=16, size=size)
    asked = [(100 + i, rows[i][1]) for i in (0, 1, 5, 17, 30)] + [(7, [0.0] * 12), (8, [1e4] * 12)]
    assert got(index.nearest(asked, k)) == brute(rows, asked, k)
    assert got(index.nearest(asked, k, refine=True)) == brute(rows, asked, k)
    again = pivots.PivotIndex.open(spark, str(tmp_path / "i"))
    assert got(again.nearest(asked[:1], k)) == brute(rows, asked[:1], k)
    assert got(search.nearest_held(search.packed(df, "seq", size), asked, k)) == brute(rows, asked, k)


def test_far_blocks_are_skipped_unread(spark, tmp_path):
    rows = clusters(3000, 12, 20)
    index = pivots.PivotIndex.build(spark.createDataFrame([(*r, None) for r in rows], ROWS), str(tmp_path / "i"), n=32, size=32)
    asked = [(1, rows[1][1]), (2, rows[5][1])]
    share = {r.query_id: r.met / r.blocks for r in index.share(asked, 5).collect()}
    assert max(share.values()) < 0.5
    qk, q = search.given(asked[:1])
    refined = {r.query_id: r.met / r.blocks for r in index.share(asked, 5, refine=True).collect()}
    assert all(refined[i] <= share[i] for i in share)
    opened = index._open(q, index._limits(qk, q, 5, False))
    assert opened.count() < 0.5 * index.blocks.count()
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(far" in plan


def test_uneven_rows(spark, tmp_path):
    """Other dimensions, nulls and vectors that are not finite; huge values; no rows at all."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [inf, 0.0]), (5, None), (6, []), (7, [2.0, 0.0]), (None, [0.0, 0.0]), (8, [3e38, -3e38]), (9, [1.0, 0.0]), (10, [None, 1.0])]
    index = pivots.PivotIndex.build(spark.createDataFrame([(*r, "y") for r in rows], ROWS), str(tmp_path / "i"), n=3, size=2)
    for asked in ([(1, [0.0, 0.0]), (2, [3e38, -3e38])], [(1, [0.0, 0.0, 0.0])], [(1, [0.0] * 5)]):
        for k in (1, 2, 20):
            assert got(index.nearest(asked, k)) == got(index.nearest(asked, k, refine=True)) == brute(rows, asked, k)
    empty = pivots.PivotIndex.build(spark.createDataFrame([], ROWS), str(tmp_path / "e"))
    assert empty.nearest([(1, [0.0, 1.0])], 3).count() == 0 and empty.share([(1, [0.0, 1.0])], 3).count() == 0
    for wrong in ([], [(1, [0.0]), (2, [0.0, 1.0])], [(1, [nan])], [(1, [])]):
        with pytest.raises(ValueError):
            index.nearest(wrong, 3)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.floats(-1e6, 1e6), st.integers(0, 2**31))
def test_bounds_hold(d, shift, seed):
    """Bounds enclose the distances however much the subtraction of large squares cancels."""
    rng = np.random.default_rng(seed)
    x = (shift + rng.normal(size=(5, d)) * 10.0 ** rng.integers(-6, 3)).astype(np.float32)
    centres = x[:3].astype(float) + rng.normal(size=(3, d)) * 1e-9
    low, high = pivots.distances(x, centres)
    exact = np.sqrt(((x[:, None].astype(np.longdouble) - centres[None]) ** 2).sum(2))
    assert (low <= exact).all() and (exact <= high).all()
