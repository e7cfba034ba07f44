"""Even steps along curves, and that a curve's points are not moved for them."""

import numpy as np
import pytest

from meshlark.operators import trajectory as T


def control(spark, n=5, paths=3):
    rng = np.random.default_rng(5)
    rows = [(p, i, *map(float, rng.uniform(-1, 1, 3))) for p in range(paths) for i in range(n)]
    rows += [(90, i, 1.0, 2.0, 3.0) for i in range(3)] + [(91, 0, 0.0, 0.0, 0.0)]  # without length; of one point
    return spark.createDataFrame(rows, "path_id long, idx int, x double, y double, z double")


def frames(df):
    return {(r["path_id"], r["frame"]): (r["x"], r["y"], r["z"]) for r in df.collect()}


@pytest.mark.parametrize("resolution, count", [(64, 150), (7, 40), (200, 1)])
def test_curve_and_control_points_give_the_same_frames(spark, resolution, count):
    points = control(spark)
    curve = T.bezier_path(points, resolution)
    whole, direct = frames(T.follow_path(curve, count)), frames(T.follow_bezier(points, resolution, count))
    assert set(whole) == set(direct) == {(p, f + 1) for p in (0, 1, 2, 90) for f in range(count)}
    assert all(np.allclose(whole[k], direct[k], atol=1e-9) for k in whole)
    at = {}
    for r in curve.orderBy("path_id", "k").collect():
        at.setdefault(r["path_id"], []).append((r["x"], r["y"], r["z"]))
    for p in (0, 1, 2):
        xyz = np.array(at[p])
        along = np.concatenate([[0], np.cumsum(np.sqrt((np.diff(xyz, axis=0) ** 2).sum(1)))])
        asked = np.linspace(0, along[-1], count) if count > 1 else [0.0]
        want = np.stack([np.interp(asked, along, xyz[:, c]) for c in range(3)], 1)
        assert np.allclose([direct[p, f + 1] for f in range(count)], want, atol=1e-9)
    assert np.allclose([direct[90, f + 1] for f in range(count)], (1.0, 2.0, 3.0))


def test_last_frame_is_there_when_the_last_point_stands_alone(spark):
    curve = spark.createDataFrame([(0, k, float(k), 0.0, 0.0) for k in (*range(130), 140)], "path_id long, k int, x double, y double, z double")
    got = frames(T.follow_path(curve, 5))
    assert {k: v[0] for k, v in got.items()} == {(0, f + 1): 129 * f / 4 for f in range(5)}


def test_only_control_points_meet_in_joins(spark):
    plan = T.follow_bezier(control(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
