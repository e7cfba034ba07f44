import numpy as np
import pytest
from test_spatial import brute_knn, cloud

from meshlark.operators import near, spatial as S


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def uneven():
    """A dense ball of more points than a tile holds, a thin cloud around it and a few points far off."""
    rng = np.random.default_rng(5)
    return np.vstack([rng.normal(0, 0.01, (1500, 3)), rng.normal(0, 1, (1000, 3)), rng.uniform(-90, 90, (20, 3))])


def test_nearest_breaks_ties_by_place():
    seen = np.array([[1, 0, 0], [0, 0, 0], [-1, 0, 0], [0, 1, 0]], float)
    row, col, d2 = near.nearest(np.zeros((1, 3)), seen, 3)
    assert col.tolist() == [1, 0, 2] and d2.tolist() == [0, 1, 1] and row.tolist() == [0, 0, 0]


def test_knn_over_several_levels_moves_no_pairs(spark):
    xyz = uneven()
    before = set(shuffled(spark))
    got = {(r["pt_id"], r["rank"]): r["nb_id"] for r in S.knn(cloud(spark, xyz), 8).collect()}
    moved = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert got == brute_knn(xyz, 8)
    assert moved < 2500 * len(xyz)


@pytest.mark.parametrize("around", [1, 1 << 20])
def test_tiles_beside_many_points_are_asked_about_elsewhere(spark, around, monkeypatch):
    monkeypatch.setattr(S, "AROUND", around)
    monkeypatch.setattr(S, "TILE_POINTS", 32)
    monkeypatch.setattr(S, "FEW", 8)
    xyz = np.random.default_rng(2).normal(0, 1, (300, 3))
    got = {(r["pt_id"], r["rank"]): r["nb_id"] for r in S.knn(cloud(spark, xyz), 4).collect()}
    assert got == brute_knn(xyz, 4)


def test_relax_keeps_points_without_a_place(spark):
    points = cloud(spark, [[0, 0, 0], [1, 0, 0], [float("nan"), 0, 0]])
    got = {r["pt_id"]: (r["x"], r["y"]) for r in S.lloyd_relax(points, 1).collect()}
    assert got[0] == (0.3, 0.0) and got[1][0] == pytest.approx(0.7) and np.isnan(got[2][0])


def relaxed(xyz, k, damping=0.3):
    near = brute_knn(xyz, k)
    out = []
    for i, p in enumerate(xyz):
        total, others = np.zeros(3), [near[i, r + 1] for r in range(k) if (i, r + 1) in near]
        for j in others:
            total = total + xyz[j]
        out.append(p + (total / len(others) - p) * damping)
    return np.array(out)


def test_boxes_give_the_nearest_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(9)
    xyz = np.vstack([uneven()[:900], np.repeat(rng.normal(0, 1, (3, 3)), 30, 0), np.indices((5, 5, 5)).reshape(3, -1).T])
    asked = np.sort(rng.choice(len(xyz), 700, replace=False))
    want = near.nearest(xyz[asked], xyz, 9)
    for together, pairs in ((64, 1 << 10), (3, 1), (1, 1 << 18)):
        monkeypatch.setattr(near, "TOGETHER", together)
        monkeypatch.setattr(near, "PAIRS", pairs)
        assert all((a == b).all() for a, b in zip(near.nearest_in_boxes(xyz[asked], xyz, 9), want))


@pytest.mark.parametrize("around", [1, 1 << 20])
def test_relaxing_writes_no_lists_and_leaves_one_table(spark, around, monkeypatch):
    """Copies too few for a tile, points that tiles do not prove, and crowded tiles move as in plain Python; only the last round is left."""
    import os

    monkeypatch.setattr(S, "TILE_POINTS", 40)
    monkeypatch.setattr(S, "AROUND", around)
    xyz = np.vstack([uneven()[1300:1700], uneven()[-20:], np.repeat([[0.4, 0.5, 0.5]], 12, 0)])
    folder, cuts, kept = spark.conf.get("spark.checkpoint.dir"), [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, label: cuts.append((df.columns, label)) or kept(df, label))
    before = set(os.listdir(folder))
    got = {r["pt_id"]: (r["x"], r["y"], r["z"]) for r in S.lloyd_relax(cloud(spark, xyz), 2, 8).collect()}
    assert [got[i] for i in range(len(xyz))] == list(map(tuple, relaxed(relaxed(xyz, 8), 8).tolist()))
    assert len(set(os.listdir(folder)) - before) == 1
    assert around == 1 or not any("near" in c for c, _ in cuts[: [l for _, l in cuts].index("knn") + 1])


def test_relaxing_many_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_POINTS", 16)
    xyz = np.vstack([np.repeat([[1.0, 1.0, 1.0]], 40, 0), np.random.default_rng(3).uniform(0, 3, (60, 3))])
    got = {r["pt_id"]: (r["x"], r["y"], r["z"]) for r in S.lloyd_relax(cloud(spark, xyz), 1, 8).collect()}
    assert [got[i] for i in range(len(xyz))] == list(map(tuple, relaxed(xyz, 8).tolist()))
