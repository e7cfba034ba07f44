from meshlark.operators import trajectory as T
from meshlark.plans import registry


def test_orbit_jobs_share_one_orbit(spark):
    static = spark.createDataFrame([(i, f"f{i}", 0.1234567, 0.0, 1.0) for i in range(3)], "obj_id int, filename string, start_x double, start_y double, start_z double")
    jobs = T.static_orbit_jobs(static, places=6, radius=3.0, height=1.5, frame_count=4)
    got = sorted((r.obj_id, r.modality, r.frame, r.x, r.y, r.z, r.shift_x) for r in jobs.collect())
    turn = [(1, 3.0, 0.0), (2, 0.0, 3.0), (3, -3.0, 0.0), (4, 0.0, -3.0)]
    assert got == [(i, m, f, x, y, 1.5, -0.123457) for i in range(3) for m in ("depth", "rgb") for f, x, y in turn]


def test_orbit_dataset_numbers_no_events(spark):
    jobs = registry.queries()["static_orbit_dataset"](spark, "/root/testdata/sf0.001")
    assert "Window" not in jobs._jdf.queryExecution().optimizedPlan().toString()
