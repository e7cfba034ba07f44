"""Running sums and ranks: the same rows however groups are cut and however many partitions there are."""

import pytest
from pyspark.sql import functions as F

from meshlark.functions.skew import piece_of, rank_within, running
from meshlark.operators import mesh


def lopsided(spark, n=3000):
    """A third of all rows in group 0, some in a null group, the rest spread."""
    g = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50)
    return spark.range(n).select(g.alias("g"), "id", (F.sqrt("id") / 7).alias("x"))


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def test_ranks_in_pieces(spark):
    df = lopsided(spark)
    want, size = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        size[r["g"]] = size.get(r["g"], 0) + 1
        want[r["id"]] = size[r["g"]]
    for pieces in ([], [F.floor(F.col("id") / 64)], [F.floor(F.col("id") / 640), F.floor(F.col("id") / 64)]):
        got = rank_within(df, ["g"], ["id"], "rn", size="n", pieces=pieces).collect()
        assert {r["id"]: (r["rn"], r["n"]) for r in got} == {i: (k, size[r]) for i, k, r in [(x["id"], want[x["id"]], x["g"]) for x in got]}
        assert len(got) == 3000


def test_doubles_add_in_a_fixed_order(spark, partitions):
    found = []
    for n in (1, 3, 8):
        partitions(n)
        got = running(lopsided(spark).repartition(n + 1), ["g"], ["id"], {"s": F.col("x")}, {"s": "all"}, [F.floor(F.col("id") / 64)]).collect()
        found.append({r["id"]: (r["s"], r["all"]) for r in got})
    assert found[0] == found[1] == found[2] and len(found[0]) == 3000


def test_without_keys(spark):
    got = running(spark.range(100), [], ["id"], {"s": F.col("id")}, pieces=[F.floor(F.col("id") / 9)]).collect()
    assert {r["id"]: r["s"] for r in got} == {i: i * (i + 1) // 2 for i in range(100)}
    with pytest.raises(ValueError):
        running(spark.range(3), [], ["id"], {"s": F.col("id")})


def test_no_job_before_the_action(spark):
    before = jobs(spark)
    rank_within(lopsided(spark), ["g"], ["id"], pieces=[piece_of("id")])
    assert jobs(spark) == before


def test_rings_with_gaps(spark, partitions):
    rows = [(0, 1, 10, 0, 3), (0, 1, 11, 1, 3), (0, 1, 12, 3, 3), (0, 2, 10, 0, 2), (0, 2, 11, 1, 2)]
    for n in (1, 8):
        partitions(n)
        loops = spark.createDataFrame(rows, "obj_id long, face_id long, vert_id long, pos int, n int")
        got = {(r.v_lo, r.v_hi) for r in mesh.face_edges(loops).collect()}
        assert got == {(10, 11), (11, 12), (10, 12)}
