import pytest
from pyspark.sql import functions as F

from meshlark.operators import ledger as L, trees, user_code


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("success,message,kind,code", [
    (True, None, None, 0), (False, "missing requirements: ['a']", "KeyError", 1), (False, "boom", "ValueError", 2),
    (False, "invalid CompletedState returned", None, 3), (False, "other", None, 4), (False, "invalid CompletedState", "TypeError", 2),
])
def test_exit_code(spark, success, message, kind, code):
    df = spark.createDataFrame([(success, message, kind)], "s boolean, m string, t string")
    assert df.select(L.exit_code(F.col("s"), F.col("m"), F.col("t"))).first()[0] == code


ITEM = "id string, parent_id string, val bigint"


def kids(spark, counts):
    items = spark.createDataFrame([(i, None, 0, n) for i, n in counts], ITEM + ", n int")
    child = lambda j: F.struct(F.concat("id", F.lit("-"), j.cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), (j * 10).cast("bigint").alias("val"))
    some = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), child)).otherwise(F.array().cast(f"array<struct<id:string,parent_id:string,val:bigint>>"))
    return items, some


def test_fan_out_sets_parent_and_sums(spark):
    items, some = kids(spark, [("root", 3)])
    out = L.fan_out(items, some)
    assert rows(out) == [("root-1", "root", 10), ("root-2", "root", 20), ("root-3", "root", 30)]
    assert rows(L.fan_in(out, "parent_id", F.sum("val"))) == [("root", 60)]


def test_empty_fan_out_keeps_items(spark):
    items, some = kids(spark, [("a", 0), ("b", 0)])
    assert rows(L.fan_out_or_keep(items, some).select("id")) == [("a",), ("b",)]
    items, some = kids(spark, [("a", 0), ("b", 1)])
    assert rows(L.fan_out_or_keep(items, some).select("id")) == [("b-1",)]


def test_user_generator_as_udtf(spark):
    from pyspark.sql.functions import udtf

    @udtf(returnType="child string, val int")
    class Halves:
        def eval(self, item: str):
            for i in range(2):
                yield f"{item}{i}", i

    spark.udtf.register("halves", Halves)
    spark.createDataFrame([("a",), ("b",)], "id string").createOrReplaceTempView("gen_items")
    got = spark.sql("SELECT child, id FROM gen_items, LATERAL halves(id)")
    assert rows(got) == [("a0", "a"), ("a1", "a"), ("b0", "b"), ("b1", "b")]


def test_fan_out_by_a_generator(spark):
    items = spark.createDataFrame([("a", 2, "x"), ("b", 0, "x"), ("c", None, "x"), ("a", 2, "x")], "id string, n int, val string")
    steps = lambda item, n: ((f"{item}{k}", "own" if k else None, k) for k in range(n or 0))
    got = user_code.fan_out_user(items, steps, "id string, parent_id string, val int", "id", "n")
    assert got.columns == ["id", "val", "parent_id"]
    assert rows(got) == [("a0", 0, "a"), ("a0", 0, "a"), ("a1", 1, "own"), ("a1", 1, "own")]
    bare = user_code.fan_out_user(items, lambda item, n: [(f"{item}!",)], "child string", "id", "n")
    assert rows(bare) == [("a!", "a"), ("a!", "a"), ("b!", "b"), ("c!", "c")]
    assert user_code.fan_out_user(items.limit(0), steps, "id string, parent_id string, val int", "id", "n").count() == 0


def test_fan_in_by_a_collector(spark):
    """A root with a third of the rows, null roots and values; never more rows at once than a batch and what is held."""
    import pyarrow as pa

    def spans(part):
        assert part.num_rows <= 101
        seen = sorted({v for vs in part.column("seen").to_pylist() for v in vs or []})
        return pa.table({"root": part.column("root").slice(0, 1), "seen": [[seen[0], seen[-1]] if seen else []], "n": [sum(part.column("n").to_pylist())]})

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        base = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("r"), F.col("id") % 50)).alias("root"),
                                        F.when(F.col("id") % 7 > 0, F.array("id")).alias("seen"), F.lit(1).cast("long").alias("n"))
        got = {r.root: (list(r.seen), r.n) for r in user_code.fan_in_user(base, "root", spans).collect()}
        empty = user_code.fan_in_user(base.limit(0), "root", spans).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = {}
    for k in range(6000):
        root = {0: "hot", 1: f"r{k % 50}", 2: None}[k % 3]
        seen, n = want.get(root, ([], 0))
        want[root] = (seen + [k] * (k % 7 > 0), n + 1)
    assert got == {root: ([min(seen), max(seen)], n) for root, (seen, n) in want.items()}
    assert empty == 0


LEDGER = "item_id string, step_key string, seq int, success boolean, duration_s double, ts timestamp"


def test_skip_uses_last_write(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    ledger = spark.createDataFrame(
        [("i", "s", 1, True, 1.0, at(1)), ("i", "s", 2, False, 1.0, at(2)), ("i", "t", 3, True, 1.0, at(3)), ("i", "u", 4, True, 1.0, at(3))], LEDGER)
    requests = spark.createDataFrame([("i", "s", True), ("i", "t", True), ("i", "u", False), ("i", "new", True)], "item_id string, step_key string, idempotent boolean")
    assert {r["step_key"] for r in L.idempotent_pending(requests, ledger).collect()} == {"s", "u", "new"}
    assert {r["step_key"] for r in L.idempotent_replayed(requests, ledger).collect()} == {"t"}
    assert L.idempotent_pending(requests, ledger, force=True).count() == 4
    assert L.idempotent_replayed(requests, ledger, force=True).count() == 0


def test_retry_third_attempt(spark):
    tries = spark.createDataFrame([("i", "s", 1, False), ("i", "s", 2, False), ("i", "s", 3, True)], "item_id string, step_key string, seq int, success boolean")
    assert rows(L.retry_outcome(tries, 3)) == [("i", "s", True, 3)]
    assert rows(L.retry_outcome(tries, 2)) == [("i", "s", False, 2)]


RUNS = "run_id int, idx int, step_key string, success boolean, continue_on_error boolean, duration_s double, message string, error_type string"


def test_cut_and_rollup(spark):
    runs = spark.createDataFrame([
        (1, 1, "a", True, False, 1.0, None, None), (1, 2, "b", False, True, 1.0, "m", None), (1, 3, "c", True, False, 1.0, None, None),
        (2, 1, "a", False, False, 2.0, "m", None), (2, 2, "b", True, False, 2.0, None, None)], RUNS)
    ran = L.first_failure_cut(runs)
    assert rows(ran.select("run_id", "idx")) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    got = {r["run_id"]: (r["steps_run"], r["duration_s"], r["success"], r["failed_step"]) for r in L.run_rollup(ran).collect()}
    assert got == {1: (3, 3.0, True, None), 2: (1, 2.0, False, "a"), None: (4, 5.0, False, None)}
    assert rows(L.fail_fast_batch(runs).select("run_id", "idx")) == [(1, 1), (2, 1)]


def test_contracts(spark):
    steps = spark.createDataFrame([("c", "a", [], ["x"]), ("c", "b", ["x"], ["y"])], "chain string, step string, reads array<string>, writes array<string>")
    assert rows(L.external_inputs(steps)) == [("c", "x", "output"), ("c", "y", "output")]


def test_null_value_counts_as_present(spark):
    df = spark.createDataFrame([(True, None, {"x": None})], "success boolean, message string, attributes map<string,string>")
    assert L.provides_validation(df, F.array(F.lit("x")), F.col("attributes")).first()["success"]
    bad = L.provides_validation(df, F.array(F.lit("y")), F.col("attributes")).first()
    assert not bad["success"] and bad["message"].startswith("validation failed")


def test_climb_handles_orphans_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 99, "o"), (5, 4, "p"), (6, 7, "c"), (7, 6, "d"), (8, 6, "e")], "node_id int, parent_id int, name string")
    got = {r["node_id"]: (r["path"], r["root"], r["depth"]) for r in trees.root_path(nodes).collect()}
    assert got == {1: ("r", 1, 0), 2: ("r.a", 1, 1), 3: ("r.a.b", 1, 2), 4: ("o", 4, 0), 5: ("o.p", 4, 1), **dict.fromkeys((6, 7, 8), (None, None, None))}


def test_world_matrix(spark):
    move = lambda x: [float(v) for v in (1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]
    turn = [float(v) for v in (0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]
    nodes = spark.createDataFrame([(1, None, turn), (2, 1, move(2)), (3, 2, move(1))], "node_id int, parent_id int, matrix array<double>")
    got = {r["node_id"]: r["matrix"] for r in trees.world_matrix(nodes).collect()}
    assert (got[3][3], got[3][7]) == (0.0, 3.0)  # a quarter turn takes x to y


def test_levels_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)], "src int, dst int")
    assert {r["node"]: r["level"] for r in trees.dependency_levels(edges).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}


def test_fan_in_user_combines_rare_roots_once_and_streams_them(spark):
    import pyarrow as pa

    def counted(rows):
        return pa.table({"root": rows.column("root").slice(0, 1), "n": [sum(rows.column("n").to_pylist())], "calls": [1 + sum(rows.column("calls").to_pylist())]})

    base = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.col("id") % 500).when(F.col("id") < 1010, F.lit(None)).otherwise(F.lit(-1)).alias("root"),
        F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("calls"))
    got = {r.root: (r.n, r.calls) for r in user_code.fan_in_user(base, "root", counted).collect()}
    assert len(got) == 502 and got[None][0] == 10 and got[-1][0] == 1990
    assert all(got[k] == (2, 1) for k in range(500))
