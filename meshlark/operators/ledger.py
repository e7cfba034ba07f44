"""Work items and run-ledger tables: fan-out and fan-in, skip, retry, contracts, roll-ups.

Every "state of a run" operator is a join or a map-side combined aggregate over
(item, step) keys; none keeps an item's history in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions.skew import piece_of, rank_within

# fixed message texts
MISSING_REQUIREMENTS = "missing requirements: "
INVALID_STATE = "invalid CompletedState"
VALIDATION_FAILED = "validation failed: provides keys {} not all present in context"


# -- fan-out and fan-in -----------------------------------------------------


def with_parent(children: Column, parent_id: Column) -> Column:
    """Set ``parent_id`` on the structs of ``children`` that have none."""
    return F.transform(children, lambda c: c.withField("parent_id", F.coalesce(c["parent_id"], parent_id)))


def fan_out(items: DataFrame, children: Column) -> DataFrame:
    """One row per element of ``children`` (array of item structs); childless items vanish.

    A generator written in Python is a ``@udtf`` called by lateral join; its
    rows go through the same ``coalesce`` of parent ids.
    """
    return items.select(F.inline(with_parent(children, F.col("id"))))


def fan_out_or_keep(items: DataFrame, children: Column) -> DataFrame:
    """As ``fan_out``, but if no item at all has a child, the items stay as they are."""
    some = items.agg(F.coalesce(F.max(F.size(children) > 0), F.lit(False))).scalar()
    kids = with_parent(children, F.col("id"))
    fields = items.select(children.alias("c")).schema["c"].dataType.elementType.names
    return items.withColumn("_some", some).select(F.inline(F.when(F.col("_some"), kids).otherwise(F.array(F.struct(*fields)))))


def fan_in(items: DataFrame, root: str, *aggs: Column) -> DataFrame:
    """One merged row per root; any Spark aggregate (built-in or UDAF) is a collector."""
    return items.groupBy(root).agg(*aggs)


def fan_in_members(items: DataFrame, root: str, order: Sequence[str], member: str, pieces: Sequence[Column] = ()) -> DataFrame:
    """The merged item's ordered list, one row per entry; ``pieces`` cut the lists of roots with very many members."""
    return rank_within(items.select(root, member, *[o for o in order if o != member]), [root], order, "rn", pieces=pieces).select(
        root, (F.col("rn") - 1).alias("ord"), member
    )


def merge_attributes(roots: DataFrame, collected: DataFrame, key: str = "id") -> DataFrame:
    """Collected attributes overwrite the root's; its other keys survive."""
    new = F.coalesce(F.col("_new"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter("attributes", lambda k, _: ~F.map_contains_key(new, k))
    return roots.join(collected.select(key, F.col("attributes").alias("_new")), key, "left").withColumn(
        "attributes", F.map_concat(kept, new)
    ).drop("_new")


# -- latest state and skipping ---------------------------------------------


def ledger_latest(ledger: DataFrame) -> DataFrame:
    """Last write per (item, step): by time, then by sequence."""
    last = F.max(F.struct("ts", "seq", "success", "duration_s"))
    return ledger.groupBy("item_id", "step_key").agg(last.alias("s")).select(
        "item_id", "step_key", "s.seq", "s.success", "s.duration_s", "s.ts"
    )


def _satisfied(ledger: DataFrame) -> DataFrame:
    return ledger_latest(ledger).filter("success").drop("success")


def idempotent_pending(requests: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Requests (item_id, step_key, idempotent) that must run."""
    if force:
        return requests
    repeatable = F.col("idempotent")
    settled = _satisfied(ledger).select("item_id", "step_key", F.lit(True).alias("idempotent"))
    return requests.join(settled, ["item_id", "step_key", "idempotent"], "left_anti").withColumn("idempotent", repeatable)


def idempotent_replayed(requests: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Requests answered by their earlier successful result."""
    if force:
        requests = requests.filter(F.lit(False))
    return requests.filter("idempotent").join(_satisfied(ledger), ["item_id", "step_key"])


def retry_outcome(attempts: DataFrame, k: int) -> DataFrame:
    """First success within the first k attempts of an (item, step), else the last of those attempts."""
    tries = rank_within(attempts.select("item_id", "step_key", "seq", "success"), ["item_id", "step_key"], ["seq"], "attempt")
    won = F.min(F.when(F.col("success"), F.col("attempt")))
    return (
        tries.filter(F.col("attempt") <= k)
        .groupBy("item_id", "step_key")
        .agg(won.alias("_won"), F.max("attempt").alias("_last"))
        .select("item_id", "step_key", F.col("_won").isNotNull().alias("success"), F.coalesce("_won", "_last").alias("attempt"))
    )


# -- contracts --------------------------------------------------------------


def quoted_list(keys: Column) -> Column:
    """['a', 'b'] as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(keys, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))


def step_table(steps: Mapping[str, Sequence[str]]) -> Column:
    """A fixed list of steps and the keys each one names, as an array of (step, keys) to explode."""
    keys = lambda ks: F.array(*[F.lit(k) for k in ks]).cast("array<string>")
    return F.array(*[F.struct(F.lit(s).alias("step"), keys(ks).alias("keys")) for s, ks in steps.items()])


def requirements_check(items: DataFrame, steps: Mapping[str, Sequence[str]], message: Column | None = None) -> DataFrame:
    """One row per (item, step): whether the item's keys cover the step's, and the failure text."""
    missing = F.array_except("s.keys", F.map_keys("attributes"))
    ok = F.size(missing) == 0
    return items.select("id", "attributes", F.explode(step_table(steps)).alias("s")).select(
        "id", "s.step", ok.alias("success"),
        F.when(~ok, F.concat(F.lit(MISSING_REQUIREMENTS), quoted_list(missing))).alias("message"),
    )


def readiness_report(items: DataFrame, steps: Mapping[str, Sequence[str]]) -> DataFrame:
    """READY or BLOCKED against each item's current keys; nothing runs."""
    missing = F.array_except("s.keys", F.map_keys("attributes"))
    status = F.when(F.size(missing) == 0, "READY").otherwise(
        F.concat(F.lit("BLOCKED (missing: "), quoted_list(missing), F.lit(")"))
    )
    return items.select("id", "attributes", F.explode(step_table(steps)).alias("s")).select("id", "s.step", status.alias("status"))


def provides_validation(results: DataFrame, provides: Column, after: Column) -> DataFrame:
    """A success whose promised keys are absent becomes a failure; a present key may hold null."""
    broken = F.col("success") & (F.size(F.array_except(provides, F.map_keys(after))) > 0)
    before, behind = VALIDATION_FAILED.split("{}")
    text = F.concat(F.lit(before), quoted_list(provides), F.lit(behind))
    return results.withColumn("message", F.when(broken, text).otherwise(F.col("message"))).withColumn(
        "success", F.col("success") & ~broken
    )


def external_inputs(steps: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(chain, key, role): outputs are all writes, inputs all reads nothing in the chain writes.

    ``declared`` (chain, key) replaces the inferred inputs of the chains it names.
    """
    writes = steps.select("chain", F.explode("writes").alias("key")).distinct()
    reads = steps.select("chain", F.explode("reads").alias("key")).distinct()
    inputs = reads.join(writes, ["chain", "key"], "left_anti")
    if declared is not None:
        inputs = inputs.join(declared.select("chain").distinct(), "chain", "left_anti").unionByName(declared.select("chain", "key"))
    return inputs.withColumn("role", F.lit("input")).unionByName(writes.withColumn("role", F.lit("output")))


def write_conflicts(steps: DataFrame) -> DataFrame:
    """Keys written by two different steps of one parallel group."""
    return (
        steps.filter("parallel")
        .select("grp", "step", F.explode("writes").alias("key"))
        .groupBy("grp", "key")
        .agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))
        .filter("first_step <> last_step")
    )


# -- outcomes ---------------------------------------------------------------


def exit_code(success: Column, message: Column, error_type: Column) -> Column:
    """0 ok, 1 missing requirement, 2 exception, 3 invalid return, 4 failed; the order of tests matters."""
    text = F.coalesce(message, F.lit(""))
    return (
        F.when(success, 0)
        .when(F.contains(text, F.lit(MISSING_REQUIREMENTS.rstrip(": "))), 1)
        .when(F.coalesce(error_type, F.lit("")) != "", 2)
        .when(F.contains(text, F.lit(INVALID_STATE)), 3)
        .otherwise(4)
    )


def _stops() -> Column:
    return ~F.col("success") & ~F.col("continue_on_error")


def first_failure_cut(runs: DataFrame) -> DataFrame:
    """Steps that ran: all up to and including a run's first failure that does not carry on."""
    cuts = runs.groupBy("run_id").agg(F.min(F.when(_stops(), F.col("idx"))).alias("_cut"))
    kept = runs.join(cuts, ["run_id"])
    return kept.filter(F.col("_cut").isNull() | (F.col("idx") <= F.col("_cut"))).drop("_cut")


def fail_fast_batch(runs: DataFrame) -> DataFrame:
    """As ``first_failure_cut`` over the whole batch in step-major order (idx, run_id)."""
    at = F.struct("idx", "run_id")
    first = runs.filter(_stops()).agg(F.min(at)).scalar()
    return runs.withColumn("_cut", first).filter(F.col("_cut").isNull() | (at <= F.col("_cut"))).drop("_cut")


def run_rollup(runs: DataFrame) -> DataFrame:
    """Per run and, with run_id null, for the batch: steps run, time, success, failed step.

    The batch row is folded from the per-run rows, so the steps are read once.
    """
    failed_at = F.min(F.when(_stops(), F.struct("idx", "step_key")))
    per_run = (
        runs.groupBy("run_id")
        .agg(F.count("*").alias("steps_run"), F.sum("duration_s").alias("duration_s"), failed_at.alias("f"))
        .select("run_id", "steps_run", "duration_s", F.col("f").isNull().alias("success"), F.col("f.step_key").alias("failed_step"))
    )
    return per_run.rollup("run_id").agg(
        F.sum("steps_run").alias("steps_run"),
        F.sum("duration_s").alias("duration_s"),
        F.every("success").alias("success"),
        F.when(F.grouping("run_id") == 0, F.max("failed_step")).alias("failed_step"),
    )


def group_failures(runs: DataFrame, honour_continue: bool = False) -> DataFrame:
    """Outcome of a parallel group: all members run, any failure fails it.

    ``continue_on_error`` is ignored unless asked for. The failing members
    themselves are the rows of ``group_failure_details``.
    """
    failed = _stops() if honour_continue else ~F.col("success")
    return runs.groupBy("run_id").agg(
        (F.count_if(failed) == 0).alias("success"),
        F.count_if(failed).alias("n_failed"),
        F.count("*").alias("n_members"),
    ).withColumn("message", F.when(~F.col("success"), "parallel step(s) failed"))


def group_failure_details(runs: DataFrame) -> DataFrame:
    """One {step, error} row per failing member."""
    return runs.filter(~F.col("success")).select("run_id", "idx", "step_key", "message", "error_type")


def step_labels(runs: DataFrame, width: int = 3) -> DataFrame:
    """NNN_name with one running index over the batch, step-major."""
    numbered = rank_within(runs.select("run_id", "idx", "step_key"), [], ["idx", "run_id"], "rn", pieces=[F.col("idx"), piece_of("run_id")])
    return numbered.select(
        "run_id", "idx", F.concat(F.format_string(f"%0{width}d", F.col("rn")), F.lit("_"), F.col("step_key")).alias("label")
    )


# -- ids, signatures, serial form -------------------------------------------


def item_id(key: Column, prefix: str = "") -> Column:
    """Short 8-hex id with an optional prefix; the same key gives the same id, so a retried task does too."""
    digest = F.substring(F.md5(key.cast("string").cast("binary")), 1, 8)
    return F.concat(F.lit(f"{prefix}_"), digest) if prefix else digest


def short_signature(columns: Sequence[str]) -> Column:
    """First 12 hex digits of the SHA-1 of the row as JSON with sorted keys."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(columns))).cast("binary")), 1, 12)


def duplicate_reports(reports: DataFrame, item: str, columns: Sequence[str]) -> DataFrame:
    """Items whose reports are equal, by signature: how many and the smallest item."""
    return (
        reports.select(item, short_signature(columns).alias("signature"))
        .groupBy("signature")
        .agg(F.count("*").alias("n_items"), F.min(item).alias("first_item"))
        .filter("n_items > 1")
    )


def not_serialisable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not JSON."""
    return rows.filter(F.col(column).isNull() | F.try_parse_json(F.col(column)).isNull())


ITEM_SCHEMA = (
    "id string, attributes map<string,string>, input_files array<string>, "
    "output_files array<string>, parent_id string, meta map<string,string>"
)


def item_to_json(items: DataFrame) -> DataFrame:
    fields = [f.split()[0] for f in ITEM_SCHEMA.replace("map<string,string>", "m").split(", ")]
    return items.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def item_from_json(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("json", ITEM_SCHEMA).alias("w")).select("w.*")
