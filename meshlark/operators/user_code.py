"""Fan-out and fan-in by code of the user's own, run by Arrow batches where Spark puts the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from meshlark.functions.worker import ship
from meshlark.session import spread

WORTH = 8  # rows of a root in a batch that are worth combining before they are sent


def fan_out_user(items: DataFrame, generate: Callable[..., Iterable[tuple]], schema: str, *inputs: str) -> DataFrame:
    """The rows (``schema``, in its order) that ``generate(*inputs)`` yields for each item, by a lateral join.

    ``parent_id`` is the item's ``id`` where the generator gave none or has no such column. Items without children
    vanish, repeated items have their children each, null inputs are passed on as None, and columns of ``items``
    that clash with names of ``schema`` do no harm. An error in the generator fails the task.
    """
    class Children:
        def eval(self, *values):
            yield from generate(*values)

    call = F.udtf(Children, returnType=schema, useArrow=True)
    asked = items.select(F.col("id").alias("_item"), *(F.col(c).alias(f"_input{k}") for k, c in enumerate(inputs)))
    made = asked.lateralJoin(call(*(F.col(f"_input{k}").outer() for k in range(len(inputs)))))
    names = [c for c in made.columns[len(asked.columns):] if c != "parent_id"]
    parent = F.coalesce("parent_id", "_item") if "parent_id" in made.columns else F.col("_item")
    return made.select(*names, parent.alias("parent_id"))


def _by_root(table: pa.Table, root: str) -> Iterator[pa.Table]:
    """The rows of each root of a table, nulls together."""
    codes = table.column(root).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    table, codes = table.take(pa.array(order)), codes[order]
    ends = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
    for start, end in zip([0, *ends], ends):
        yield table.slice(start, end - start)


def fan_in_user(items: DataFrame, root: str, combine: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What ``combine`` makes of the rows of each ``root``, in the schema of ``items``.

    ``combine`` gets a table of one root and gives back one of the same schema, as a rule of one row; it must not
    matter in which order and in how many helpings the rows come (make the columns it starts from by ``select``
    before, the final ones by ``select`` after). It runs first on each Arrow batch where the rows lie, for roots that are
    often in it, so a root with a third of all rows sends a row a batch over the network, then on what came together,
    sorted by root and batch by batch: no table of all of a root's rows is ever made, and roots of few rows share batches. Rows of null ``root`` are one group; no rows give none.
    """
    schema: StructType = items.schema

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [combine(part).cast(batch.schema) if part.num_rows >= WORTH else part for part in _by_root(pa.Table.from_batches([batch]), root)]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None  # the last root met, of which more may follow
        for batch in batches:
            done = []
            for part in _by_root(pa.Table.from_batches([batch]), root):
                this = part.column(root)[0].as_py()
                if held is not None and not (this == of or (this != this and of != of)):
                    done.append(held)
                    held = None
                held, of = combine(part if held is None else pa.concat_tables([held, part])).cast(part.schema), this
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    met = spread(items.mapInArrow(partial, schema), root).sortWithinPartitions(root)
    return met.mapInArrow(merge, schema)


ship(__name__)
