"""Running sums and ranks within groups that may hold a large share of all rows.

Other shapes need no helper: group-bys with sum, min, max or count combine on the map side, and a join of many rows
with the one row of their group is left to Spark, which broadcasts the small side by its size or splits skewed
partitions as it runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = 65_536


def piece_of(number: Column | str) -> Column:
    """A piece column for rows ordered by a whole number that few rows share."""
    return F.floor((F.col(number) if isinstance(number, str) else number) / PIECE)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    pieces: Sequence[Column] = (),
    before: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``values`` within ``keys`` by ``order`` (a total order), null keys being one group.

    ``totals`` maps a value name to a column for the group's whole sum, ``before`` to one for the sum without the row
    itself, which is the very number of the row before. ``pieces`` cut groups that may be large:
    columns made of the rows' own values, such that sorting by ``order`` also sorts by them. A task then takes one
    piece, and each adds the sums of the pieces before it; what is one row a piece is numbered in one task. The plan
    is the same at any size, sums are added in a fixed order, and no job runs before the action.
    """
    totals, before = totals or {}, before or {}
    if not keys and not pieces:
        raise ValueError("without keys the rows are one group; say how to cut it")
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    to_here, to_last = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    short = lambda o, w: F.coalesce(F.sum(values[o]).over(w.rowsBetween(*to_last)), F.lit(0))
    if not pieces:
        by = Window.partitionBy(*keys).orderBy(*order)
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select(
            "*", *[F.sum(v).over(by.rowsBetween(*to_here)).alias(o) for o, v in values.items()],
            *[F.sum(values[o]).over(whole).alias(name) for o, name in totals.items()], *[short(o, by).alias(name) for o, name in before.items()])
    cols, marks = df.columns, [f"_p{k}" for k in range(len(pieces))]
    marked = df.withColumns(dict(zip(marks, pieces, strict=True)))
    local = Window.partitionBy(*keys, *marks).orderBy(*order)
    rows = marked.select("*", F.row_number().over(local).alias("_k"), *[
        F.sum(v).over(local.rowsBetween(*to_here)).alias(f"_r_{o}") for o, v in values.items()], *[short(o, local).alias(f"_b_{o}") for o in before])
    sums = rows.groupBy(*keys, *marks).agg(*[F.max_by(f"_r_{o}", "_k").alias(f"_s_{o}") for o in values])
    by = Window.partitionBy(*keys).orderBy(*marks)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group = [*keys, *marks]
    offsets = sums.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], *[F.coalesce(F.sum(f"_s_{o}").over(by.rowsBetween(*to_last)), F.lit(0)).alias(f"_o_{o}") for o in values],
        *[F.sum(f"_s_{o}").over(whole).alias(name) for o, name in totals.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    return rows.join(offsets, same).select(*cols, *[(F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in values], *totals.values(),
                                          *[(F.col(f"_b_{o}") + F.col(f"_o_{o}")).alias(name) for o, name in before.items()])


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn", size: str | None = None, pieces: Sequence[Column] = (),
) -> DataFrame:
    """1-based row number within ``keys``; ``size`` also adds the group's row count."""
    return running(df, keys, order, {out: F.lit(1).cast("long")}, {out: size} if size else None, pieces)
