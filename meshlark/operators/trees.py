"""Parent/child and dependency tables: root paths, lineage, world transforms, levels."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


from meshlark.session import cut


def climb(
    nodes: DataFrame,
    node: str,
    parent: str,
    carry: Mapping[str, Callable[[Column, Column], Column]],
) -> DataFrame:
    """Fold the ``carry`` columns along every node's ancestor chain, ancestors first.

    ``carry[c](above, own)`` must be associative. Each round doubles the stretch
    a row has folded, so chains of depth d take log2(d) joins; a recursive query
    would take d rounds and stop at its row limit. Adds ``root`` and ``depth``
    (0 at a root). A parent that is not in the table makes its child a root.
    Rows on or below a cycle are there with a null root, depth and carry.
    """
    up = F.col("_up")
    state = cut(
        nodes.select(
            node, F.col(parent).alias("_up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"),
            F.col(node).alias("root"), *carry,
        ),
        "climb",
    )
    rounds = state.count().bit_length() + 1  # a chain is no longer than the table
    done, open_ = state.filter(up.isNull()), state.filter(up.isNotNull())
    for _ in range(rounds):
        if open_.isEmpty():
            break
        above = done.unionByName(open_).select(
            F.col(node).alias("_up"), up.alias("_next"), F.col("depth").alias("_depth"),
            F.col("root").alias("_root"), *[F.col(c).alias(f"_a_{c}") for c in carry],
        )
        found = F.col("_root").isNotNull()
        state = cut(
            open_.join(above, ["_up"], "left").select(
                node,
                F.col("_next").alias("_up"),
                F.when(found, F.col("depth") + F.col("_depth")).otherwise(F.col("depth") - 1).alias("depth"),
                F.coalesce("_root", "root").alias("root"),
                *[F.when(found, fold(F.col(f"_a_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c, fold in carry.items()],
            ),
            "climb",
        )
        done, open_ = done.unionByName(state.filter(up.isNull())), state.filter(up.isNotNull())
    none = lambda c: F.lit(None).cast(done.schema[c].dataType).alias(c)
    circular = open_.select(node, none("depth"), none("root"), *[none(c) for c in carry])
    return done.drop("_up").unionByName(circular)


def root_path(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", name: str = "name", sep: str = ".") -> DataFrame:
    """Dotted path of names from the root down to each node."""
    return climb(nodes, node, parent, {name: lambda above, own: F.concat(above, F.lit(sep), own)}).withColumnRenamed(name, "path")


def lineage(items: DataFrame, item: str, parent: str) -> DataFrame:
    """Root, distance and chain (root first, ids joined by '>') of every item."""
    chained = items.select(item, parent, F.col(item).cast("string").alias("chain"))
    return climb(chained, item, parent, {"chain": lambda above, own: F.concat(above, F.lit(">"), own)})


def world_offset(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", axes: tuple[str, ...] = ("tx",)) -> DataFrame:
    """World translation: the sum of the local ones along the chain."""
    return climb(nodes, node, parent, {a: lambda above, own: above + own for a in axes})


def matmul4(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 matrices held as array<double>(16)."""
    cell = lambda i, j: sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j])
    return F.array(*[cell(i, j) for i in range(4) for j in range(4)])


def world_matrix(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", matrix: str = "matrix") -> DataFrame:
    """World matrix: the product of the local ones along the chain."""
    return climb(nodes, node, parent, {matrix: matmul4})


def dependency_levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Longest-path depth of every node; null for nodes on or behind a cycle.

    Peels one level per round: nodes whose predecessors are all placed. A round
    reads all edges and rewrites the waiting nodes; counts are combined before
    they are shuffled, so a node with very many edges is no bottleneck.
    """
    edges = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    waiting = cut(
        nodes.join(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")), "node", "left").select(
            "node", F.coalesce("need", F.lit(0)).alias("need")
        ),
        "levels",
    )
    placed, level = None, 0
    while True:
        ready = waiting.filter("need = 0").select("node", F.lit(level).alias("level"))
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        freed = (
            edges.withColumnRenamed("src", "node").join(ready.select("node"), ["node"])
            .groupBy(F.col("dst").alias("node"))
            .agg(F.count("*").alias("got"))
        )
        waiting = cut(
            waiting.filter("need > 0").join(freed, "node", "left").select(
                "node", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")
            ),
            "levels",
        )
        level += 1
    stuck = waiting.select("node", F.lit(None).cast("int").alias("level"))
    return stuck if placed is None else placed.unionByName(stuck)
