"""Parent-child rows of unknown depth to full hierarchies, as nested sets.

Every pass over the nodes doubles the length of the ancestor pointers, so a forest of depth d takes about log2(d)
passes instead of d. Upward, the passes sum subtree sizes; then siblings get adjacent preorder ranges by prefix sums of
their sizes; downward, the passes add up the ranges of the ancestors. In the resulting numbering a node's descendants
are exactly the nodes of its root whose ``lft`` lies above its own and not above its ``rgt``: ``descendants`` unrolls
these ranges and ``paths`` turns them round into the ancestors of each node, in both cases at the cost of what comes
out. Nodes whose pointer never runs out are on a cycle or below one: they stay unprocessed and are named instead. Nodes
whose pointer has run out are set aside in each pass, so nothing is shuffled by a pointer that is NULL.

Defined cases: a row whose child is NULL is no relation; a NULL parent makes the child a root; repeated rows count
once; a child with several parents keeps the least, and ``other_parents`` names the links that are left over; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.shared import Rounds

SIBLING_SLICES = 256
RANGE_PIECE = 100_000  # places of a range that are unrolled at a time


def nodes_of(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, parent), one row per node that occurs as child or parent; the parent of a root is NULL."""
    pairs = links.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL")
    both = pairs.select(F.col("c").alias("id"), F.col("p").alias("parent")).unionByName(pairs.where("p IS NOT NULL").select(F.col("p").alias("id"), F.lit(None).cast(pairs.schema["c"].dataType).alias("parent")))
    return both.groupBy("id").agg(F.min("parent").alias("parent"))


def other_parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, parent): the links to further parents, which the tree does not follow."""
    pairs = links.select(F.col(child).alias("id"), F.col(parent).alias("parent")).where("id IS NOT NULL AND parent IS NOT NULL").distinct()
    kept = pairs.groupBy("id").agg(F.min("parent").alias("parent"))
    return pairs.join(kept, ["id", "parent"], "left_anti")


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent, root, depth, size) of the nodes in trees, and (id) of the nodes on or below cycles."""
    rounds = Rounds("climb")
    state = rounds.cut(nodes.select("id", "parent", F.col("parent").alias("up"), F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size")))
    live = state.where("up IS NOT NULL").count()
    while live:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        climbing = state.where("up IS NOT NULL")
        below = climbing.groupBy(F.col("up").alias("id")).agg(F.try_sum("size").alias("_size"))
        moved = climbing.join(above, "up").select("id", "parent", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), "size")
        done = state.where("up IS NULL").select("id", "parent", "up", "root", "depth", "size")
        grown = moved.unionByName(done).join(below, "id", "left")
        state = rounds.cut(grown.select("id", "parent", "up", "root", "depth", F.try_add("size", F.coalesce("_size", F.lit(0))).alias("size")))
        # A node this deep has an ancestor of every smaller depth; so if no pointer ran out, all that are left go round.
        left = state.where("up IS NOT NULL").count()
        if left == live:
            break
        live = left
    return state.where("up IS NULL").drop("up"), state.where("up IS NOT NULL").select("id")


def _sibling_offsets(tree: DataFrame) -> DataFrame:
    """(id, step): the distance from the parent's preorder number to the node's; 0 for roots.

    Prefix sums run within slices of a sibling group and over the slices' totals, so a node with very many children is
    not sorted in one task.
    """
    from pyspark.sql import Window

    kids = tree.where("parent IS NOT NULL").select("id", "parent", "size", F.pmod(F.xxhash64("id"), F.lit(SIBLING_SLICES)).cast("int").alias("slice"))
    totals = kids.groupBy("parent", "slice").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("parent", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("parent", "slice").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = kids.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["parent", "slice"])
    return placed.select("id", (F.lit(1) + F.col("start") + F.col("inner")).alias("step"))


def cycle_ids(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(id) of the nodes on a cycle or below one."""
    return _climb(nodes_of(links, child, parent))[1]


def hierarchy(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, parent, root, depth, lft, rgt, descendants) of all nodes in trees.

    The descendants of a node are the rows of the same root with lft < their lft <= rgt. Nodes on or below cycles are
    left out, see ``cycle_ids``.
    """
    tree, _ = _climb(nodes_of(links, child, parent))
    steps = tree.join(_sibling_offsets(tree), "id", "left")
    rounds = Rounds("descend")
    state = rounds.cut(steps.select("id", "parent", "root", "depth", "size", F.col("parent").alias("up"), F.coalesce("step", F.lit(0)).cast("long").alias("lft")))
    deepest = state.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("lft").alias("_lft"))
        moved = state.where("up IS NOT NULL").join(above, "up").select("id", "parent", "root", "depth", "size", F.col("_up").alias("up"), (F.col("lft") + F.col("_lft")).alias("lft"))
        state = rounds.cut(moved.unionByName(state.where("up IS NULL").select(*moved.columns)))
        reach *= 2
    return state.select("id", "parent", "root", "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("descendants"))


def descendants(tree: DataFrame) -> DataFrame:
    """(id, depth, descendant): every node of ``hierarchy`` with each node in its range.

    A range is unrolled in pieces of RANGE_PIECE places, and each place is one node: an equi-join that makes as many
    rows as there are descendants, no candidate more.
    """
    ranges = tree.where("rgt > lft").select("id", "depth", "root", F.explode(F.sequence(F.col("lft") + 1, "rgt", F.lit(RANGE_PIECE))).alias("_from"), "rgt")
    places = ranges.select("id", "depth", "root", F.explode(F.sequence("_from", F.least(F.col("_from") + (RANGE_PIECE - 1), F.col("rgt")))).alias("lft"))
    return places.join(tree.select("root", "lft", F.col("id").alias("descendant")), ["root", "lft"]).select("id", "depth", "descendant")


def paths(tree: DataFrame) -> DataFrame:
    """(id, path): the ids from the root to each node of ``hierarchy``, by the ranges that the node lies in."""
    above = descendants(tree).select(F.col("descendant").alias("id"), F.struct("depth", F.col("id").alias("of")).alias("a"))
    whole = above.unionByName(tree.select("id", F.struct("depth", F.col("id").alias("of")).alias("a")))
    return whole.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["of"]).alias("path"))
