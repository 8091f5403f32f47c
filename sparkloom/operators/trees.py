"""Trees as (node, parent, length) and their closures; distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialize


def closure(tree: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, depth, distance): each node (of `nodes`, by default all) with itself and all that is above it.

    Paths double in length each round until none is longer, whatever the depth: log2(depth) rounds,
    each written. The result has a row for each node and level above it; aggregates over a whole
    tree come from :func:`gathered` and :func:`summed_up`, which don't make it.
    """
    jump = _jumps(tree)
    start = tree.select("node") if nodes is None else tree.select("node").join(nodes.select("node").distinct(), "node", "left_semi")
    known = start.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("depth"), F.lit(0.0).alias("distance"))
    while not jump.isEmpty():
        more = known.join(jump.select(F.col("node").alias("ancestor"), "up", "d", "l").hint("merge"), "ancestor")
        known = materialize(known.union(more.select("node", F.col("up").alias("ancestor"), F.col("depth") + F.col("d"), F.col("distance") + F.col("l"))))
        jump = _doubled(jump)
    return known


def _doubled(jump: DataFrame) -> DataFrame:
    """(node, up, d, l): each node with what is twice as far above it."""
    above = jump.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("d").alias("d2"), F.col("l").alias("l2"))
    return materialize(jump.join(above.hint("merge"), "up").select("node", F.col("top").alias("up"), (F.col("d") + F.col("d2")).alias("d"), (F.col("l") + F.col("l2")).alias("l")))


def _jumps(tree: DataFrame) -> DataFrame:
    return materialize(tree.where("parent is not null").select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("d"), F.col("length").alias("l")))


def gathered(tree: DataFrame, own: DataFrame, most: bool = False) -> DataFrame:
    """(node, value): the sum of the own values (node, value) of a node and all below it, or with `most` the largest of value plus distance.

    In round k each node passes what it has gathered to the node 2^k above, so log2(depth) rounds of
    one join and one aggregation each, and never more rows than nodes, of which none goes to the driver (joins by merge, whatever sizes are guessed). Nodes without own value that
    gather nothing have a null.
    """
    value = materialize(tree.select("node").join(own.select("node", "value").hint("merge"), "node", "left"))
    jump = _jumps(tree)
    while not jump.isEmpty():
        sent = value.where("value is not null").join(jump.hint("merge"), "node").select(F.col("up").alias("node"), (F.col("value") + F.col("l") if most else F.col("value")).alias("value"))
        value = materialize(value.union(sent).groupBy("node").agg((F.max if most else F.sum)("value").alias("value")))
        jump = _doubled(jump)
    return value


def summed_up(tree: DataFrame, own: DataFrame) -> DataFrame:
    """(node, value): the sum of the own values (node, value) of a node and all above it, in as many rounds as :func:`gathered`."""
    value = materialize(tree.select("node").join(own.select("node", "value").hint("merge"), "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value")))
    jump = _jumps(tree)
    while not jump.isEmpty():
        above = jump.select("node", "up").join(value.select(F.col("node").alias("up"), F.col("value").alias("more")).hint("merge"), "up").select("node", "more")
        value = materialize(value.join(above.hint("merge"), "node", "left").select("node", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value")))
        jump = _doubled(jump)
    return value


def leaves(tree: DataFrame) -> DataFrame:
    return tree.select("node").join(tree.select(F.col("parent").alias("node")).distinct().hint("merge"), "node", "left_anti")


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(node, n_leaves)."""
    return gathered(tree, leaves(tree).select("node", F.lit(1).cast("bigint").alias("value"))).withColumnRenamed("value", "n_leaves")


def shrubs(tree: DataFrame, most: int) -> DataFrame:
    """Nodes of at most `most` leaves whose parent has more; the root if the whole tree fits."""
    sizes = subtree_sizes(tree)
    up = tree.select("node", "parent").join(sizes, "node").join(sizes.select(F.col("node").alias("parent"), F.col("n_leaves").alias("above")), "parent", "left")
    return up.where((F.col("n_leaves") <= most) & (F.col("parent").isNull() | (F.col("above") > most))).select("node", "n_leaves")


def heights(tree: DataFrame) -> DataFrame:
    """(node, height): the longest way down to a leaf."""
    return gathered(tree, leaves(tree).select("node", F.lit(0.0).alias("value")), most=True).withColumnRenamed("value", "height")


def cut_at_height(tree: DataFrame, height: float) -> DataFrame:
    """Nodes at or below a height whose parent is above it."""
    h = heights(tree)
    up = tree.select("node", "parent").join(h, "node").join(h.select(F.col("node").alias("parent"), F.col("height").alias("above")), "parent", "left")
    return up.where((F.col("height") <= height) & (F.col("parent").isNull() | (F.col("above") > height))).select("node", "height")


def cut_by_count(tree: DataFrame, parts: int) -> DataFrame:
    """(node, height): the nodes that are left when the highest one is split into its children until there are `parts`.

    Splitting goes by falling height (ties by the smaller node), so the nodes split are the first
    inner ones in that order: a prefix closed under parents, found without a loop. `parts` is what
    the driver holds at most.
    """
    h = heights(tree)
    inner = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids")).join(h, "node")
    split, made = [], 1
    for r in inner.orderBy(F.desc("height"), "node").limit(max(0, parts - 1)).collect():
        if made + r["kids"] - 1 > parts:
            break
        split.append(r["node"])
        made += r["kids"] - 1
    inside = F.col("node").isin(split) if split else F.lit(False)
    below = F.col("parent").isin(split) if split else F.col("parent").isNull()
    return tree.where(~inside & below).select("node").join(h, "node")


def edges(tree: DataFrame, least: float | None = None) -> DataFrame:
    """(node, parent, length, below, beyond): each edge with the leaves on either side; lengths have a floor if one is given."""
    sizes = subtree_sizes(tree)
    total = leaves(tree).agg(F.count("*").alias("total"))
    length = F.col("length") if least is None else F.greatest(F.col("length"), F.lit(least))
    return tree.where("parent is not null").join(sizes, "node").join(F.broadcast(total)).select("node", "parent", length.alias("length"), F.col("n_leaves").alias("below"), (F.col("total") - F.col("n_leaves")).alias("beyond"))


def pruned(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """The tree with all that is below the nodes of `tops` gone, so that they are leaves."""
    marked = summed_up(tree, tops.select("node").distinct().select("node", F.lit(1.0).alias("value")))
    outside = marked.join(tops.select("node").distinct().withColumn("top", F.lit(1.0)), "node", "left").where("value - coalesce(top, 0) = 0").select("node")
    return tree.join(outside, "node", "left_semi")


def checked(tree: DataFrame) -> DataFrame:
    """(fault, n): what is wrong with a tree: roots other than one, nodes that repeat, parents that aren't nodes, inner nodes of one child, missing or negative lengths."""
    counts = {
        "roots": tree.where("parent is null").agg((F.count("*") - 1).alias("n")),
        "repeated nodes": tree.groupBy("node").count().where("count > 1").agg(F.count("*").alias("n")),
        "unknown parents": tree.where("parent is not null").join(tree.select(F.col("node").alias("parent")), "parent", "left_anti").agg(F.count("*").alias("n")),
        "single children": tree.where("parent is not null").groupBy("parent").count().where("count = 1").agg(F.count("*").alias("n")),
        "bad lengths": tree.where("parent is not null and (length is null or length < 0)").agg(F.count("*").alias("n")),
    }
    out = None
    for fault, n in counts.items():
        row = n.select(F.lit(fault).alias("fault"), F.col("n").cast("bigint").alias("n"))
        out = row if out is None else out.union(row)
    return out


def sequence_weights(tree: DataFrame) -> DataFrame:
    """(node, weight) of leaves: the sum over the way to the root of edge length (at least 0.05) over leaves below, scaled to one."""
    sizes = subtree_sizes(tree)
    strength = tree.where("parent is not null").join(sizes, "node").select("node", (F.greatest("length", F.lit(0.05)) / F.col("n_leaves")).alias("value"))
    summed = summed_up(tree, strength).join(leaves(tree), "node").select("node", F.col("value").alias("s"))
    return summed.join(F.broadcast(summed.agg(F.sum("s").alias("total")))).select("node", (F.col("s") / F.col("total")).alias("weight"))


def lowest_common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, distance) for pairs of nodes."""
    up = closure(tree, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    a = up.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("da"), F.col("distance").alias("la"))
    b = up.select(F.col("node").alias("b"), "ancestor", F.col("distance").alias("lb"))
    both = pairs.join(a, "a").join(b, ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min(F.struct("da", "ancestor", "la", "lb")).alias("m")).select("a", "b", F.col("m.ancestor").alias("ancestor"), (F.col("m.la") + F.col("m.lb")).alias("distance"))


def divide(tree: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    """Leaves below the lowest common ancestor of two nodes, and all other leaves."""
    spark = tree.sparkSession
    top = lowest_common_ancestor(tree, spark.createDataFrame([(a, b)], "a bigint, b bigint")).select(F.col("ancestor").alias("node"), F.lit(1.0).alias("value"))
    below = summed_up(tree, top).where("value > 0").join(leaves(tree), "node", "left_semi").select("node")
    return below, leaves(tree).join(below, "node", "left_anti")


def subset(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, parent, length): the tree that chosen tips induce; nodes with tips below two children stay.

    Ways up are made from the chosen nodes and the forks alone.
    """
    up = closure(tree, chosen)
    above = up.where("depth > 0").select(F.col("ancestor").alias("node")).distinct()
    tips = chosen.join(above, "node", "left_anti")
    first = tree.where("parent is not null").select("node", "parent")
    with_tips = up.join(tips, "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    forks = materialize(first.join(with_tips, "node").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select(F.col("parent").alias("node")))
    kept = materialize(tips.select("node").union(forks).distinct())
    near = closure(tree, kept).where("depth > 0").join(forks.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    best = near.groupBy("node").agg(F.min(F.struct("depth", "ancestor", "distance")).alias("m"))
    return kept.join(best, "node", "left").select("node", F.col("m.ancestor").alias("parent"), F.col("m.distance").alias("length"))


def join_order(tree: DataFrame) -> DataFrame:
    """(place, node, left, right): inner nodes from low to high, with their two children; ties by number."""
    inner = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("left"), F.max("node").alias("right"))
    sized = materialize(inner.join(subtree_sizes(tree), "node"))
    # Ranks within sizes plus counts of smaller ones; there are as many rows in the running sum as different sizes.
    counts = sized.groupBy("n_leaves").agg(F.count("*").alias("c"))
    before = counts.select("n_leaves", F.coalesce(F.sum("c").over(Window.orderBy("n_leaves").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("n_leaves").orderBy("node"))
    return sized.withColumn("r", rank).join(before, "n_leaves").select((F.col("before") + F.col("r")).cast("bigint").alias("place"), "node", "left", "right")


def in_order(df: DataFrame, key: str, tie: str, buckets: int = 256) -> DataFrame:
    """df with `place` from 0 by a whole-number key, then a tie: ranks within ranges of the key plus counts of the ranges before."""
    ends = df.agg(F.min(key).alias("lo"), (F.max(key) - F.min(key) + 1).alias("span"))
    dealt = df.join(F.broadcast(ends)).withColumn("bucket", F.floor((F.col(key) - F.col("lo")) * buckets / F.col("span"))).drop("lo", "span")
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("c"))
    before = counts.select("bucket", F.coalesce(F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(key, tie)) - 1
    return dealt.withColumn("r", rank).join(F.broadcast(before), "bucket").withColumn("place", (F.col("before") + F.col("r")).cast("bigint")).drop("bucket", "r", "before")


def chain(leaves_: DataFrame) -> DataFrame:
    """(node, parent, length): leaves (leaf, o) in the order of o, each one step below the one before; inner nodes are -1, -2, ... from the root."""
    placed = materialize(in_order(leaves_, "o", "leaf"))
    n = placed.agg(F.count("*").alias("n"))
    both = placed.join(F.broadcast(n))
    tips = both.select(F.col("leaf").alias("node"), (-F.least("place", F.col("n") - 2) - 1).alias("parent"), F.lit(1.0).alias("length"))
    inner = both.where("place < n - 1").select((-F.col("place") - 1).alias("node"), F.when(F.col("place") > 0, -F.col("place")).alias("parent"), F.when(F.col("place") > 0, 1.0).alias("length"))
    return tips.union(inner)


def join_trees(left: DataFrame, right: DataFrame, length: float = 0.0) -> DataFrame:
    """Both trees below a new root; nodes of the right one are numbered after the left one's."""
    shift = left.agg((F.max("node") + 1).alias("shift"))
    moved = right.join(F.broadcast(shift)).select((F.col("node") + F.col("shift")).alias("node"), (F.col("parent") + F.col("shift")).alias("parent"), "length")
    both = left.select("node", "parent", "length").union(moved)
    root = both.agg((F.max("node") + 1).alias("root"))
    hung = both.join(F.broadcast(root)).select("node", F.coalesce("parent", "root").alias("parent"), F.when(F.col("parent").isNull(), length).otherwise(F.col("length")).alias("length"))
    return hung.union(root.select(F.col("root"), F.lit(None).cast("bigint"), F.lit(None).cast("double")))


def rescale(distances: DataFrame, similarity: bool = False) -> DataFrame:
    """(a, b, d) mapped to 0..10, the nearest pair to 0."""
    ends = distances.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    d = (F.col("hi") - F.col("d")) if similarity else (F.col("d") - F.col("lo"))
    return distances.join(F.broadcast(ends)).select("a", "b", F.when(F.col("hi") > F.col("lo"), 10 * d / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("d"))


def both_ways(distances: DataFrame) -> DataFrame:
    """Each pair in both orders; a pair of a node with itself is an error."""
    a = F.when(F.col("a") == F.col("b"), F.raise_error(F.lit("a pair of one label")).cast("bigint")).otherwise(F.col("a"))
    checked = distances.select(a.alias("a"), "b", "d")
    return checked.union(checked.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
