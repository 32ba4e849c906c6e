"""Rooted trees as parent-pointer tables (node_id, parent_id, side, name, branch_length, tid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.workspace import numbered, stored


def ancestry(tree: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, steps, distance) of every node with itself and each of its ancestors.

    Pointer doubling: each round joins pairs to pairs and doubles the reach, so a tree of depth d takes log2(d) rounds,
    with the pairs written to the shared folder in between. Negative and null lengths count 0.
    """
    length = F.greatest(F.coalesce("branch_length", F.lit(0.0)), F.lit(0.0))
    up = tree.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("steps"), length.alias("distance"))
    pairs = tree.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("steps"), F.lit(0.0).alias("distance")).unionByName(up)
    jump = up
    while True:
        lower = jump.select("node_id", F.col("ancestor_id").alias("via"), F.col("steps").alias("s1"), F.col("distance").alias("d1"))
        upper = pairs.select(F.col("node_id").alias("via"), "ancestor_id", F.col("steps").alias("s2"), F.col("distance").alias("d2"))
        reached = lower.join(upper, "via").where("s2 > 0").select("node_id", "ancestor_id", (F.col("s1") + F.col("s2")).alias("steps"), (F.col("d1") + F.col("d2")).alias("distance"))
        reached = stored(reached, "ancestry")
        if reached.isEmpty():
            return pairs
        pairs = stored(pairs.unionByName(reached), "ancestry")
        far = jump.agg(F.max("steps")).first()[0]
        jump = pairs.where(F.col("steps") == 2 * far).select("node_id", "ancestor_id", "steps", "distance")


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), "node_id", "left_anti")


def target_candidates(queries: DataFrame, tree: DataFrame, how: str = "tid") -> DataFrame:
    """(query, tid, target, how): the nodes that each of ``queries`` (query, tid) is held against, by the class of nodes.

    terminal, internal, all: every query with every node of the class. tid: with the nodes of its taxon, and those queries whose taxon
    no node has with all nodes, which ``how`` tells. Null and empty taxa are none.
    """
    nodes = tree.select(F.col("name").alias("target"), "tid")
    if how == "tid":
        tagged = nodes.where("tid <> ''")
        own = queries.join(tagged, "tid").select("query", "tid", "target", F.lit("tid").alias("how"))
        return own.unionByName(_with_each(queries.join(tagged.select("tid").distinct(), "tid", "left_anti"), nodes, "all"))
    if how not in ("terminal", "internal", "all"):
        raise ValueError(f"no class of nodes: {how}")
    if how != "all":
        of = leaves(tree)
        nodes = (of if how == "terminal" else tree.join(of.select("node_id"), "node_id", "left_anti")).select(F.col("name").alias("target"))
    return _with_each(queries, nodes, how)


def _with_each(queries: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Queries are spread first: their bytes say nothing of the rows that come of them."""
    places = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.repartition(places).join(F.broadcast(nodes.select("target")), F.lit(True)).select("query", "tid", "target", F.lit(how).alias("how"))


def counts_below(tree: DataFrame, pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node_id, nodes, leaves, weight, depth): of each node's subtree, itself included; ``weights`` (name, weight) of leaves."""
    tips = leaves(tree).select(F.col("node_id"), "name", F.lit(1).alias("leaf"))
    if weights is not None:
        tips = tips.join(weights, "name", "left")
    else:
        tips = tips.withColumn("weight", F.lit(1).cast("long"))
    below = pairs.join(tips.select("node_id", "leaf", "weight"), "node_id", "left")
    counts = below.groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("nodes"), F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves"), F.sum(F.when(F.col("leaf") == 1, F.coalesce("weight", F.lit(1))).otherwise(0)).cast("long").alias("weight"))
    depth = pairs.groupBy("node_id").agg(F.max("steps").alias("depth"))
    return counts.join(depth, "node_id")


def parent_child_pairs(tree: DataFrame) -> DataFrame:
    parent = tree.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return tree.where("parent_id is not null").select("node_id", "parent_id", "side", "name").join(parent, "parent_id")


def traversal(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, in_order, post_order), from the path of sides that leads to each node."""
    turn = tree.select(F.col("node_id").alias("ancestor_id"), F.when(F.col("side") == "left", "0").when(F.col("side") == "right", "2").alias("turn"))
    path = pairs.join(turn, "ancestor_id").where("turn is not null").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("o"), "turn"))).alias("p"))
    path = tree.select("node_id").join(path, "node_id", "left").select("node_id", F.coalesce(F.array_join(F.transform("p", lambda x: x["turn"]), ""), F.lit("")).alias("path"))
    # In order a node stands between its left (0) and right (2) subtrees; in post-order after both.
    turned = numbered(path, [F.concat("path", F.lit("1"))], "in_order")
    return numbered(turned, [F.concat("path", F.lit("3"))], "post_order").select("node_id", "in_order", "post_order")


def pruned(tree: DataFrame, pairs: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree of the leaves whose name is in ``keep``: others go, unary nodes are collapsed and lengths summed.

    (node_id, parent_id, name, branch_length); a node stays if it is a kept leaf or two of its children lead to kept ones.
    """
    kept = leaves(tree).join(keep.select("name").distinct(), "name", "left_semi").select("node_id")
    above = pairs.join(kept, "node_id", "left_semi")
    child_of = pairs.where("steps = 1").select("node_id", F.col("ancestor_id").alias("parent_id"))
    live = above.select(F.col("ancestor_id").alias("node_id")).distinct()
    forks = child_of.join(live, "node_id", "left_semi").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n > 1").select("node_id")
    stay = forks.union(kept).distinct()
    up = pairs.where("steps > 0").join(stay, "node_id", "left_semi").join(stay.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi")
    nearest = up.groupBy("node_id").agg(F.min_by(F.struct("ancestor_id", "distance"), "steps").alias("u"))
    return stay.join(nearest, "node_id", "left").join(tree.select("node_id", "name"), "node_id").select("node_id", F.col("u.ancestor_id").alias("parent_id"), "name", F.col("u.distance").alias("branch_length"))


def leaf_distances(pairs: DataFrame, tips: DataFrame) -> DataFrame:
    """(leaf_a, leaf_b, distance), leaf_a < leaf_b, along the tree: the common ancestor with the shortest sum is the lowest one."""
    up = pairs.join(tips.select("node_id"), "node_id", "left_semi")
    a = up.select(F.col("node_id").alias("leaf_a"), "ancestor_id", F.col("distance").alias("da"), F.col("steps").alias("sa"))
    b = up.select(F.col("node_id").alias("leaf_b"), "ancestor_id", F.col("distance").alias("db"))
    met = a.join(b, "ancestor_id").where("leaf_a < leaf_b")
    return met.groupBy("leaf_a", "leaf_b").agg(F.min_by(F.col("da") + F.col("db"), "sa").alias("distance"))


def nearest_tagged(tips: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, ref, distance): for each leaf without a taxon the nearest along the tree that has one, of equals the smaller id.

    Only the nearest tagged leaf below each node is kept, and each query meets one row for each of its ancestors: over the lowest common
    one the way is as long as it is, over others no shorter.
    """
    below = pairs.join(tips.where("tid is not null").select("node_id"), "node_id", "left_semi").groupBy("ancestor_id").agg(F.min(F.struct(F.round("distance", 9).alias("d"), F.col("node_id").alias("ref"))).alias("r"))
    queries = pairs.join(tips.where("tid is null").select("node_id"), "node_id", "left_semi")
    met = queries.join(below, "ancestor_id").select(F.col("node_id").alias("query"), F.round(F.col("distance") + F.col("r.d"), 9).alias("distance"), F.col("r.ref").alias("ref"))
    return met.groupBy("query").agg(F.min(F.struct("distance", "ref")).alias("x")).select("query", "x.ref", "x.distance")
