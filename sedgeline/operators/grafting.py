"""Extending reference alignments and trees by placed queries.

Every site that a query adds has an identity of its own: the reference column that it follows, the query, and its number there.
So queries are aligned with their targets independently and in parallel, whatever their number, and no column is ever renumbered:
the order of the identities gives the columns of the extended alignment in one window an alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.operators import kernel
from sedgeline.operators.anchors import aligned
from sedgeline.operators.placement import PlacementOptions
from sedgeline.operators.progressive import _places


def _gapped(letters: str, places: str) -> Column:
    """Letters at ascending places, gaps between."""
    return F.expr(f"array_join(transform(sequence(1, size({places})), i -> concat(repeat('-', {places}[i - 1] - if(i > 1, {places}[i - 2], 0) - 1), {letters}[i - 1])), '')")


def grafted_cells(rows: DataFrame, placed: DataFrame, queries: DataFrame, options: PlacementOptions = PlacementOptions()) -> DataFrame:
    """(alignment, query, node, col, k, letter): where each letter of each placed query stands.

    ``rows`` (alignment, name, row) holds the reference rows, ``placed`` (query, node) the targets, ``queries`` (name, seq) the letters.
    ``col`` is a column of the reference alignment, 0 before the first; ``k`` is 0 in that column, and numbers added letters behind it.
    """
    sites = F.expr("filter(sequence(1, length(row)), i -> substring(row, i, 1) <> '-')")
    target = rows.where("length(row) > 0").select("alignment", F.col("name").alias("node"), F.replace("row", F.lit("-"), F.lit("")).alias("t"), sites.alias("sites"))
    pairs = placed.select("query", "node").join(target, "node").join(queries.select(F.col("name").alias("query"), F.col("seq").alias("q")), "query").where("q <> '' and t <> ''")

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kernel.model_at(options.distance + 0.001)
        for frame in frames:
            out = []
            for alignment, query, node, q, t in zip(frame["alignment"], frame["query"], frame["node"], frame["q"], frame["t"], strict=True):
                site, k = 0, 0
                sites, ks = [], []
                for mat, i, _ in aligned(t, q, model)[0]:
                    if mat != "Y":
                        site, k = i, 0
                    else:
                        k += 1
                    if mat != "X":
                        sites.append(site)
                        ks.append(k)
                out.append((alignment, query, node, q, sites, ks))
            yield pd.DataFrame(out, columns=["alignment", "query", "node", "q", "at", "ks"])

    kind = rows.schema["alignment"].dataType.simpleString()
    spread = pairs.select("alignment", "query", "node", "q", "t").repartition(_places(pairs))
    found = spread.mapInPandas(align, f"alignment {kind}, query string, node string, q string, at array<int>, ks array<int>").join(target.select("alignment", "node", "sites"), ["alignment", "node"])
    cells = found.select("alignment", "query", "node", "sites", F.explode(F.expr("transform(sequence(1, length(q)), i -> struct(at[i - 1] as site, ks[i - 1] as k, substring(q, i, 1) as letter))")).alias("c"))
    return cells.select("alignment", "query", "node", F.when(F.col("c.site") == 0, 0).otherwise(F.expr("try_element_at(sites, c.site)")).alias("col"), "c.k", "c.letter")


def grafted_rows(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(alignment, name, row, added): the reference rows and the queries' in the extended alignments; ``added`` tells queries."""
    width = rows.groupBy("alignment").agg(F.max(F.length("row")).alias("w"))
    old = width.select("alignment", F.explode(F.sequence(F.lit(1), "w")).alias("col"), F.lit("").alias("by"), F.lit(0).alias("k"))
    new = cells.where("k > 0").select("alignment", "col", F.col("query").alias("by"), "k").distinct()
    order = Window.partitionBy("alignment").orderBy("col", "by", "k")
    columns = old.unionByName(new).withColumn("at", F.row_number().over(order))
    total = columns.groupBy("alignment").agg(F.max("at").alias("n"))
    places = columns.where("k = 0").groupBy("alignment").agg(F.expr("transform(array_sort(collect_list(struct(col, at))), x -> x.at)").alias("places"))
    kept = rows.join(places, "alignment").withColumn("letters", F.expr("filter(split(row, ''), c -> c <> '')")).withColumn("places", F.expr("slice(places, 1, size(letters))"))
    placed = cells.withColumn("by", F.when(F.col("k") == 0, "").otherwise(F.col("query"))).join(columns, ["alignment", "col", "by", "k"])
    read = placed.groupBy("alignment", F.col("query").alias("name")).agg(F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("c")).select("alignment", "name", F.col("c.letter").alias("letters"), F.col("c.at").alias("places"), F.lit(True).alias("added"))
    every = kept.where("size(letters) > 0").select("alignment", "name", "letters", "places", F.lit(False).alias("added")).unionByName(read)
    return every.join(total, "alignment").select("alignment", "name", F.rpad(_gapped("letters", "places"), F.col("n"), "-").alias("row"), "added")


def grafted_tree(tree: DataFrame, placed: DataFrame, distance: float = 0.1, target: float = 0.001) -> DataFrame:
    """(name, parent, side, branch_length): the tree (name, parent, side, branch_length) with a node above each target for each of its queries.

    Queries of one target are put one above the other in order of their names. The new node takes the target's place and branch, the
    target ``target``, the query ``distance``.
    """
    k = F.row_number().over(Window.partitionBy("node").orderBy("query"))
    steps = placed.select("query", "node", k.alias("k"), F.count("*").over(Window.partitionBy("node")).alias("n"))
    inner = lambda i: F.concat(F.lit("#"), "node", F.lit("."), i, F.lit("#"))
    here = tree.select(F.col("name").alias("node"), "parent", "side", "branch_length")
    made = steps.join(here, "node").select(inner(F.col("k")).alias("name"), F.when(F.col("k") == F.col("n"), F.col("parent")).otherwise(inner(F.col("k") + 1)).alias("parent"), F.when(F.col("k") == F.col("n"), F.col("side")).otherwise("left").alias("side"), F.when(F.col("k") == F.col("n"), F.col("branch_length")).otherwise(F.lit(target)).alias("branch_length"))
    queries = steps.select(F.col("query").alias("name"), inner(F.col("k")).alias("parent"), F.lit("right").alias("side"), F.lit(distance).alias("branch_length"))
    moved = tree.join(steps.where("k = 1").select(F.col("node").alias("name"), inner(F.lit(1)).alias("above")), "name", "left")
    on = F.col("above").isNotNull()
    kept = moved.select("name", F.when(on, F.col("above")).otherwise(F.col("parent")).alias("parent"), F.when(on, "left").otherwise(F.col("side")).alias("side"), F.when(on, F.lit(target)).otherwise(F.col("branch_length")).alias("branch_length"))
    return kept.unionByName(made).unionByName(queries)


def one_by_one(reads: DataFrame, group: str, order: str, name: str, seq: str, targets: DataFrame, options: PlacementOptions = PlacementOptions()) -> DataFrame:
    """(group, name, node, score, verdict): each group's reads placed in order, those placed before being targets as well.

    ``targets`` is (group, name, seq). The state is sequential, so a group is one task; groups are independent. Equal scores go to the
    target that came first.
    """
    kind = reads.schema[group].dataType.simpleString()
    rows = reads.select(F.col(group).alias("g"), F.lit(1).alias("role"), F.col(order).cast("double").alias("o"), F.col(name).alias("n"), F.col(seq).alias("s"))
    first = targets.select(F.col(group).alias("g"), F.lit(0).alias("role"), F.lit(0.0).alias("o"), F.col(name).alias("n"), F.col(seq).alias("s"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        model = kernel.model_at(options.distance + 0.001)
        known: list[tuple[str, str, kernel.Graph]] = []
        out = []
        for role, n, s in frame.sort_values(["role", "o", "n"])[["role", "n", "s"]].itertuples(index=False):
            g = kernel.linear(s)
            best = None
            if role:
                own = float(model.scores[g.states, g.states].sum())
                for target, text, t in known:
                    on = [(i, j) for mat, i, j in aligned(s, text, model)[0] if mat == "M"]
                    score = sum(float(model.scores[g.states[i - 1], t.states[j - 1]]) for i, j in on)
                    same = sum(g.states[i - 1] == t.states[j - 1] for i, j in on)
                    if best is None or score > best[1] + 1e-9:
                        best = (target, score, len(on) / g.n, same / max(len(on), 1), score / own if own else 0.0)
                fine = best is not None and best[2] > options.least_overlap and best[3] > options.least_identity and best[4] >= options.least_score
                out.append((frame["g"].iloc[0], n, best and best[0], best and best[1], "placed" if fine else "discarded"))
                if not fine:
                    continue
            known.append((n, s, g))
        return pd.DataFrame(out, columns=["g", "name", "node", "score", "verdict"])

    both = rows.unionByName(first).where("g is not null and n is not null and s <> ''")
    found = both.repartition(_places(both), "g").groupBy("g").applyInPandas(place, f"g {kind}, name string, node string, score double, verdict string")
    return found.withColumnRenamed("g", group)


def upward(scores: DataFrame, tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, leaf, node): from each query's best leaf up, as long as the node above scores at least as high.

    ``scores`` is (query, node_id, score), ``pairs`` the tree's ancestry. Nodes without a score have none to go on with. The whole way of a
    leaf is one join with its ancestors, not a loop.
    """
    from sedgeline.operators.trees import leaves

    tips = leaves(tree).select("node_id")
    at = scores.join(tips, "node_id", "left_semi")
    best = at.groupBy("query").agg(F.min_by("node_id", F.struct(-F.col("score"), "node_id")).alias("leaf"))
    way = best.join(pairs.select(F.col("node_id").alias("leaf"), F.col("ancestor_id").alias("node_id"), "steps"), "leaf").join(scores, ["query", "node_id"], "left")
    along = Window.partitionBy("query").orderBy("steps")
    stops = (F.col("steps") > 0) & (F.col("score").isNull() | (F.col("score") < F.coalesce(F.lag("score").over(along), F.lit(float("inf")))))
    reached = way.withColumn("stopped", F.max(stops.cast("int")).over(along)).where("stopped = 0 or steps = 0")
    return reached.groupBy("query").agg(F.first("leaf").alias("leaf"), F.max_by("node_id", "steps").alias("node"))
