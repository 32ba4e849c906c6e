"""Progressive alignment along guide trees, and the rows of the alignment.

The tree is cut into blocks, subtrees of at most ``block`` sequences: each block is aligned bottom-up in one task, all blocks in
parallel; then the blocks' roots are the leaves of a smaller tree. The number of rounds is the logarithm of the tree's size
for any reasonably balanced tree. Between rounds the graphs are written to the shared folder.

A node's row holds its graph and, for each of its sites, the sites of its children. Alignment columns are the root's sites;
every other node's are found by composing these maps along the tree, doubling the reach with each join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions.models import dna_scores
from sedgeline.functions.sequence import DNA, branch_length
from sedgeline.operators import kernel
from sedgeline.operators.anchors import aligned_all
from sedgeline.operators.trees import ancestry
from sedgeline.workspace import stored

_GRAPH = "states array<int>, src array<int>, dst array<int>, weight array<double>, unused array<int>, age array<double>"
NODE_SCHEMA = f"node_id int, left_child int, right_child int, left array<int>, right array<int>, score double, {_GRAPH}"


def _packed(g: kernel.Graph) -> list:
    return [x.astype(t).tolist() for x, t in ((g.states, np.int32), (g.src, np.int32), (g.dst, np.int32), (g.weight, float), (g.unused, np.int32), (g.age, float))]


def _unpacked(row) -> kernel.Graph:
    return kernel.Graph(np.array(row.states, np.int64), np.array(row.src, np.int64), np.array(row.dst, np.int64), np.array(row.weight, float), np.array(row.unused, np.int64), np.array(row.age, float))


def _align_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Aligns a block's inner nodes, children before parents."""
    ready = {r.node_id: _unpacked(r) for r in rows[rows.inner == 0].itertuples()}
    todo = {r.node_id: r for r in rows[rows.inner == 1].itertuples()}
    stack, out = list(todo), []
    while stack:
        r = todo.get(stack[-1])
        if r is None or r.node_id in ready:
            stack.pop()
            continue
        missing = [c for c in (r.left_child, r.right_child) if c not in ready]
        if missing:
            stack += missing
            continue
        stack.pop()
        model = kernel.model_at(r.t_left + r.t_right)
        made = kernel.ancestor(ready[r.left_child], ready[r.right_child], r.t_left, r.t_right, model)
        ready[r.node_id] = made.graph
        out.append([r.node_id, r.left_child, r.right_child, made.left.astype(np.int32).tolist(), made.right.astype(np.int32).tolist(), made.score, *_packed(made.graph)])
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=names)


def _places(df: DataFrame) -> int:
    """Partitions for the kernel: its rows are few and heavy, so they aren't to be gathered by their bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def leaf_graphs(seqs: DataFrame) -> DataFrame:
    """Chains of (node_id, seq), as columns; letters outside the nucleotide alphabet count as N."""
    states = F.expr(f"transform(filter(split(seq, ''), c -> c <> ''), c -> if(instr('{DNA}', c) > 0, instr('{DNA}', c) - 1, 14))")
    n = F.length("seq")
    return seqs.select(
        "node_id", states.alias("states"), F.sequence(F.lit(0), n).alias("src"), F.sequence(F.lit(1), n + 1).alias("dst"), F.array_repeat(F.lit(1.0), n + 1).alias("weight"), F.array_repeat(F.lit(0), n + 1).alias("unused"), F.array_repeat(F.lit(0.0), n + 1).alias("age")
    )


def progressive_alignment(tree: DataFrame, graphs: DataFrame, block: int = 64) -> DataFrame:
    """Aligned inner nodes (see NODE_SCHEMA) of binary trees whose leaves' graphs are given (node_id and graph columns).

    Leaves without a graph must have been pruned. Several trees may be given at once.
    """
    pairs = stored(ancestry(tree).select("node_id", "ancestor_id", "steps"), "pairs")
    child = lambda side, n: tree.where(F.col("side") == side).select(F.col("parent_id").alias("node_id"), F.col("node_id").alias(f"{n}_child"), branch_length(F.col("branch_length")).alias(f"t_{n}"))
    inner = child("left", "left").join(child("right", "right"), "node_id")
    parent = tree.select("node_id", "parent_id")
    ready, done = graphs, None
    rest = stored(inner, "rest")
    while True:
        frontier = ready.select("node_id")
        sizes = pairs.join(frontier, "node_id", "left_semi").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n")).join(rest.select("node_id"), "node_id", "left_semi")
        above = sizes.select(F.col("node_id").alias("parent_id"), F.col("n").alias("above"))
        roots = sizes.join(parent, "node_id").join(above, "parent_id", "left").where((F.col("n") <= block) & (F.col("above").isNull() | (F.col("above") > block))).select(F.col("node_id").alias("block"))
        of = pairs.select("node_id", F.col("ancestor_id").alias("block")).join(roots, "block")
        nodes = rest.join(of, "node_id").select("block", "node_id", F.lit(1).alias("inner"), "left_child", "right_child", "t_left", "t_right", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _GRAPH.split(", ")])
        tips = ready.join(of, "node_id").select("block", "node_id", F.lit(0).alias("inner"), F.lit(0).alias("left_child"), F.lit(0).alias("right_child"), F.lit(0.0).alias("t_left"), F.lit(0.0).alias("t_right"), "states", "src", "dst", "weight", "unused", "age")
        made = stored(nodes.unionByName(tips).repartition(_places(tree), "block").groupBy("block").applyInPandas(_align_block, NODE_SCHEMA), "aligned")
        done = made if done is None else done.unionByName(made)
        rest = stored(rest.join(made.select("node_id"), "node_id", "left_anti"), "rest")
        if rest.isEmpty():
            return done
        used = of.select("node_id").distinct()
        tops = made.join(roots.select(F.col("block").alias("node_id")), "node_id", "left_semi")
        columns = ["node_id", "states", "src", "dst", "weight", "unused", "age"]
        ready = stored(ready.select(columns).join(used, "node_id", "left_anti").unionByName(tops.select(columns)), "ready")


def column_maps(nodes: DataFrame) -> DataFrame:
    """(node_id, root_id, sites): for every node below a root, the root included, its site in each column, 0 where it has none."""
    down = nodes.select(F.col("left_child").alias("node_id"), F.col("node_id").alias("up"), F.col("left").alias("sites")).unionByName(nodes.select(F.col("right_child").alias("node_id"), F.col("node_id").alias("up"), F.col("right").alias("sites")))
    roots = nodes.join(down.select("node_id"), "node_id", "left_anti").select("node_id", F.col("node_id").alias("up"), F.sequence(F.lit(1), F.size("left")).alias("sites"))
    now = stored(down.unionByName(roots), "maps")
    is_root = roots.select(F.col("node_id").alias("up")).distinct()
    while not now.join(is_root, "up", "left_anti").isEmpty():
        upper = now.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("sites").alias("outer"))
        composed = F.transform("outer", lambda c: F.when(c == 0, 0).otherwise(F.element_at("sites", c)))
        now = stored(now.join(upper, "up").select("node_id", F.col("up2").alias("up"), composed.alias("sites")), "maps")
    return now.select("node_id", F.col("up").alias("root_id"), "sites")


def alignment_rows(maps: DataFrame, seqs: DataFrame) -> DataFrame:
    """(node_id, root_id, row) of the leaves (node_id, seq): their letters in the columns, gaps elsewhere."""
    letter = F.transform("sites", lambda c: F.when(c == 0, "-").otherwise(F.element_at("chars", c)))
    chars = seqs.select("node_id", F.filter(F.split("seq", ""), lambda c: c != "").alias("chars"))
    return maps.join(chars, "node_id").select("node_id", "root_id", F.array_join(letter, "").alias("row"))


def ancestor_rows(maps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, root_id, row) of inner nodes: the letters of their states; a gap where a site isn't on any way through."""
    real = F.expr(f"transform(sequence(1, size(states)), i -> if(array_contains(src, i) and array_contains(dst, i), substring('{DNA}', states[i - 1] + 1, 1), '-'))")
    chars = nodes.where(F.size("states") > 0).select("node_id", real.alias("chars"))
    letter = F.transform("sites", lambda c: F.when(c == 0, "-").otherwise(F.element_at("chars", c)))
    return maps.join(chars, "node_id").select("node_id", "root_id", F.array_join(letter, "").alias("row"))


def _row(seq: str, there: np.ndarray) -> np.ndarray:
    """A sequence's letters in the columns that have one, gaps in the others."""
    out = np.full(len(there), ord("-"), np.uint32)
    out[there] = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _text(letters: np.ndarray) -> str:
    return letters.tobytes().decode("utf-32-le", "surrogatepass")


def pairwise(pairs: DataFrame, t: float = 0.2, key: str = "pair_id", total: bool = False) -> DataFrame:
    """(key, row_a, row_b, score, rescored, matched, aligned) of the best alignment of each pair (key, a, b) of sequences.

    ``rescored`` is the score of the rows, added up step by step: the one that the matrices promise. Pairs are independent;
    they are spread evenly, whatever their keys. A null sequence counts as an empty one.
    """
    source = pairs.select(key, F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).repartition(_places(pairs))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kernel.model_at(t)
        for frame in frames:
            out = []
            found = aligned_all(list(frame["a"]), list(frame["b"]), model)
            for (k, a, b), (path, score) in zip(frame.itertuples(index=False), found, strict=True):
                x, y = _row(a, path != 2), _row(b, path != 1)
                again = kernel.chain_score(path, kernel.letter_states(a), kernel.letter_states(b), model)
                if total:
                    score = kernel.Matrices(kernel.linear(a), kernel.linear(b), model, total=True).end
                both = path == 0
                out.append((k, _text(x), _text(y), score, again, int((x == y)[both].sum()), int(both.sum())))
            yield pd.DataFrame(out, columns=[key, "row_a", "row_b", "score", "rescored", "matched", "aligned"])

    return source.mapInPandas(align, T.StructType([source.schema[key], *T.StructType.fromDDL("row_a string, row_b string, score double, rescored double, matched int, aligned int")]))


def match_scores(rows: DataFrame, key: str, a: str, b: str, t: float) -> DataFrame:
    """(key, score, normalised, overlap, identity) of two rows of one alignment: the summed scores of the columns in which both have letters.

    ``normalised`` divides by the first row's score with itself, ``overlap`` counts its letters that are paired, identity those of them
    that are the same. Letters outside the nucleotide alphabet score nothing; a share of nothing is null.
    """
    scores = dna_scores(t)
    table = F.create_map(*[F.lit(x) for i, p in enumerate(DNA) for j, q in enumerate(DNA) for x in (p + q, float(scores[i, j]))])
    cells = rows.select(key, F.posexplode(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))).alias("i", "c")).select(key, F.col("c.x").alias("x"), F.col("c.y").alias("y")).where("x <> '' and x <> '-'")
    score = lambda p, q: F.coalesce(F.try_element_at(table, F.concat(p, q)), F.lit(0.0))
    paired = (F.coalesce("y", F.lit("")) != "") & (F.col("y") != "-")
    sums = cells.groupBy(key).agg(F.sum(F.when(paired, score(F.col("x"), F.col("y"))).otherwise(0.0)).alias("score"), F.sum(score(F.col("x"), F.col("x"))).alias("own"), F.count_if(paired).alias("n"), F.count_if(paired & (F.col("x") == F.col("y"))).alias("same"), F.count("*").alias("size"))
    return sums.select(key, F.round("score", 5).alias("score"), F.round(F.try_divide("score", "own"), 5).alias("normalised"), F.round(F.col("n") / F.col("size"), 9).alias("overlap"), F.round(F.try_divide("same", "n"), 9).alias("identity"))


def attached_edges(seqs: DataFrame, edges: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, edge_from, edge_to, weight, from_letter, to_letter) of the edges between two sites of their sequence, counted from 1."""
    inside = (F.col("edge_from") >= 1) & (F.col("edge_from") < F.col("edge_to")) & (F.col("edge_to") <= F.length(seq))
    joined = edges.join(seqs.select(key, seq), key).where(inside)
    return joined.select(key, "edge_from", "edge_to", "weight", F.expr(f"substring({seq}, int(edge_from), 1)").alias("from_letter"), F.expr(f"substring({seq}, int(edge_to), 1)").alias("to_letter"))


#: Cells of the pairs whose posteriors are computed together.
_CELLS = 1 << 18


def _posteriors(frame: pd.DataFrame, model: kernel.Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the pairs, probabilities, forward totals, backward totals) of a frame's pairs a and b, those of one size together."""
    sizes = pd.DataFrame({"n": frame["a"].str.len().to_numpy(), "m": frame["b"].str.len().to_numpy()})
    for (n, m), rows in sizes.groupby(["n", "m"]).indices.items():
        most = max(_CELLS // ((n + 1) * (m + 1)), 1)
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            states = (kernel.letter_states("".join(frame[c].iloc[part])).reshape(len(part), -1) for c in ("a", "b"))
            yield part, *kernel.chain_posteriors(*states, model)


def posterior_rows(pairs: DataFrame, key: str, t: float = 0.2, least: float = 0.0) -> DataFrame:
    """(key, i, j, p, forward, backward): the probability that sites i and j of each pair (key, a, b) stand together, above ``least``, and the
    pair's totals by the forward and the backward pass. Site 0 of a pair stands for the pair itself, with the probability 0."""
    source = pairs.select(key, "a", "b").where("a <> '' and b <> ''").repartition(_places(pairs))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kernel.model_at(t)
        for frame in frames:
            for part, p, forward, backward in _posteriors(frame, model):
                shown = p > least
                shown[:, 0, 0] = True
                k, i, j = np.nonzero(shown)
                yield pd.DataFrame({key: frame[key].iloc[part[k]].to_numpy(), "i": i.astype(np.int32), "j": j.astype(np.int32), "p": p[k, i, j], "forward": forward[k], "backward": backward[k]})

    return source.mapInPandas(align, T.StructType([source.schema[key], *T.StructType.fromDDL("i int, j int, p double, forward double, backward double")]))


def posterior_sums(pairs: DataFrame, key: str, t: float = 0.2) -> DataFrame:
    """(key, most, forward, backward) of each pair (key, a, b): the highest sum of the probabilities with which one site of the first sequence
    stands with the sites of the second, and the totals by the forward and the backward pass."""
    source = pairs.select(key, "a", "b").where("a <> '' and b <> ''").repartition(_places(pairs))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kernel.model_at(t)
        for frame in frames:
            for part, p, forward, backward in _posteriors(frame, model):
                yield pd.DataFrame({key: frame[key].iloc[part].to_numpy(), "most": p.sum(axis=2).max(axis=1), "forward": forward, "backward": backward})

    return source.mapInPandas(align, T.StructType([source.schema[key], *T.StructType.fromDDL("most double, forward double, backward double")]))
