"""States of inner nodes from aligned leaves: by parsimony and by likelihood; guide trees from distances; choice of distant leaves.

Columns are independent. A tree's rows are one group; within it all columns are computed at once with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.models import dna_matrix
from sedgeline.functions.sequence import BASE_BITS, DNA, child_parsimony, parsimony
from sedgeline.operators.progressive import _places

_BITS = np.zeros(256, np.int64)
for _letter, _bits in BASE_BITS.items():
    _BITS[ord(_letter)] = _BITS[ord(_letter.lower())] = _bits
_LETTER = np.array([ord("-")] * 16, np.uint8)
for _letter in DNA:
    _LETTER[BASE_BITS[_letter]] = ord(_letter)


def _order(frame: pd.DataFrame) -> tuple[list[int], dict[int, list[int]]]:
    """Nodes, children before parents, and each node's children."""
    children: dict[int, list[int]] = {}
    root = None
    for n, p in zip(frame["node_id"], frame["parent_id"], strict=True):
        if p is None or p != p:
            root = n
        else:
            children.setdefault(int(p), []).append(int(n))
    out, stack = [], [int(root)]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += children.get(n, [])
    return out[::-1], children


def _fitch(frame: pd.DataFrame) -> pd.DataFrame:
    order, children = _order(frame)
    rows = {int(n): r for n, r in zip(frame["node_id"], frame["row"], strict=True) if isinstance(r, str)}
    width = max(map(len, rows.values()), default=0)
    sets: dict[int, np.ndarray] = {}
    for n in order:
        if n in children:
            first, *others = (sets[c] for c in children[n])
            for s in others:
                first = np.where(first & s > 0, first & s, first | s)
            sets[n] = first
        else:
            sets[n] = _BITS[np.frombuffer(rows.get(n, "").ljust(width, "-").encode(), np.uint8)]
    for n in order[::-1]:
        for c in children.get(n, []):
            sets[c] = np.where(sets[n] & sets[c] > 0, sets[n] & sets[c], sets[c])
    inner = [n for n in order if n in children]
    return pd.DataFrame({"tree": frame["tree"].iloc[0], "node_id": inner, "row": [_LETTER[sets[n]].tobytes().decode() for n in inner]})


def _likely(pi: tuple[float, float, float, float]):
    def of_tree(frame: pd.DataFrame) -> pd.DataFrame:
        order, children = _order(frame)
        rows = {int(n): r for n, r in zip(frame["node_id"], frame["row"], strict=True) if isinstance(r, str)}
        length = {int(n): float(t) if t == t and t is not None else 0.0 for n, t in zip(frame["node_id"], frame["branch_length"], strict=True)}
        width = max(map(len, rows.values()), default=0)
        below: dict[int, np.ndarray] = {}
        for n in order:
            if n in children:
                below[n] = np.prod([below[c] @ dna_matrix(max(length[c], 1e-6), pi).T for c in children[n]], axis=0)
                below[n] /= below[n].sum(1, keepdims=True)
            else:
                bits = _BITS[np.frombuffer(rows.get(n, "").ljust(width, "-").encode(), np.uint8)]
                bits = np.where(bits == 0, 15, bits)
                below[n] = (bits[:, None] >> np.arange(4) & 1).astype(float)
        best: dict[int, np.ndarray] = {}
        for n in order[::-1]:
            if n == order[-1]:
                best[n] = (below[n] * np.array(pi)).argmax(1)
            for c in children.get(n, []):
                best[c] = (below[c] * dna_matrix(max(length[c], 1e-6), pi)[best[n]]).argmax(1)
        inner = [n for n in order if n in children]
        return pd.DataFrame({"tree": frame["tree"].iloc[0], "node_id": inner, "row": ["".join("ACGT"[k] for k in best[n]) for n in inner]})

    return of_tree


def _grouped(tree: DataFrame, rows: DataFrame, function) -> DataFrame:
    kind = tree.schema["tree"].dataType.simpleString()
    joined = tree.select("tree", "node_id", "parent_id", "branch_length").join(rows.select("node_id", "row"), "node_id", "left")
    return joined.repartition(_places(joined), "tree").groupBy("tree").applyInPandas(function, f"tree {kind}, node_id int, row string")


def parsimony_rows(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """(tree, node_id, row) of inner nodes by Fitch's two passes; ``tree`` has (tree, node_id, parent_id, branch_length), ``rows`` (node_id, row).

    Rows that are shorter than the longest of their tree end in gaps; a gap says nothing of its column, and is the state where no leaf has a letter.
    """
    return _grouped(tree, rows, _fitch)


def one_sided(above: Column, target: Column, query: Column) -> tuple[Column, Column]:
    """The base sets of a node that a query is grafted to above its target, and these in the light of the node above; nothing else changes."""
    grafted = parsimony(target, query)
    return grafted, child_parsimony(above, grafted)


def likelihood_rows(tree: DataFrame, rows: DataFrame, pi: tuple[float, float, float, float] = (0.25,) * 4) -> DataFrame:
    """As ``parsimony_rows``, but the states that are most probable from the root down, given the nucleotide model."""
    return _grouped(tree, rows, _likely(pi))


def _neighbour_joining(names: list, d: np.ndarray) -> list[tuple]:
    """(node_id, parent_id, name, branch_length) of the tree of a distance matrix, rooted on the last join."""
    ids = list(range(1, len(names) + 1))
    out = {i: [i, None, n, None] for i, n in zip(ids, names, strict=True)}
    following = len(names)
    while len(ids) > 1:
        n = len(ids)
        sums = d.sum(1)
        q = (n - 2) * d - sums[:, None] - sums[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n)) if n > 2 else (0, 1)
        following += 1
        a = d[i, j] / 2 + ((sums[i] - sums[j]) / (2 * (n - 2)) if n > 2 else 0.0)
        for k, length in ((i, a), (j, d[i, j] - a)):
            out[ids[k]][1], out[ids[k]][3] = following, max(float(length), 0.0)
        out[following] = [following, None, None, None]
        joined = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], joined[keep][:, None]], [joined[keep][None, :], np.zeros((1, 1))]])
        ids = [ids[k] for k in keep] + [following]
    return [tuple(r) for r in out.values()]


def guide_trees(seqs: DataFrame, group: str, name: str, seq: str, k: int = 6) -> DataFrame:
    """(group, node_id, parent_id, name, branch_length): a neighbour-joining tree of each group, from the shares of common k-mers."""
    kind, label = seqs.schema[group].dataType.simpleString(), seqs.schema[name].dataType.simpleString()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        sets = [{s[i : i + k] for i in range(max(len(s) - k + 1, 1))} for s in frame["s"]]
        d = np.array([[1 - len(a & b) / max(min(len(a), len(b)), 1) for b in sets] for a in sets])
        rows = _neighbour_joining(frame["n"].tolist(), d)
        return pd.DataFrame([(frame["g"].iloc[0], *r) for r in rows], columns=[group, "node_id", "parent_id", "name", "branch_length"])

    source = seqs.select(F.col(group).alias("g"), F.col(name).alias("n"), F.col(seq).alias("s")).where("g is not null and n is not null and s is not null")
    return source.repartition(_places(source), "g").groupBy("g").applyInPandas(build, f"{group} {kind}, node_id int, parent_id int, name {label}, branch_length double")


def distant_leaves(distances: DataFrame, n: int) -> list[int]:
    """n leaves far from each other: the two farthest, then always the one farthest from those chosen; of equals the smallest id.

    ``distances`` is (leaf_a, leaf_b, distance). Each round is one aggregate over the leaves; only the chosen ids reach the driver.
    """
    both = distances.unionByName(distances.select(F.col("leaf_b").alias("leaf_a"), F.col("leaf_a").alias("leaf_b"), "distance"))
    first = both.orderBy(F.col("distance").desc(), "leaf_a", "leaf_b").first()
    chosen = [] if first is None else [first["leaf_a"], first["leaf_b"]]
    while chosen and len(chosen) < n:
        far = both.where(F.col("leaf_b").isin(chosen) & ~F.col("leaf_a").isin(chosen)).groupBy("leaf_a").agg(F.min("distance").alias("d"))
        following = far.orderBy(F.col("d").desc(), "leaf_a").first()
        if following is None:
            break
        chosen.append(following["leaf_a"])
    return sorted(chosen[:n])
