"""Placing queries on the sequences of a guide tree's nodes: candidates by hits, choice by alignment, gates on the result.

Candidates are ranked in Spark; the alignments of all (query, target) pairs are independent and run in parallel, spread evenly,
so neither a query with many targets nor a target with many queries is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions.sequence import reverse_complement
from sedgeline.operators import kernel
from sedgeline.operators.anchors import aligned, aligned_all, band
from sedgeline.operators.hits import best_with_ties, best_without_ties, merged_hits
from sedgeline.operators.progressive import _places


@dataclass(frozen=True)
class PlacementOptions:
    """Targets looked at and aligned, gates that a placement must pass strictly, the length of a query's branch, and the band around a hit."""

    preselected: int = 10
    aligned: int = 3
    least_overlap: float = 0.5
    least_identity: float = 0.5
    least_score: float = 0.05
    distance: float = 0.1
    offset: int = 15


_SCHEMA = "query string, node string, reversed boolean, score double, overlap double, identity double, normalised double"


def candidates(hits: DataFrame, options: PlacementOptions = PlacementOptions()) -> DataFrame:
    """The targets that each query is aligned with: the best by hit score and all as good as the last of them."""
    ranked = best_with_ties(merged_hits(hits), "query", "score", options.preselected).drop("place")
    return best_with_ties(ranked, "query", "score", options.aligned).drop("place")


def placements(hits: DataFrame, queries: DataFrame, targets: DataFrame, options: PlacementOptions = PlacementOptions()) -> DataFrame:
    """(query, node, reversed, score, overlap, identity, normalised, verdict) of each query's best target.

    ``queries`` and ``targets`` are (name, seq). The best is the one with the highest normalised score, equals all kept. Overlap is the share
    of the query's letters that are aligned, identity that of the aligned ones that are the same, and normalised the pairs' score over
    that of the query with itself. The verdict is 'placed' or 'discarded'. Queries or targets without a sequence have no row; hits on such
    targets take none of the places among which a query's targets are chosen.
    """
    q, t = queries.select(F.col("name").alias("query"), F.col("seq").alias("q")), targets.select(F.col("name").alias("node"), F.col("seq").alias("t"))
    t = t.where("t <> ''")
    chosen = candidates(hits.join(t.select("node"), "node", "left_semi"), options).join(q, "query").join(t, "node")
    turned = F.coalesce(F.col("q_strand") != F.col("t_strand"), F.lit(False)) & F.col("q_strand").isin("+", "-") & F.col("t_strand").isin("+", "-")
    pairs = chosen.select("query", "node", turned.alias("reversed"), F.when(turned, reverse_complement(F.col("q"))).otherwise(F.col("q")).alias("q"), "t").where("q <> ''")

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kernel.model_at(options.distance + 0.001)
        for frame in frames:
            out = []
            paths = aligned_all(list(frame["q"]), list(frame["t"]), model)
            for (query, node, turned_, x, y), (path, _) in zip(frame.itertuples(index=False), paths, strict=True):
                a, b = kernel.letter_states(x), kernel.letter_states(y)
                i, j = (sites[path == 0] - 1 for sites in kernel.sites_of(path))
                pairs_score = model.scores[a[i], b[j]].sum() if len(i) else 0.0
                own = model.scores[a, a].sum()
                same = int((np.array(list(x))[i] == np.array(list(y))[j]).sum())
                out.append((query, node, bool(turned_), float(pairs_score), len(i) / len(x), same / len(i) if len(i) else 0.0, float(pairs_score / own) if own else 0.0))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _SCHEMA.split(", ")])

    scored = pairs.repartition(_places(pairs)).mapInPandas(align, _SCHEMA)
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.round("normalised", 9).desc()))).where("place = 1").drop("place")
    fine = (F.col("overlap") > options.least_overlap) & (F.col("identity") > options.least_identity) & (F.col("normalised") >= options.least_score)
    return best.withColumn("verdict", F.when(fine, "placed").otherwise("discarded"))


def numbered_placements(placed: DataFrame) -> DataFrame:
    """A query that is placed on several nodes gets the names query, query.1, query.2, in order of the nodes."""
    k = F.row_number().over(Window.partitionBy("query").orderBy("node")) - 1
    return placed.withColumn("label", F.when(k > 0, F.concat("query", F.lit("."), k)).otherwise(F.col("query")))


def pileup(reads: DataFrame, group: str, order: str, seq: str, options: PlacementOptions = PlacementOptions()) -> DataFrame:
    """(group, order, row, used): a group's reads aligned one after the other to what has grown so far, on the better strand.

    A read is used if its overlap and identity with the grown alignment's consensus are above the gates; others are left out with a null row.
    The state is sequential, so a group is one task: groups are the assembly's clusters, and parallelism comes from their number.
    """
    key, place = reads.schema[group].dataType.simpleString(), reads.schema[order].dataType.simpleString()

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("o")
        model = kernel.model_at(options.distance + 0.001)
        columns: list[dict[str, str]] = []
        out: dict[int, bool] = {}
        for k, s in enumerate(frame["s"]):
            if not columns:
                columns, out[k] = [{str(k): c} for c in s], True
                continue
            consensus = "".join(max(sorted(set(v.values())), key=list(v.values()).count) for v in columns)
            best = None
            for text in (s, _turned(s)):
                steps, _ = aligned(consensus, text, model)
                on = [(i, j) for mat, i, j in steps if mat == "M"]
                overlap, identity = len(on) / max(len(text), 1), sum(consensus[i - 1] == text[j - 1] for i, j in on) / max(len(on), 1)
                if best is None or identity * overlap > best[0]:
                    best = (identity * overlap, overlap, identity, steps, text)
            _, overlap, identity, steps, text = best
            out[k] = overlap > options.least_overlap and identity > options.least_identity
            if not out[k]:
                continue
            grown = []
            for mat, i, j in steps:
                column = dict(columns[i - 1]) if mat in "MX" else {}
                if mat in "MY":
                    column[str(k)] = text[j - 1]
                grown.append(column)
            columns = grown
        rows = ["".join(c.get(str(k), "-") for c in columns) if out.get(k) else None for k in range(len(frame))]
        return pd.DataFrame({group: frame["g"], order: frame["o"], "row": rows, "used": [out.get(k, False) for k in range(len(frame))]})

    source = reads.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(seq).alias("s")).where("g is not null and s <> ''")
    return source.repartition(_places(source), "g").groupBy("g").applyInPandas(grow, f"{group} {key}, {order} {place}, row string, used boolean")


def _turned(s: str) -> str:
    return s.translate(str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD"))[::-1]


def banded_pair(x: str, y: str, anchors: list[tuple[int, int, int]], model: kernel.Model, offset: int = 15) -> kernel.Matrices:
    """The matrices of two sequences near their anchors; all of them where no path keeps to the band."""
    lo, hi = band(anchors, len(x), len(y), offset)
    found = kernel.Matrices(kernel.linear(x), kernel.linear(y), model, band=(np.array(lo), np.array(hi)))
    return found if np.isfinite(found.end) else kernel.Matrices(kernel.linear(x), kernel.linear(y), model)


def placement_mode(pileup: bool = False, find_orfs: bool = False, fragments: bool = False, one_by_one: bool = False) -> str:
    """How reads are placed under these options: a pile needs no tree, ORFs stand in for their reads, and the hits' best target is the default."""
    if pileup:
        return "pileup-orf" if find_orfs else "pileup"
    base = "fragments" if fragments else "one-by-one" if one_by_one else "search"
    return f"{base}-orf" if find_orfs else base


def orf_queries(orfs: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, comment, translation) of ORFs (key, name, frame, start, end, translation) as queries of their own, numbered by frame and place.

    The comment tells frame, start and end, counted from 1.
    """
    k = F.row_number().over(Window.partitionBy(key).orderBy("frame", "start"))
    comment = F.concat(F.lit("["), "frame", F.lit("."), F.col("start") + 1, F.lit("."), F.col("end") + 1, F.lit("]"))
    return orfs.select(key, F.concat(name, F.lit("_orf"), k).alias("name"), comment.alias("comment"), "translation")


def best_orfs(orfs: DataFrame, reads: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, frame, start, end, orf): the letters of each read's longest ORF, on the strand that it reads; of equals the first frame and place."""
    best = orfs.groupBy(key).agg(F.min_by(F.struct("frame", "start", "end"), F.struct(-(F.col("end") - F.col("start")), "frame", "start")).alias("b")).select(key, "b.*")
    letters = F.expr(f"substring({seq}, start + 1, end - start + 1)")
    return best.join(reads.select(key, seq), key).select(key, "frame", "start", "end", F.when(F.col("frame") > 0, letters).otherwise(reverse_complement(letters)).alias("orf"))


def preselected(hits: DataFrame, queries: DataFrame, tree: DataFrame, n: int = 10) -> DataFrame:
    """(query, node, score, place): the n best targets of each query by its hits, among the nodes of its taxon, or all where no node has it."""
    tagged = tree.where("tid <> ''").select("tid").distinct().withColumn("known", F.lit(True))
    q = queries.join(tagged, "tid", "left").select("query", F.when(F.col("known"), F.col("tid")).alias("want")).distinct()
    nodes = tree.select(F.col("name").alias("node"), F.col("tid").alias("has"))
    open_ = hits.join(q, "query").join(nodes, "node").where(F.col("want").isNull() | (F.col("want") == F.col("has"))).select("query", "node", "score").distinct()
    return best_without_ties(open_, "query", "score", "node", n)
