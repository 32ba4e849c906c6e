"""Search hits: totals of pairs, merging, ranking with and without ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_totals(anchors: DataFrame, first: str = "seq_1", second: str = "seq_2") -> DataFrame:
    """Scores of each pair by strand: plus where both strands are forward, minus for the rest, and the higher of the two.

    ``reversed`` tells that the minus strand scores strictly more. Null scores count 0, null strands as not forward.
    """
    both = F.coalesce(F.col("plus_1") & F.col("plus_2"), F.lit(False))
    score = F.coalesce("score", F.lit(0)).cast("long")
    sums = anchors.groupBy(first, second).agg(F.sum(F.when(both, score).otherwise(0)).alias("plus"), F.sum(F.when(both, 0).otherwise(score)).alias("minus"))
    return sums.withColumn("total", F.greatest("plus", "minus")).withColumn("reversed", F.col("minus") > F.col("plus"))


def merged_hits(hits: DataFrame) -> DataFrame:
    """One row per (query, node): hits of the same strands are summed and spanned, then the strands of the higher score win.

    Equal scores: the smaller strands in byte order. Hits without a query, node or score are left out.
    """
    rows = hits.where("query is not null and node is not null and score is not null")
    same = rows.groupBy("query", "node", "q_strand", "t_strand").agg(F.sum("score").alias("score"), F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    order = Window.partitionBy("query", "node").orderBy(F.col("score").desc(), "q_strand", "t_strand")
    return same.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def best_with_ties(df: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """The k best rows of each group and all that equal the k-th. Written as a rank filter, which Spark applies before the shuffle."""
    return df.withColumn("place", F.rank().over(Window.partitionBy(group).orderBy(F.col(score).desc()))).where(F.col("place") <= k)


def best_without_ties(df: DataFrame, group: str, score: str, name: str, k: int) -> DataFrame:
    """The k best rows of each group; equal scores in ascending order of ``name``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(name)))).where(F.col("place") <= k)


def above_fraction(df: DataFrame, group: str, score: str, fraction: float) -> DataFrame:
    """Rows whose score is above the whole part of ``fraction`` of their group's best."""
    top = F.max(score).over(Window.partitionBy(group))
    return df.withColumn("floor", F.floor(top * F.lit(fraction)).cast("long")).where(F.col(score) > F.col("floor"))


def single_best(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """The best row of each group; among equals the last in order of ``name``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(name).desc()))).where("place = 1").drop("place")


def node_order(name: str) -> list:
    """Sort keys: plain names in byte order, then #n# by number."""
    number = F.regexp_extract(name, "^#(\\d+)#$", 1)
    return [number != "", F.when(number != "", number.cast("long")).otherwise(0), F.col(name)]
