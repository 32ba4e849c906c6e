"""Covered periods and gaps of the search hits' queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators.intervals import covered_periods


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of each query over all its hits; unknown (null, negative, equal) coordinates don't count."""
    hits = spark.read.parquet(f"{sf_dir}/hit.parquet").where("q_start >= 0 and q_end >= 0")
    spans = hits.select("query", F.least("q_start", "q_end").alias("s"), F.greatest("q_start", "q_end").alias("e"))
    found = covered_periods(spans, "query", "s", "e")
    return found.select("query", "kind", F.col("seg_start").cast("int"), F.col("seg_end").cast("int"))


QUERIES = {"p2_found": p2_found}

ORACLE_SQL = {
    "p2_found": """
        WITH spans AS (
            SELECT query, least(q_start, q_end) AS s, greatest(q_start, q_end) AS e FROM hit
            WHERE query IS NOT NULL AND q_start >= 0 AND q_end >= 0 AND q_start <> q_end),
        marked AS (
            SELECT *, max(e) OVER (PARTITION BY query ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
        numbered AS (
            SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
        periods AS (SELECT query, island, min(s) AS s, max(e) AS e FROM numbered GROUP BY query, island),
        nexts AS (SELECT *, lead(s) OVER (PARTITION BY query ORDER BY s) AS after FROM periods)
        SELECT query, 'period' AS kind, s AS seg_start, e AS seg_end FROM periods
        UNION ALL
        SELECT query, 'gap', e, after FROM nexts WHERE after IS NOT NULL
    """
}
