"""Queries over the sequence records and search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm.copies import canonical_classes, formatting_duplicates
from sedgeline.llm.nearpairs import near_duplicates
from sedgeline.llm.spans import shared_share, shared_spans
from sedgeline.llm.topn import top_n_per_group


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that repeat the letters of a record with a smaller id."""
    entries = spark.read.parquet(f"{sf_dir}/fasta_entry.parquet")
    return formatting_duplicates(entries, "entry_id", "sequence").withColumnRenamed("record_id", "entry_id")


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct sequence once, with the records and the copies that it stands for."""
    entries = spark.read.parquet(f"{sf_dir}/fasta_entry.parquet")
    classes, _ = canonical_classes(entries, "entry_id", "sequence", "num_duplicates")
    return classes.select("keep_id", F.col("text").alias("letters"), "n_records", F.col("n_copies").alias("num_duplicates"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each record's letters in runs of 48 that other records have as well."""
    entries = spark.read.parquet(f"{sf_dir}/fasta_entry.parquet")
    return shared_spans(entries, "entry_id", "sequence", 48).withColumnRenamed("record_id", "entry_id")


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared elsewhere."""
    entries = spark.read.parquet(f"{sf_dir}/fasta_entry.parquet")
    spans = shared_spans(entries, "entry_id", "sequence", 48)
    return shared_share(spans, entries, "entry_id", "sequence").select(F.col("record_id").alias("entry_id"), "letters", F.col("shared_letters").cast("long"), "share")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best nodes of every query."""
    hits = spark.read.parquet(f"{sf_dir}/hit.parquet")
    return top_n_per_group(hits, "query", "node", "score", 5).select("query", "node")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose distinct 8-letter substrings agree to three fifths."""
    entries = spark.read.parquet(f"{sf_dir}/fasta_entry.parquet")
    return near_duplicates(entries, "entry_id", "sequence", 8, 0.6).select(F.col("record_a").alias("entry_a"), F.col("record_b").alias("entry_b"))


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p3_found": p3_found, "p3_share": p3_share, "p4_found": p4_found, "p5_found": p5_found}

_LETTERS = """
    records AS (
        SELECT entry_id, min(sequence) AS raw, max(coalesce(num_duplicates, 1)) AS copies,
               upper(regexp_replace(min(sequence), '[^A-Za-z]+', '', 'g')) AS letters
        FROM fasta_entry WHERE sequence IS NOT NULL GROUP BY entry_id),
    lettered AS (SELECT * FROM records WHERE letters <> '')
"""

_SHARED = _LETTERS + """,
    places AS (SELECT entry_id, letters, unnest(range(1, length(letters) - 46)) AS i FROM lettered WHERE length(letters) >= 48),
    runs AS (SELECT entry_id, i, substr(letters, i, 48) AS run FROM places),
    common AS (SELECT run FROM runs GROUP BY run HAVING min(entry_id) < max(entry_id)),
    hits AS (SELECT entry_id, i FROM runs SEMI JOIN common USING (run)),
    marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY entry_id ORDER BY i) <= 48 THEN 0 ELSE 1 END AS opens FROM hits),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY entry_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    spans AS (SELECT entry_id, min(i) - 1 AS span_start, max(i) + 47 AS span_end FROM numbered GROUP BY entry_id, island)
"""

ORACLE_SQL = {
    "p1_found": f"""
        WITH {_LETTERS}, kept AS (SELECT *, min(entry_id) OVER (PARTITION BY letters) AS keep_id FROM lettered)
        SELECT keep_id, entry_id FROM kept WHERE entry_id > keep_id
    """,
    "p1_collapsed": f"""
        WITH {_LETTERS}
        SELECT min(entry_id) AS keep_id, letters, count(*) AS n_records, CAST(sum(copies) AS BIGINT) AS num_duplicates
        FROM lettered GROUP BY letters
    """,
    "p3_found": f"""
        WITH {_SHARED} SELECT entry_id, CAST(span_start AS INT) AS span_start, CAST(span_end AS INT) AS span_end FROM spans
    """,
    "p3_share": f"""
        WITH {_SHARED}, sums AS (SELECT entry_id, sum(span_end - span_start) AS n FROM spans GROUP BY entry_id)
        SELECT entry_id, CAST(length(letters) AS INT) AS letters, CAST(coalesce(n, 0) AS BIGINT) AS shared_letters, coalesce(n, 0) / length(letters) AS share
        FROM lettered LEFT JOIN sums USING (entry_id)
    """,
    "p5_found": f"""
        WITH {_LETTERS},
        grams AS (SELECT DISTINCT entry_id, substr(letters, i, 8) AS gram FROM (SELECT entry_id, letters, unnest(range(1, length(letters) - 6)) AS i FROM lettered WHERE length(letters) >= 8)),
        sizes AS (SELECT entry_id, count(*) AS n FROM grams GROUP BY entry_id),
        common AS (SELECT a.entry_id AS a, b.entry_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.entry_id < b.entry_id GROUP BY a.entry_id, b.entry_id)
        SELECT a AS entry_a, b AS entry_b FROM common
        JOIN sizes x ON x.entry_id = a JOIN sizes y ON y.entry_id = b JOIN lettered p ON p.entry_id = a JOIN lettered q ON q.entry_id = b
        WHERE common.n / (x.n + y.n - common.n) >= 0.6 AND p.letters <> q.letters
    """,
    "p4_found": """
        WITH best AS (
            SELECT query, node, max(score) AS score FROM hit
            WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL GROUP BY query, node)
        SELECT query, node FROM best
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node COLLATE C) <= 5
    """,
}
