"""The sequence tables as the queries use them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.functions.sequence import letters_only


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of fasta_entry, however often it was delivered, with its letters; those without letters are left out."""
    rows = spark.read.parquet(f"{sf_dir}/fasta_entry.parquet").where("sequence is not null")
    # The smallest delivery as a whole, so that no record is made of parts of several.
    firsts = ["sequence", "run", "pos", "name", "comment", "quality", "tid", "num_duplicates"]
    one = rows.groupBy("entry_id").agg(F.min(F.struct(*firsts)).alias("r")).select("entry_id", *[F.col(f"r.{c}").alias(c) for c in firsts])
    return one.withColumn("seq", letters_only(F.col("sequence"))).where("seq <> ''")


RECORDS = """
    rec AS (
        SELECT * FROM (
            SELECT entry_id, min(run) AS run, min(pos) AS pos, min(name) AS name, min(comment) AS comment, min(sequence) AS sequence, min(quality) AS quality,
                   min(tid) AS tid, min(num_duplicates) AS num_duplicates, upper(regexp_replace(min(sequence), '[^A-Za-z]', '', 'g')) AS seq
            FROM fasta_entry WHERE sequence IS NOT NULL GROUP BY entry_id)
        WHERE seq <> '')
"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_entry with its letters."""
    return spark.read.parquet(f"{sf_dir}/ref_entry.parquet").withColumn("seq", letters_only(F.col("sequence")))


REFERENCES = """ref AS (SELECT *, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS seq FROM ref_entry)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/tree_node.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hit, however often it was delivered."""
    rows = spark.read.parquet(f"{sf_dir}/hit.parquet")
    return rows.drop("arrived_at").dropDuplicates(["hit_id"])


HITS = """h AS (SELECT DISTINCT * EXCLUDE (arrived_at) FROM hit)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/anchor.parquet")
