"""Duplicates hidden by formatting differences.

Byte-identical raw texts are collapsed first, with their counts; only the distinct survivors are
canonicalised; these are grouped again on the full canonical text, and the counts are summed. Each
grouping has map-side partial aggregation, by hashes where its values allow and by sorting else, so a text that holds a third of all rows
reaches the shuffle as one row per task. Members of the groups are found by joining 32-byte SHA-256
digests, whose skewed keys adaptive execution can split; no list of members is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters(text: Column) -> Column:
    """Canonical form of a sequence: its A-Z and a-z in upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def canonical_classes(df: DataFrame, id_col: str, text_col: str, copies_col: str | None = None, canonical=letters) -> tuple[DataFrame, DataFrame]:
    """Classes of records with the same canonical text, and each record's class.

    Returns ``classes(keep_id, text, n_records, n_copies)``, one row per canonical text, and
    ``members(record_id, keep_id, n_records)``, one row per record. ``keep_id`` is a class's smallest record id;
    ``n_records`` counts records, ``n_copies`` sums their ``copies_col``.

    Defined cases: rows with the same id are deliveries of one record and count once (where they differ, the
    text with the smallest digest and the largest count hold); a null id, a null text and a text without canonical letters
    are in no class; a null or missing count is 1 and a zero stays 0; empty input gives empty results; further
    columns, whatever their names, are ignored.
    """
    copies = F.coalesce(F.col(copies_col).cast("long"), F.lit(1)) if copies_col else F.lit(1).cast("long")
    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("raw"), copies.alias("copies")).where("record_id is not null and raw is not null")
    # A record's deliveries meet as digests; the text itself isn't moved for that.
    records = rows.groupBy("record_id").agg(F.min(_digest(F.col("raw"))).alias("raw_digest"), F.max("copies").alias("copies"))
    # First pass: byte-identical texts. Only survivors are canonicalised.
    survivors = rows.groupBy("raw").agg(F.min("record_id").alias("first_id")).select(_digest(F.col("raw")).alias("raw_digest"), canonical(F.col("raw")).alias("text")).where("text <> ''")
    counts = records.groupBy("raw_digest").agg(F.count("*").alias("n"), F.sum("copies").alias("c"), F.min("record_id").alias("low"))
    # Second pass: the full canonical text, summing the counts of the first.
    counted = survivors.join(counts, "raw_digest")
    classes = counted.groupBy("text").agg(F.min("low").alias("keep_id"), F.sum("n").alias("n_records"), F.sum("c").alias("n_copies"))
    keys = classes.select(_digest(F.col("text")).alias("text_digest"), "keep_id", "n_records")
    texts = survivors.select("raw_digest", _digest(F.col("text")).alias("text_digest"))
    members = records.select("record_id", "raw_digest").join(texts, "raw_digest").join(keys, "text_digest").select("record_id", "keep_id", "n_records")
    return classes.select("keep_id", "text", "n_records", "n_copies"), members


def formatting_duplicates(df: DataFrame, id_col: str, text_col: str, canonical=letters) -> DataFrame:
    """(keep_id, record_id) of each record whose canonical text a record with a smaller id also has.

    Cases are defined as for ``canonical_classes``.
    """
    _, members = canonical_classes(df, id_col, text_col, canonical=canonical)
    return members.where("n_records > 1 and record_id > keep_id").select("keep_id", "record_id")
