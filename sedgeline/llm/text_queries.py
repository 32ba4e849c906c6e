"""Queries over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedgeline.llm.leaks import leaked_items
from sedgeline.llm.prefix_bpe import encode_corpus
from sedgeline.llm.spam import list_pages

#: Where the public vocabularies lie; a parameter of the operator.
TOKENIZERS = "/opt/tokenizers"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_corpus(docs, "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", keep=["doc_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items of which they hold 12 consecutive words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/eval_item.parquet")
    return leaked_items(docs, items, "doc_id", "item_id").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that for the larger part of their words are keywords, links, tags or entries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/page_label.parquet")
    return list_pages(docs, labels).select("doc_id")


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

ORACLE_SQL = {
    "p7_found": """
        WITH doc_words AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
        item_words AS (SELECT DISTINCT item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM eval_item WHERE text IS NOT NULL),
        doc_at AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words WHERE len(w) >= 12),
        item_at AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words WHERE len(w) >= 12),
        doc_grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM doc_at),
        item_grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS gram FROM item_at)
        SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (gram)
    """,
}
