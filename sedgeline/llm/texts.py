"""The distinct texts of a table of records, stored so that they meet their ids again without another shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.workspace import new_path, parts_for, stored


class RecordTexts:
    """Canonical texts of records, one row per record, bucketed by id in the shared folder.

    ``texts()``: (text_id, letters, copies) of each distinct text; text_id is the smallest id of the records that have
    it, copies tells whether there are several. ``members()``: (record_id, text_id) of the records of texts with copies.

    Texts are compared as SHA-256 digests of their whole letters. Rows with the same id are deliveries of one record;
    where they differ the smallest text holds. Records with a null id, or without letters, are left out.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, canonical, least: int = 1) -> None:
        spark: SparkSession = df.sparkSession
        rows = df.select(F.col(id_col).alias("text_id"), canonical(F.col(text_col)).alias("letters")).where(F.col("text_id").isNotNull() & (F.length("letters") >= least))
        buckets = parts_for(df.select(id_col, text_col))
        # The one time that texts are shuffled: each task then writes the file of one bucket.
        records = rows.repartition(buckets, "text_id").groupBy("text_id").agg(F.min("letters").alias("letters"))
        records = records.withColumn("digest", _digest(F.col("letters")))
        name, path = f"record_texts_{uuid.uuid4().hex[:12]}", new_path(spark, "texts")
        records.write.bucketBy(buckets, "text_id").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
        # What was read knows its buckets; the catalog needn't keep the name, and leaves the files of such a table alone.
        self.records = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
        self._classes = stored(self.records.groupBy("digest").agg(F.min("text_id").alias("text_id"), F.max("text_id").alias("last_id")), "classes")

    def texts(self) -> DataFrame:
        classes = self._classes.select("text_id", (F.col("last_id") > F.col("text_id")).alias("copies"))
        return self.records.select("text_id", "letters").join(classes, "text_id")

    def members(self) -> DataFrame:
        copied = self._classes.where("last_id > text_id").select("digest", "text_id")
        return self.records.select(F.col("text_id").alias("record_id"), "digest").join(copied, "digest").select("record_id", "text_id")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
