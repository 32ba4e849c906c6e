"""Top N items within every group, by statistics-guided skipping.

Rows are clustered by group into sorted Parquet files: a range partitioning on (group, score) that samples
the data, so that a group of any size is spread over as many files as it needs, each holding one range of
its scores. The scan of a file takes its row groups in descending order of their maximum score, keeps the
best N items so far of every group that goes on, and skips a row group whose maximum lies strictly below the
current N-th score of every group that it contains. Only row-group statistics are read to decide. A row group with
more than one group holds one that is met there for the first time, so it is read. What remains, N items a group and
file at most, is merged by an ordinary aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.workspace import new_path, parts_for


def cluster_by_group(df: DataFrame, group: str, item: str, score: str, row_group_bytes: int = 1 << 18, files: int | None = None) -> DataFrame:
    """``df``'s non-null (group, item, score) as a table of files sorted by group and descending score, in the shared folder."""
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    path = new_path(spark, "topn")
    n = files or parts_for(df.select(group, item, score))
    spread = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    spread.write.option("compression", "zstd").option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(min(row_group_bytes, 1 << 20))).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _best(table: pa.Table, n: int) -> pa.Table:
    """The n best distinct items of each group of a table sorted by group, descending score and item."""
    if not table.num_rows:
        return table
    table = table.combine_chunks()
    g = table.column("g").combine_chunks()
    new = np.append(True, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False))
    item = table.column("i").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first = np.unique((np.cumsum(new) << 32) | item, return_index=True)  # an item's first row has its highest score
    first.sort()
    at = np.arange(len(first))
    group = np.cumsum(new)[first]
    opens = np.append(True, group[1:] != group[:-1])
    return table.take(pa.array(first[at - np.maximum.accumulate(np.where(opens, at, 0)) < n]))


def scan_file(handle: pq.ParquetFile, n: int, seen: list[int] | None = None) -> Iterator[pa.Table]:
    """The n best items of each group of one clustered file; ``seen`` takes the numbers of the row groups that were read.

    A group that lies within one row group is final once that is read. Only those that go on from one row group to
    the next, two at most of each, are kept: n items of each, with the n-th score that later row groups must reach.
    """
    meta = handle.metadata
    columns = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
    stats = []
    for r in range(meta.num_row_groups):
        of = {name: meta.row_group(r).column(c).statistics for name, c in columns.items()}
        known = all(of[c] is not None and of[c].has_min_max for c in "gs")
        stats.append((of["g"].min, of["g"].max, of["s"].max) if known else None)
    order = sorted(range(len(stats)), key=lambda r: (stats[r] is not None, -stats[r][2] if stats[r] else 0))
    kept: dict = {}
    nth: dict = {}
    for r in order:
        x = stats[r]
        if x is not None and x[0] == x[1] and x[0] in nth and x[2] < nth[x[0]]:
            continue
        table = handle.read_row_group(r, columns=["g", "i", "s"])
        if seen is not None:
            seen.append(r)
        best = _best(table, n)
        g = best.column("g").combine_chunks()
        # The first and the last group may stand in the row groups beside this one as well.
        edges = [e for e, beside in ((g[0], r - 1), (g[-1], r + 1)) if len(g) and 0 <= beside < len(stats)]
        inner = pa.array(np.ones(len(g), bool))
        for e in {v.as_py(): v for v in edges}.values():
            own = pc.equal(g, e)
            inner = pc.and_not(inner, own)
            key, part = e.as_py(), best.filter(own)
            if key in kept:
                part = _best(pa.concat_tables([kept[key], part]).sort_by([("s", "descending"), ("i", "ascending")]), n)
            kept[key] = part
            if part.num_rows == n:
                nth[key] = part.column("s")[n - 1].as_py()
        yield best.filter(inner)
    if kept:
        yield pa.concat_tables(kept.values())


def _open(path: str) -> pq.ParquetFile:
    if urlparse(path).scheme:
        fs, path = pafs.FileSystem.from_uri(path)
        return pq.ParquetFile(fs.open_input_file(path))
    return pq.ParquetFile(path)


def top_n_of_clustered(clustered: DataFrame, n: int) -> DataFrame:
    """(g, i, s, rank) of the n best items of each group of a table written by ``cluster_by_group``."""
    spark = clustered.sparkSession
    paths = clustered.inputFiles()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for best in scan_file(_open(path), n):
                    yield from best.to_batches(max_chunksize=10_000)

    if paths:
        listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
        kept = listed.mapInArrow(scan, clustered.schema)
    else:
        kept = clustered
    # A group's items may lie in several files, and an item of one score range in another.
    merged = kept.groupBy("g", "i").agg(F.max("s").alias("s"))
    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, row_group_bytes: int = 1 << 18) -> DataFrame:
    """The ``n`` best items of every group: columns ``group``, ``item``, ``score`` and rank.

    An item's score in a group is its highest one. Equal scores come in ascending order of the item (strings
    by their bytes), so the result is always the same.

    Defined cases: rows with a null group, item or score, or a score that is no number, don't take part;
    repeated rows count once; a group of fewer than n items gives them all; empty input gives no rows; ``n``
    below 1 is an error; further columns, whatever their names, are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    found = top_n_of_clustered(cluster_by_group(df, group, item, score, row_group_bytes), n)
    return found.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def skipping(clustered: DataFrame, n: int) -> DataFrame:
    """How many row groups of each file the scan reads, of how many: (path, read, row_groups)."""
    spark = clustered.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                handle, seen = _open(path), []
                for _ in scan_file(handle, n, seen):
                    pass
                yield pa.RecordBatch.from_pydict({"path": [path], "read": pa.array([len(seen)], pa.int32()), "row_groups": pa.array([handle.metadata.num_row_groups], pa.int32())})

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("read", T.IntegerType()), T.StructField("row_groups", T.IntegerType())])
    return spark.createDataFrame([(p,) for p in clustered.inputFiles()], "path string").mapInArrow(count, schema)
