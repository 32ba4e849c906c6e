"""Union of intervals per key, and the gaps between, as a mergeable aggregate.

The aggregate's state is a sorted list of disjoint intervals per key. Partial states are made inside
each input partition, without a shuffle; they are then combined by linear merges in a reduction tree
whose fan-in is fixed, so that no task ever sees more than ``fan_in`` partial lists of a key. The last
level streams the sorted lists of a key and emits its periods and the complements between them.
A state travels as rows (key, cell, slot, start, end), so a key with very many periods is never one value, nor one
task's: its line is cut into cells that are merged by themselves, and what touches their borders is stitched at the end.
Before each merge a task's lists, each of which is sorted already, are put in order by Spark's sorter, whose Timsort
finds such runs and merges them; the merge itself is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.workspace import stored

#: Rows of a partition that are merged at once; a compaction follows whenever as many are waiting.
_CHUNK_ROWS = 1 << 19
#: Rows of a key, after the first merge, beyond which its line is split, and into how many cells at most.
_HOT_ROWS, _CELLS = 1 << 20, 256


def _islands(new_key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the islands of rows sorted by (key, start), and each island's end.

    Intervals that touch belong together.
    """
    segment = np.cumsum(new_key) - 1
    # A running maximum that restarts with each key: every key gets a range of its own, above the last one's.
    low = int(end.min())
    width = int(end.max()) - low + 1
    if width * (int(segment[-1]) + 1) < 1 << 62:
        reach = np.maximum.accumulate(end - low + segment * width) - segment * width + low
    else:
        cuts = np.flatnonzero(new_key)[1:]
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(end, cuts)])
    opens = new_key.copy()
    opens[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    return first, reach[last]


def _changes(keys: pa.Array) -> np.ndarray:
    """Whether each row's key differs from the row's before."""
    if pa.types.is_struct(keys.type):
        code, _ = _encoded(keys)
        return np.append(True, code[1:] != code[:-1])
    out = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        out[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return out


def _compact(table: pa.Table) -> pa.Table:
    """The disjoint union, per key, of the intervals of an unsorted table."""
    if not table.num_rows:
        return table
    code, values = _encoded(table.column(0).combine_chunks())
    start, end = (table.column(i).to_numpy() for i in (1, 2))
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    first, reach = _islands(np.append(True, code[1:] != code[:-1]), start, end)
    names = table.schema.names
    return pa.table([values.take(pa.array(code[first])).cast(table.schema.field(0).type), start[first], reach], names=names)


def _encoded(keys: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each key, and the keys by number."""
    if isinstance(keys, pa.ChunkedArray):
        keys = pa.concat_arrays(keys.chunks)
    if pa.types.is_struct(keys.type):
        parts = np.stack([_encoded(f)[0] for f in keys.flatten()], 1)
        _, first, code = np.unique(parts, axis=0, return_index=True, return_inverse=True)
        return code.ravel(), keys.take(pa.array(first))
    coded = keys.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []
    rows = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= _CHUNK_ROWS:
            merged = _compact(pa.concat_tables(waiting))
            if merged.num_rows > _CHUNK_ROWS // 2:  # hardly anything merges: hand on, keep nothing
                yield from merged.to_batches(max_chunksize=10_000)
                waiting, rows = [], 0
            else:
                waiting, rows = [merged], merged.num_rows
    if rows:
        yield from _compact(pa.concat_tables(waiting)).to_batches(max_chunksize=10_000)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Linear merge of input sorted by (key, start): keys, starts and ends of islands, and whether each is its key's first.

    Holds one batch and one open island.
    """
    held: pa.RecordBatch | None = None
    held_first = True
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)], names=["k", "s", "e"])
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held.cast(batch.schema), batch]).combine_chunks()
        keys = table.column(0).combine_chunks() if table.column(0).num_chunks != 1 else table.column(0).chunk(0)
        start, end = table.column(1).to_numpy(), table.column(2).to_numpy()
        new = _changes(keys)
        first, reach = _islands(new, start, end)
        leads = new[first]
        leads[0] = held_first
        if len(first) > 1:
            yield keys.take(pa.array(first[:-1])), start[first[:-1]], reach[:-1], leads[:-1]
        held_first = bool(leads[-1])
        held = pa.RecordBatch.from_arrays([keys.slice(int(first[-1]), 1), pa.array(start[first[-1:]]), pa.array(reach[-1:])], names=["k", "s", "e"])
    if held is not None:
        yield held.column(0), held.column(1).to_numpy(), held.column(2).to_numpy(), np.array([held_first])


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, start, end, _ in _stream(batches):
        yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(end)], names=["k", "s", "e"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Periods and the gaps between; ``edge`` tells a key's first and last period."""
    before = 0
    held: tuple | None = None  # the last period, of which isn't known yet whether its key goes on

    def rows(keys: pa.Array, start: np.ndarray, end: np.ndarray, leads: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        nonlocal before
        previous = np.append(before, end[:-1])
        before = int(end[-1])
        gap = np.flatnonzero(~leads)
        both = pa.concat_arrays([keys, keys.take(pa.array(gap))])
        kind = pa.array(["period"] * len(start) + ["gap"] * len(gap), pa.string())
        edge = pa.array(np.append(leads | ends, np.zeros(len(gap), bool)))
        return pa.RecordBatch.from_arrays([both, kind, pa.array(np.append(start, previous[gap])), pa.array(np.append(end, start[gap])), edge], names=["k", "kind", "s", "e", "edge"])

    for keys, start, end, leads in _stream(batches):
        if held is not None:
            keys, start, end, leads = pa.concat_arrays([held[0], keys]), np.append(held[1], start), np.append(held[2], end), np.append(held[3], leads)
        if len(start) > 1:
            yield rows(keys[:-1], start[:-1], end[:-1], leads[:-1], leads[1:])
        held = keys[-1:], start[-1:], end[-1:], leads[-1:]
    if held is not None:
        yield rows(*held, np.array([True]))


def _cells(partial: DataFrame) -> DataFrame:
    """(k, split, cell, slot, s, e): intervals with the part of their key's line that they lie in.

    A key with more than _HOT_ROWS rows is split at quantiles of its starts, and intervals are cut where they cross
    one; cells are merged independently, so that no key is ever one task's. Other keys have one cell.
    """
    hot = partial.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > _HOT_ROWS).select("k")
    fractions = [i / _CELLS for i in range(1, _CELLS)]
    borders = partial.join(hot, "k", "left_semi").groupBy("k").agg(F.array_sort(F.array_distinct(F.percentile_approx("s", fractions, 10 * _CELLS))).alias("borders"))
    placed = partial.join(borders, "k", "left")
    first = F.size(F.filter("borders", lambda b: b <= F.col("s")))
    last = F.size(F.filter("borders", lambda b: b < F.col("e")))
    spread = placed.withColumn("first", F.when(F.col("borders").isNull(), 0).otherwise(first)).withColumn("last", F.when(F.col("borders").isNull(), 0).otherwise(last))
    pieces = spread.withColumn("cell", F.explode(F.sequence("first", "last")))
    start = F.when(F.col("cell") == F.col("first"), F.col("s")).otherwise(F.expr("try_element_at(borders, cell)"))
    end = F.when(F.col("cell") == F.col("last"), F.col("e")).otherwise(F.expr("try_element_at(borders, cell + 1)"))
    return pieces.select("k", F.col("borders").isNotNull().alias("split"), "cell", "slot", start.alias("s"), end.alias("e"))


def covered_periods(df: DataFrame, key: str, start: str, end: str, fan_in: int = 8) -> DataFrame:
    """Periods covered by the intervals of each key, and the gaps between neighbouring periods.

    Returns (``key``, kind string, seg_start, seg_end) with the types of ``key`` and long coordinates; kind is
    'period' or 'gap'. Half-open intervals; those that touch are one period. Nothing is said about what lies
    before a key's first or after its last period.

    Defined cases: a row with a null key or a null coordinate, and a row whose end is not above its start,
    covers nothing; repeated rows and ties change nothing; an empty input gives no rows; further columns of
    ``df``, whatever their names, are ignored. The key may be of any type that can be grouped.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.where("k is not null and s is not null and e is not null and s < e")
    state = T.StructType([T.StructField("k", kind), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    slots = rows.rdd.getNumPartitions()
    partial = stored(rows.mapInArrow(_partial, state).withColumn("slot", F.spark_partition_id()), "intervals")
    place = T.StructType([T.StructField("k", kind), T.StructField("split", T.BooleanType()), T.StructField("cell", T.IntegerType()), T.StructField("slot", T.IntegerType())])
    ends = [T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]
    split = _any_split(partial)
    lists = _cells(partial) if split else partial.select("k", F.lit(False).alias("split"), F.lit(0).alias("cell"), "slot", "s", "e")
    while slots > fan_in:
        slots = -(-slots // fan_in)
        level = lists.withColumn("slot", F.pmod("slot", F.lit(slots))).repartition("k", "cell", "slot").sortWithinPartitions("k", "cell", "slot", "s")
        merged = level.select(F.struct("k", "split", "cell", "slot").alias("k"), "s", "e").mapInArrow(_merge_rows, T.StructType([T.StructField("k", place), *ends]))
        lists = merged.select("k.k", "k.split", "k.cell", "k.slot", "s", "e")
    final = lists.repartition("k", "cell").sortWithinPartitions("k", "cell", "s").select(F.struct("k", "split", "cell").alias("k"), "s", "e")
    out = T.StructType([T.StructField("k", T.StructType(place.fields[:3])), T.StructField("kind", T.StringType()), *ends, T.StructField("edge", T.BooleanType())])
    found = final.mapInArrow(_emit, out).select("k.k", "k.split", "k.cell", "kind", "s", "e", "edge")
    if split:
        found = stored(found, "periods")
        across = F.col("split") & F.col("edge")
        found = found.where(~across).select("k", "kind", "s", "e").unionByName(_stitched(found.where(across)))
    return found.select(F.col("k").alias(key), "kind", F.col("s").alias("seg_start"), F.col("e").alias("seg_end"))


def _any_split(partial: DataFrame) -> bool:
    """Whether any key has to be split. Without one there is nothing to cut or to stitch, and the result is the same either way."""
    if partial.count() <= _HOT_ROWS:  # told by the files' footers
        return False
    return not partial.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > _HOT_ROWS).isEmpty()


def _stitched(edges: DataFrame) -> DataFrame:
    """Periods that touch across the borders of cells are one, and gaps may lie across borders. Two rows a cell at most."""
    along = Window.partitionBy("k").orderBy("s")
    marked = edges.select("k", "cell", "s", "e", F.lag("e").over(along).alias("before"), F.lag("cell").over(along).alias("last_cell"))
    opens = F.col("before").isNull() | (F.col("s") > F.col("before"))
    gaps = marked.where((F.col("s") > F.col("before")) & (F.col("cell") != F.col("last_cell"))).select("k", F.lit("gap").alias("kind"), F.col("before").alias("s"), F.col("s").alias("e"))
    numbered = marked.withColumn("n", F.sum(opens.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    periods = numbered.groupBy("k", "n").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("k", F.lit("period").alias("kind"), "s", "e")
    return periods.unionByName(gaps)


def period_lists(periods: DataFrame, key: str) -> DataFrame:
    """One row per key with its sorted lists ``periods`` and ``gaps`` of (seg_start, seg_end), from ``covered_periods``.

    For keys whose lists fit a row; ``covered_periods`` itself has no such bound.
    """
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seg_start", "seg_end"))))
    return periods.groupBy(key).agg(pick("period").alias("periods"), pick("gap").alias("gaps"))
