"""Long exact spans shared between records, by compaction of a de Bruijn graph.

The graph's nodes are the tokens (see ``tokens``) that stand in more than one text, its edges the k-mers of two
consecutive tokens with their distance. Joins give every occurrence of a node its in- and out-degree; a text's first
and last tokens, and those beside tokens that don't repeat, count as having a neighbour of their own, so that paths end
there. Nonbranching paths are compacted: all occurrences of a path run through the whole of it, one row for each.

The letters of each occurrence, and those around as far as a span may reach, are then fetched from the source texts by
their coordinates, and the windows of the span's length are compared that stand at the same place of the same path. Their letters
are compared by 64-bit hashes; as they meet only others at their own place, not all of the collection, two windows that
differ are taken for equal with a probability of occurrences squared over 2**64. A window has its lowest token in common with
any other text that holds it, so none is missed. Long paths are compared in blocks, and blocks with very many letters by an
aggregate over windows instead of in one place.

Records with equal texts are one text in the graph, with a mark that makes every token and window of it a repeated one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.llm.copies import letters
from sedgeline.llm.texts import RecordTexts
from sedgeline.llm.tokens import flat_letters, gram_hashes, minimizers, mixed, repeated_tokens
from sedgeline.operators.intervals import covered_periods
from sedgeline.workspace import stored

#: Letters of a token.
_TOKEN = 16
#: Letters of a block: long paths are compared in blocks, by place.
_BLOCK = 1 << 16
#: Letters of one block of a path, in all its occurrences, that are compared in one place; more are compared by an aggregate.
_HOT_LETTERS = 1 << 23
#: Letters that are compared at once, and the last block's.
_CHUNK_LETTERS = 1 << 22


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = 48, canonical=letters) -> DataFrame:
    """(record_id, span_start, span_end): each record's longest stretches of letters in runs shared with other records.

    A letter is shared if it lies in some run of ``length`` consecutive letters of its record that also occurs in another
    record. Positions count the canonical letters from 0, end exclusive.

    Defined cases: rows with the same id are deliveries of one record; rows with a null id, null and empty texts, and
    texts of fewer than ``length`` letters have no spans; a run that recurs only within its own record isn't shared;
    a record whose text other records have as well is shared as a whole; empty input gives no rows; further columns,
    whatever their names, are ignored. ``length`` must be at least 2.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    token = max(1, min(_TOKEN, length // 2))
    window = length - token + 1
    records = RecordTexts(df, id_col, text_col, canonical, least=length)
    tokens = repeated_tokens(records.texts(), lambda data, bounds: minimizers(data, bounds, token, window), copies=True)
    paths = stored(_paths(stored(tokens.drop("times"), "tokens"), token), "paths")
    blocks = _blocks(paths, length - token, length)
    many = blocks.groupBy("path", "block").agg(F.sum(F.col("end") - F.col("at")).alias("n")).where(F.col("n") > _HOT_LETTERS).select("path", "block")
    many = stored(many, "many")
    kind = df.schema[id_col].dataType
    if many.isEmpty():
        runs = _compared(_with_letters(records.records, blocks), length, kind)
    else:
        cold, hot = (_with_letters(records.records, blocks.join(many, ["path", "block"], how)) for how in ("left_anti", "left_semi"))
        runs = _compared(cold, length, kind).unionByName(_compared_hot(hot, length, kind))
    found = covered_periods(runs, "text_id", "s", "e").where("kind = 'period'").select("text_id", "seg_start", "seg_end")
    # A text's stretches are those of each record that has it.
    found = stored(found, "spans")
    others = records.members().where("record_id <> text_id").join(found, "text_id").select("record_id", "seg_start", "seg_end")
    each = found.withColumnRenamed("text_id", "record_id").unionByName(others)
    return each.select("record_id", F.col("seg_start").cast("int").alias("span_start"), F.col("seg_end").cast("int").alias("span_end"))


def shared_share(spans: DataFrame, df: DataFrame, id_col: str, text_col: str, canonical=letters) -> DataFrame:
    """(record_id, letters, shared_letters, share) of each record that has letters, from its ``shared_spans``."""
    sizes = df.select(F.col(id_col).alias("record_id"), F.length(canonical(F.col(text_col))).alias("letters")).where("record_id is not null and letters > 0").groupBy("record_id").agg(F.min("letters").alias("letters"))
    sums = spans.groupBy("record_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_letters"))
    both = sizes.join(sums, "record_id", "left").withColumn("shared_letters", F.coalesce("shared_letters", F.lit(0)))
    return both.withColumn("share", F.col("shared_letters") / F.col("letters"))


def _paths(tokens: DataFrame, token: int) -> DataFrame:
    """Occurrences (path, text_id, s, e, copies) of the nonbranching paths of repeated tokens, in letters of the text."""
    along = Window.partitionBy("text_id").orderBy("nth")
    neighbour = lambda f, step: F.when(f("nth").over(along) == F.col("nth") + step, F.xxhash64(f("token").over(along), F.abs(f("at").over(along) - F.col("at"))))
    # An absent neighbour (an end of the text, or a token that doesn't repeat) is one of its own: 0.
    seen = tokens.withColumn("after", F.coalesce(neighbour(F.lead, 1), F.lit(0))).withColumn("before", F.coalesce(neighbour(F.lag, -1), F.lit(0)))
    degrees = seen.groupBy("token").agg(F.min("after").alias("a1"), F.max("after").alias("a2"), F.min("before").alias("b1"), F.max("before").alias("b2"))
    single = degrees.select("token", ((F.col("a1") == F.col("a2")) & (F.col("a1") != 0)).alias("one_after"), ((F.col("b1") == F.col("b2")) & (F.col("b1") != 0)).alias("one_before"))
    marked = tokens.join(single, "token")
    goes_on = F.coalesce(F.lag("one_after").over(along) & F.col("one_before") & (F.lag("nth").over(along) == F.col("nth") - 1), F.lit(False))
    run = F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("starts", ~goes_on).withColumn("run", run)
    return runs.groupBy("text_id", "run").agg(F.max(F.when(F.col("starts"), F.col("token"))).alias("path"), F.min("at").alias("s"), (F.max("at") + token).alias("e"), F.max("copies").alias("copies")).select("path", "text_id", "s", "e", "copies")


def _blocks(paths: DataFrame, around: int, length: int) -> DataFrame:
    """The occurrences, with ``around`` letters on either side, in blocks of windows: (path, block, text_id, copies, at, end, lead).

    ``lead`` is the number of letters from ``at`` to the path's first one (negative behind it); blocks are counted from there, so that
    all windows at the same place of a path lie in the same block, however long the path is.
    """
    begin = F.greatest(F.col("s") - around, F.lit(0))
    block_of = lambda place: F.floor((place - F.col("s")) / _BLOCK)
    each = paths.select("path", "text_id", "copies", "s", begin.alias("begin"), (F.col("e") + around).alias("stop"))
    each = each.withColumn("block", F.explode(F.sequence(block_of(F.col("begin")), block_of(F.greatest(F.col("stop") - length, F.col("begin"))))))
    at = F.greatest("begin", F.col("s") + F.col("block") * _BLOCK)
    end = F.least("stop", F.col("s") + (F.col("block") + 1) * _BLOCK + length - 1)
    return each.select("path", "block", "text_id", "copies", at.cast("int").alias("at"), end.cast("int").alias("end"), (F.col("s") - at).cast("int").alias("lead"))


def _with_letters(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks with their letters from the source texts; a text may end before the block does."""
    joined = blocks.join(texts.select("text_id", F.col("letters").cast("binary").alias("letters")), "text_id")
    return joined.select("path", "block", "text_id", "at", "lead", F.substring("letters", F.col("at") + 1, F.col("end") - F.col("at")).alias("part"), "copies")


def _windows(lead: np.ndarray, parts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letters of all windows of the parts, each window's place in its path, its part, and its first letter in the part."""
    data, bounds = flat_letters(parts)
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(parts)), np.diff(bounds))[: len(data) - length + 1]
    first = np.arange(len(owner))
    inside = first + length <= bounds[owner + 1]
    h, owner, first = gram_hashes(data, length)[inside], owner[inside], first[inside]
    first = first - bounds[owner]
    return h, first - lead[owner], owner, first


def _runs(owner: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows (sorted by part and place) as stretches: part, start, end."""
    new = np.append(True, (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)) if len(owner) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(owner)) - 1 if len(starts) else starts
    return owner[starts], first[starts], first[ends] + length


def _compared(placed: DataFrame, length: int, kind: T.DataType) -> DataFrame:
    """(text_id, s, e): stretches of windows that occurrences of a path in other texts have at the same place."""
    rows = placed.repartition("path", "block").sortWithinPartitions("path", "block")

    def chunk(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        path = table.column("path").to_numpy().view(np.uint64)
        h, place, owner, first = _windows(table.column("lead").to_numpy(), table.column("part").combine_chunks(), length)
        if not len(h):
            return None
        text = table.column("text_id").combine_chunks().dictionary_encode().indices.to_numpy()[owner]
        copied = table.column("copies").to_numpy()[owner]
        # Windows at one place of one path, in order of their letters' hash.
        where = mixed(path[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(mixed(h + where), kind="stable")
        k, p, t = h[order], where[order], text[order]
        starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
        several = (np.maximum.reduceat(t, starts) > np.minimum.reduceat(t, starts)) | np.maximum.reduceat(copied[order], starts)
        shared = np.empty(len(k), bool)
        shared[order] = np.repeat(several, np.diff(np.append(starts, len(k))))
        part, s, e = _runs(owner[shared], first[shared], length)
        at = table.column("at").to_numpy()[part]
        return pa.RecordBatch.from_arrays([table.column("text_id").combine_chunks().take(pa.array(part)), pa.array((s + at).astype(np.int32)), pa.array((e + at).astype(np.int32))], names=["text_id", "s", "e"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            size += batch.column(5).nbytes
            if size < _CHUNK_LETTERS:
                continue
            table = pa.concat_tables(waiting).combine_chunks()
            path, block = table.column("path").to_numpy(), table.column("block").to_numpy()
            cut = int(np.argmax((path == path[-1]) & (block == block[-1])))  # the last block may go on, by no more than _HOT_LETTERS
            if cut and (out := chunk(table.slice(0, cut))) is not None:
                yield out
            waiting = [table.slice(cut)]
            size = waiting[0].column("part").nbytes
        if waiting and (out := chunk(pa.concat_tables(waiting))) is not None:
            yield out

    return rows.mapInArrow(compare, T.StructType([T.StructField("text_id", kind), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def _compared_hot(placed: DataFrame, length: int, kind: T.DataType) -> DataFrame:
    """As ``_compared`` for blocks with very many letters: windows meet in an aggregate, wherever they come from."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                h, place, owner, first = _windows(rows.column(4).to_numpy(), rows.column(5), length)
                if len(h):
                    take = pa.array(owner)
                    at = rows.column(3).to_numpy()[owner]
                    yield from pa.Table.from_arrays([rows.column(0).take(take), pa.array(place), pa.array(h.view(np.int64)), rows.column(2).take(take), pa.array((first + at).astype(np.int32)), rows.column(6).take(take)], names=["path", "place", "key", "text_id", "s", "copies"]).to_batches(max_chunksize=20_000)

    schema = T.StructType([T.StructField("path", T.LongType()), T.StructField("place", T.LongType()), T.StructField("key", T.LongType()), T.StructField("text_id", kind), T.StructField("s", T.IntegerType()), T.StructField("copies", T.BooleanType())])
    each = placed.mapInArrow(windows, schema)
    window = ["path", "place", "key"]
    shared = each.groupBy(*window).agg(F.min("text_id").alias("low"), F.max("text_id").alias("high"), F.max("copies").alias("c")).where("low < high or c").select(*window)
    return each.join(shared, window, "left_semi").select("text_id", "s", (F.col("s") + length).cast("int").alias("e"))
