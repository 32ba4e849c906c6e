"""Tokens of letter texts: minimizers, a sample of the m-mers that depends on nothing but the letters around.

In every window of ``w`` consecutive m-mers the one with the smallest hash is a token. Two texts that share a run of
``w + m - 1`` letters therefore share a token at the same place of the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a partition that are tokenized together, at least one text. Tokens that repeat within such a part are told apart there.
_PART_LETTERS = 1 << 23
_BASE = 0x9E3779B97F4A7C15


def flat_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes after one another, and where each begins and ends. The texts are ASCII."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m consecutive letters from each position on, built from those of halves; the last m-1 have none."""
    done: np.ndarray | None = None
    have, size = 0, 1
    half = mixed(data.astype(np.uint64) + np.uint64(1))
    while True:
        if m & size:
            if done is None:
                done, have = half, size
            else:  # ``half`` covers ``size`` letters, ``done`` the ``have`` ones after them
                n = min(len(half), len(done) - size)
                done = half[: max(n, 0)] * np.uint64(pow(_BASE, have, 1 << 64)) + done[size : size + max(n, 0)]
                have += size
        if size * 2 > m:
            break
        half = half[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + half[size:] if len(half) > size else half[:0]
        size *= 2
    return mixed(done) if done is not None else half[:0]


def sliding(values: np.ndarray, w: int, best: Callable) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each w consecutive values."""
    out, size = values, 1
    while size * 2 <= w:
        out = best(out[:-size], out[size:])
        size *= 2
    if size < w:
        out = best(out[: len(out) - (w - size)], out[w - size :])
    return out


def minimizers(data: np.ndarray, bounds: np.ndarray, m: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Token positions and their hashes."""
    span = w + m - 1
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.maximum(gram_hashes(data, m), np.uint64(1))
    lowest = sliding(h, w, np.minimum)
    across = (bounds[1:-1, None] - np.arange(1, span)).ravel()  # windows that would cross into the next text
    lowest[across[(across >= 0) & (across < len(lowest))]] = 0
    pad = np.zeros(w - 1, np.uint64)
    highest = sliding(np.concatenate([pad, lowest, pad]), w, np.maximum)
    at = np.flatnonzero(highest == h)
    return at, h[at]


def parts(batches: Iterator[pa.RecordBatch], letters_column: int) -> Iterator[pa.RecordBatch]:
    """The input in parts of about _PART_LETTERS letters."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            piece = batch.slice(at, 2000)
            waiting.append(piece)
            size += pc.sum(pc.binary_length(piece.column(letters_column))).as_py() or 0
            if size >= _PART_LETTERS:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        if table.num_rows:
            yield table.to_batches()[0]


def repeated_tokens(texts: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], extra: list[tuple[str, Callable]] = (), copies: bool = False) -> DataFrame:
    """(token, text_id, at, nth, times) of the tokens that stand in more than one of ``texts`` (text_id, letters).

    With ``copies``, a text whose column ``copies`` is true stands for several records, so that each of its tokens
    repeats; the column is kept.

    ``chosen(letters, bounds)`` gives positions and hashes; nth counts a text's tokens from 0. ``extra`` adds int columns
    whose values, one per token, are given by a function of (letters, bounds, positions, owners). ``times`` is how often
    the token occurs in all texts, on at least one row of each token, and 0 on rows that were spread.

    One shuffle on the token. A token that repeats within a part of the input is known to repeat without it: of these
    rows one a part goes to the token's place, to tell the others, and the rest are spread at random. So a token that
    stands in a third of all texts brings no more rows to its place than there are parts.
    """
    names, flags = [name for name, _ in extra], ["copies"] * copies

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            data, bounds = flat_letters(part.column(1))
            at, h = chosen(data, bounds)
            if not len(at):
                continue
            owner = np.searchsorted(bounds, at, side="right") - 1
            first = np.append(True, owner[1:] != owner[:-1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            order = np.argsort(h)
            sh, so = h[order], owner[order]
            new = np.append(True, sh[1:] != sh[:-1])
            run = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(sh)) - 1
            several = np.maximum.reduceat(so, starts) > np.minimum.reduceat(so, starts)
            known = np.empty(len(h), bool)
            known[order] = several[run]
            if copies:
                copied = part.column(2).to_numpy(zero_copy_only=False)[owner]
                known |= np.maximum.reduceat(copied[order], starts)[run][np.argsort(order)]
            lead = np.zeros(len(h), bool)
            lead[order[starts]] = True
            times = np.zeros(len(h), np.int64)
            times[order[starts]] = ends - starts + 1
            spread = mixed(h + (np.arange(len(h), dtype=np.uint64) + np.uint64(part.num_rows)) * np.uint64(_BASE))
            place = np.where(known & ~lead, spread, h)
            columns = [pa.array(place.view(np.int64)), pa.array(known), pa.array(h.view(np.int64)), part.column(0).take(pa.array(owner)), pa.array((at - bounds[owner]).astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(times)]
            columns += [pa.array(np.asarray(f(data, bounds, at, owner)).astype(np.int32)) for _, f in extra]
            columns += [pa.array(copied)] if copies else []
            # A known row's token is kept beside its place; other rows' place is the token.
            columns[2] = pa.array(h.view(np.int64), mask=~(known & ~lead))
            yield from pa.Table.from_arrays(columns, names=["place", "known", "token", "text_id", "at", "nth", "times", *names, *flags]).to_batches(max_chunksize=20_000)

    kind = texts.schema["text_id"].dataType
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("known", T.BooleanType()), T.StructField("token", T.LongType()), T.StructField("text_id", kind), T.StructField("at", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("times", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in names], *[T.StructField(n, T.BooleanType()) for n in flags]])
    spread = texts.select("text_id", "letters", *flags).mapInArrow(rows, schema)
    place = Window.partitionBy("place")
    told = spread.withColumn("repeats", F.max("known").over(place) | (F.min("text_id").over(place) < F.max("text_id").over(place)))
    told = told.withColumn("times", F.when(F.col("token").isNull(), F.sum("times").over(place)).otherwise(0))
    return told.where("repeats").select(F.coalesce("token", "place").alias("token"), "text_id", "at", "nth", "times", *names, *flags)
