"""Evaluation texts leaking into training text, by spaced-seed hashing.

Fixed masks over a window of word positions choose which words are compared; words at the ignored positions
may be substituted. The masked windows of both sides are hashed and joined; around each hit the aligned
words of the two texts are compared, whatever the masks ignored.

Every window of ``WINDOW`` equal words is hit by each of the masks, so a verbatim overlap of that many words
can't be missed. Overlaps with substitutions are found as far as some mask ignores all of the words that differ; the tests
measure how often for 1, 2 and 3 of them. Corpus windows first pass a bitmap of the evaluation side's hashes, which has a fixed size
whatever the tables' sizes; it lets all true hits through, and the join decides. From some
10^7 evaluation words on it is full and holds nothing back, which costs a larger join but no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a window.
WINDOW = 12
# The masks; 1 compares a word, 0 ignores it. All but the first and the last of the WINDOW positions are
# ignored by one mask at least, the ninth by two.
MASKS = ("111010010111", "110101101011", "101111110101")
#: Bits of the bitmap, as a power of 2: 1 MB on each side whatever the data.
_BITS = 23
#: Words of text on either side of a window that the comparison goes on through.
_AROUND = 12
_MEMO = 400_000

# All bytes but letters and digits part words; letters are lowered.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound. 0 is no word's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) or 1
        return h


def _hashed(texts: list[str | None], memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts after one another, and where each text begins and ends."""
    flat: list[int] = []
    bounds = [0]
    for text in texts:
        if text:
            flat.extend([memo[w] for w in text.encode().translate(_WORD_BYTES).split()])
        bounds.append(len(flat))
    return np.array(flat, np.uint64), np.array(bounds)


def _seeds(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each mask: its number, the windows' first words, and their hashes. Windows don't cross texts."""
    if len(words) < WINDOW:
        return
    lengths = np.diff(bounds)
    end_of = np.repeat(bounds[1:], lengths)
    at = np.arange(len(words) - WINDOW + 1)
    at = at[at + WINDOW <= end_of[: len(at)]]
    for m, mask in enumerate(MASKS):
        h = np.full(len(at), m + 1, np.uint64)
        for k in np.flatnonzero([c == "1" for c in mask]):
            h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield m, at, h


def _context(words: np.ndarray, bounds: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words around the windows at ``at``; 0 beyond the text."""
    place = at[:, None] + np.arange(-_AROUND, WINDOW + _AROUND)
    inside = (place >= bounds[owner][:, None]) & (place < bounds[owner + 1][:, None])
    return np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))


def _seed_rows(id_name: str, bitmap: bytes | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for whole in batches:
            for part in range(0, whole.num_rows, 500):
                batch = whole.slice(part, 500)
                words, bounds = _hashed(batch.column(1).to_pylist(), memo)
                for _, at, h in _seeds(words, bounds):
                    if bits is not None:
                        b = (h >> np.uint64(64 - _BITS)).astype(np.int64)
                        hit = (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
                        at, h = at[hit], h[hit]
                    if not len(at):
                        continue
                    owner = np.searchsorted(bounds, at, side="right") - 1
                    around = _context(words, bounds, owner, at)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * around.shape[1]), pa.array(around.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array((at - bounds[owner]).astype(np.int32)), flat], names=[id_name, "h", "at", "words"])

    return rows


def _schema(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind), T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))])


def _bitmap(seeds: DataFrame) -> bytes:
    """The seeds' bits: at most 2**_BITS / 64 rows reach the driver, whatever the number of seeds."""
    top = F.shiftrightunsigned("h", 64 - _BITS)
    rows = seeds.select((F.shiftright(top, 6)).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(1 << (_BITS - 6), np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out.tobytes()


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, doc_text: str = "text", item_text: str = "text") -> DataFrame:
    """Hits of evaluation items in documents: (doc_id, item_id, doc_at, item_at, equal, window_equal, run).

    One row for each aligned pair of word windows with a common seed. ``equal`` counts equal words of the window and
    the 12 words on either side, in alignment; ``window_equal`` those of the window; ``run`` is the longest run of
    equal consecutive words there. A verbatim overlap of WINDOW or more words has ``run >= WINDOW`` in some row; an
    overlap with substituted words shows as ``window_equal`` below WINDOW.

    Words are the longest runs of A-Z, a-z and 0-9, compared without case. Defined cases: null and empty texts, and
    texts of fewer than WINDOW words, have no hits; rows with null ids keep a null id; repeated rows and ties give
    their hits once; empty tables give no rows; further columns, whatever their names, are ignored.
    """
    d = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).cast("string").alias("t"))
    i = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t"))
    item_seeds = i.mapInArrow(_seed_rows("i", None), _schema("i", i.schema["i"].dataType)).distinct()
    bitmap = _bitmap(item_seeds)
    doc_seeds = d.mapInArrow(_seed_rows("d", bitmap), _schema("d", d.schema["d"].dataType))
    hits = doc_seeds.withColumnRenamed("at", "doc_at").withColumnRenamed("words", "doc_words").join(item_seeds.withColumnRenamed("at", "item_at").withColumnRenamed("words", "item_words"), "h")
    return hits.select(F.col("d").alias("doc_id"), F.col("i").alias("item_id"), "doc_at", "item_at", *_compared(F.col("doc_words"), F.col("item_words"))).distinct()


def _compared(a: Column, b: Column) -> list[Column]:
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x != 0)).cast("int"))
    window = F.aggregate(F.slice(same, _AROUND + 1, WINDOW), F.lit(0), lambda s, x: s + x)
    equal = F.aggregate(same, F.lit(0), lambda s, x: s + x)
    run = F.aggregate(same, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct(((s["now"] + 1) * x).alias("now"), F.greatest(s["most"], (s["now"] + 1) * x).alias("most")), lambda s: s["most"])
    return [equal.alias("equal"), window.alias("window_equal"), run.alias("run")]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, doc_text: str = "text", item_text: str = "text", least_window_equal: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, passages, longest_run) of each document with the items that it leaks.

    With the default, a document leaks an item if WINDOW consecutive words of the item occur consecutively in it; a
    smaller ``least_window_equal`` tolerates so many substitutions in a window as the masks ignore. Cases are defined
    as for ``leaked_passages``; hits whose document or item has no id are left out.
    """
    hits = leaked_passages(docs, items, doc_id, item_id, doc_text, item_text)
    kept = hits.where((F.col("window_equal") >= least_window_equal) & F.col("doc_id").isNotNull() & F.col("item_id").isNotNull())
    return kept.groupBy("doc_id", "item_id").agg(F.count_distinct("doc_at").alias("passages"), F.max("run").alias("longest_run"))
