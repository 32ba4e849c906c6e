"""Near-duplicate records, by a token-group matrix.

Similar texts are put into groups: texts with the same lowest repeated token. The matrix is kept inverted, as rows
(token, group), its tokens being minimizers (see ``tokens``); it tells which groups a query text may have partners in.
Beside it each group has the union of its texts' letter grams, as a bitmap of fixed size. A query's grams whose bits the
union lacks can't be in any member, which bounds what the two may have in common; groups that the bound rules out are never
opened. Letters are fetched for opened groups only, and their members are compared exactly with the queries.

The bound loses nothing. The matrix presumes that two texts whose grams agree to the threshold have a token in common,
which is certain where they share a run of ``RUN`` letters (``SHORT_RUN`` for texts of fewer than ``SHORT`` grams, any gram
for tiny ones), and likely where they share many shorter ones. Edits spread as evenly as can be leave such runs
at a similarity of 0.6; the tests measure the recall for edits, for reordered blocks and with hot tokens.
No token is dropped, however many texts it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.llm.copies import letters
from sedgeline.llm.texts import RecordTexts
from sedgeline.llm.tokens import flat_letters, gram_hashes, minimizers, parts, repeated_tokens
from sedgeline.workspace import stored

#: Letters of a token.
_TOKEN = 14
#: Common letters with which two texts are sure to have a common token; for texts of fewer than SHORT grams SHORT_RUN are enough.
RUN, SHORT_RUN, SHORT = 28, 21, 128
#: Texts of at most so many distinct grams also have all of these as tokens.
_TINY = 40
#: Texts of a group; larger groups are split, each part with a union of its own.
_GROUP = 64
#: Words of 64 bits of a union. It bounds texts of up to some thousand grams; groups of longer ones are opened without it.
_WORDS = 16
#: Texts of a token that meet its groups in one place; the texts of hot tokens, which have more, are spread. None is dropped.
_HOT = 2000
#: Rows of 16 bytes that may be broadcast.
_SMALL = 500_000
#: Queries of one group that are compared in one place; more are spread.
_QUERIES = 5000
#: Grams that are compared at once, at least one pair of texts.
_CHUNK = 1 << 22
_CODE_BITS = np.uint64(40)


def _codes(data: np.ndarray, gram: int) -> np.ndarray:
    """Numbers below 2**40 of the grams from each position on: one to one for grams of up to 8 letters A-Z, else hashes."""
    if gram > 8 or (len(data) and (data.min() < 65 or data.max() > 90)):
        return gram_hashes(data, gram) >> np.uint64(24)
    n = max(len(data) - gram + 1, 0)
    five = (data - np.uint8(64)).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = (out << np.uint64(5)) | five[k : k + n]
    return out


def _inside(bounds: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that don't cross into the next text, and their texts."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)[:n]
    at = np.flatnonzero(np.arange(n) + gram <= bounds[1:][owner]) if n else np.zeros(0, np.int64)
    return at, owner[at]


def distinct_grams(data: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams as numbers (text << 40) | code in ascending order, and how many each text has."""
    code = _codes(data, gram)
    at, owner = _inside(bounds, len(code), gram)
    keys = np.sort((owner.astype(np.uint64) << _CODE_BITS) | code[at])
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys, np.bincount((keys >> _CODE_BITS).astype(np.int64), minlength=len(bounds) - 1)


class _Tokens:
    """Chooses a part's tokens, each once a text, and counts its texts' distinct grams."""

    def __init__(self, gram: int) -> None:
        self.gram = gram
        self.counts = np.zeros(0, np.int64)

    def chosen(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(bounds)
        _, self.counts = distinct_grams(data, bounds, self.gram)
        short = self.counts < SHORT
        places, hashes = [], []
        for some, run in ((~short, RUN), (short, SHORT_RUN)):
            # The texts of one kind after one another, and where their letters stand among all.
            place = np.flatnonzero(np.repeat(some, size))
            at, h = minimizers(data[place], np.append(0, np.cumsum(size[some])), _TOKEN, run - _TOKEN + 1)
            places.append(place[at])
            hashes.append(h)
        tiny = self.counts <= _TINY
        place = np.flatnonzero(np.repeat(tiny, size))
        some_bounds = np.append(0, np.cumsum(size[tiny]))
        h = gram_hashes(data[place], self.gram)
        at, _ = _inside(some_bounds, len(h), self.gram)
        places.append(place[at])
        hashes.append(h[at] ^ np.uint64(0x5851F42D4C957F2D))
        place, h = np.concatenate(places), np.concatenate(hashes)
        owner = np.searchsorted(bounds, place, side="right") - 1
        # A text has each token once; two of its tokens hardly ever agree in 40 bits, and one of them would be left.
        _, once = np.unique((owner.astype(np.uint64) << _CODE_BITS) | (h >> np.uint64(24)), return_index=True)
        once = once[np.argsort(place[once], kind="stable")]
        return place[once], h[once]

    def grams(self, data: np.ndarray, bounds: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.counts[owner]


_BITMAP = [f"b{i}" for i in range(_WORDS)]


def _bitmaps(texts: DataFrame, gram: int) -> DataFrame:
    """``texts`` (text_id, letters, group) with the bitmap of their grams instead of the letters: (text_id, group, grams, b0, b1, ...)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts(batches, 1):
            for start in range(0, whole.num_rows, 2000):
                part = whole.slice(start, 2000)
                keys, counts = distinct_grams(*flat_letters(part.column(1)), gram)
                bits = np.zeros((part.num_rows, 64 * _WORDS), bool)
                code = (keys & np.uint64((1 << 40) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                bits[(keys >> _CODE_BITS).astype(np.int64), (code >> np.uint64(32)).astype(np.int64) % bits.shape[1]] = True
                words = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts.astype(np.int32)), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(_WORDS)]], names=["text_id", "group", "grams", *_BITMAP])

    schema = T.StructType([texts.schema["text_id"], T.StructField("group", T.LongType()), T.StructField("grams", T.IntegerType()), *[T.StructField(b, T.LongType()) for b in _BITMAP]])
    return texts.select("text_id", "letters", "group").mapInArrow(rows, schema)


def _may_hold(threshold: float) -> Column:
    """Whether a member of the group (least, most, u0, u1, ...) may agree to the threshold with the query (grams, b0, b1, ...).

    Every bit of the query that the union lacks is a gram, at least, that no member has.
    """
    lacking = sum((F.bit_count(F.col(b).bitwiseAND(F.bitwise_not(f"u{i}"))) for i, b in enumerate(_BITMAP)), F.lit(0))
    return (F.col("grams") - lacking >= threshold * F.greatest("grams", "least")) & (F.col("most") >= threshold * F.col("grams"))


def similar_texts(df: DataFrame, id_col: str, text_col: str, gram: int = 8, threshold: float = 0.6, canonical=letters) -> tuple[DataFrame, RecordTexts]:
    """(text_a, text_b, common, either) of the pairs of different texts whose distinct grams agree to ``threshold``.

    ``common`` counts the grams in both, ``either`` those in one or both. A text's id is the smallest id of its records;
    ``text_a < text_b``. The second result leads from texts to their records.
    """
    records = RecordTexts(df, id_col, text_col, canonical, least=gram)
    chooser = _Tokens(gram)
    tokens = repeated_tokens(records.texts(), chooser.chosen, [("grams", chooser.grams)])
    # Similar texts have their lowest token in common with a probability that is their similarity.
    near = stored(tokens.select("token", "text_id", "grams", "times", F.min("token").over(Window.partitionBy("text_id")).alias("lowest")), "near")
    heads = near.where("token = lowest").select("text_id", "lowest")
    crowds = stored(heads.groupBy("lowest").agg(F.count("*").alias("n")).where(F.col("n") > _GROUP), "crowds")
    if crowds.count() <= _SMALL:  # told by the files' footers; larger ones are joined like any table
        crowds = F.broadcast(crowds)
    group = F.xxhash64("lowest", F.pmod(F.xxhash64("text_id"), F.ceil(F.coalesce("n", F.lit(1)) / _GROUP)))
    groups = heads.join(crowds, "lowest", "left").select("text_id", group.alias("group"))
    bitmaps = stored(_bitmaps(records.records.select("text_id", "letters").join(groups, "text_id"), gram), "bitmaps")
    unions = bitmaps.groupBy("group").agg(F.count("*").alias("texts"), F.min("grams").alias("least"), F.max("grams").alias("most"), *[F.bit_or(b).alias(f"u{i}") for i, b in enumerate(_BITMAP)])
    grouped = near.join(crowds, "lowest", "left").select("token", "text_id", "grams", group.alias("group"))
    hot = near.where(F.col("times") > _HOT).groupBy("token").agg(F.ceil(F.max("times") / _HOT).cast("int").alias("places"))
    if hot.isEmpty():
        met = _met(grouped, threshold)
    else:
        marked = stored(grouped.join(hot, "token", "left"), "grouped")
        met = _met(marked.where("places is null"), threshold).unionByName(_met_hot(marked.where("places is not null"), bitmaps, unions, threshold))
    queries = bitmaps.drop("group").withColumnRenamed("text_id", "query")
    open_ = stored(met.distinct().join(unions, "group").join(queries, "query").where(_may_hold(threshold)).select("query", "group"), "open")
    inner = unions.where("texts > 1").select("group")
    return _compared(records.records, open_, inner, bitmaps.select("text_id", "group"), gram, threshold, df.schema[id_col].dataType), records


def _met(grouped: DataFrame, threshold: float) -> DataFrame:
    """(query, group) of the texts and the other groups with which they have a token in common.

    Each pair of texts is met once: by the text whose group has the smaller number. No token here stands in more than
    _HOT texts, so that one shuffle by the token serves both sides of the join without a skewed place.
    """
    placed = grouped.repartition("token")
    matrix = placed.groupBy("token", "group").agg(F.min("grams").alias("least"), F.max("grams").alias("most"))
    query = placed.select("token", F.col("text_id").alias("query"), F.col("group").alias("own"), F.col("grams").alias("q"))
    return query.join(matrix, "token").where((F.col("own") < F.col("group")) & _sizes_fit(threshold)).select("query", "group")


def _sizes_fit(threshold: float) -> Column:
    slack = 0.99 * threshold  # counts of grams may rest on hashes
    return (F.col("most") >= F.col("q") * slack) & (F.col("least") * slack <= F.col("q"))


def _met_hot(grouped: DataFrame, bitmaps: DataFrame, unions: DataFrame, threshold: float) -> DataFrame:
    """As ``_met`` for hot tokens: their texts are spread over ``places``, to which their rows of the matrix are copied.

    The bitmaps come along, so that the bound decides within the join and what it rules out is never a row.
    """
    matrix = grouped.select("token", "group", "places").distinct().join(unions, "group").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    query = grouped.select("token", "text_id", F.pmod(F.xxhash64("text_id"), F.col("places")).cast("int").alias("place")).join(bitmaps.withColumnRenamed("group", "own"), "text_id")
    return query.join(matrix.drop("places"), ["token", "place"]).where((F.col("own") < F.col("group")) & _may_hold(threshold)).select(F.col("text_id").alias("query"), "group")


def _compared(texts: DataFrame, open_: DataFrame, inner: DataFrame, groups: DataFrame, gram: int, threshold: float, kind: T.DataType) -> DataFrame:
    """Compares the queries with the members of the groups that they open, and the members of each group with each other."""
    letters_of = texts.select("text_id", "letters")
    load = open_.select("group").unionByName(inner).groupBy("group").agg(F.ceil(F.count("*") / _QUERIES).cast("int").alias("places"))
    spread = F.pmod(F.xxhash64("text_id"), F.col("places")).cast("int")
    members = groups.join(load, "group").select("text_id", "group", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), spread.alias("leads"))
    members = members.select("text_id", "group", "place", F.lit(0).alias("role"), (F.col("leads") == F.col("place")).alias("leads"))
    queries = open_.withColumnRenamed("query", "text_id").join(load, "group").select("text_id", "group", spread.alias("place"), F.lit(1).alias("role"), F.lit(True).alias("leads"))
    both = members.unionByName(queries).join(letters_of, "text_id").select("group", "place", "role", "leads", "text_id", "letters")
    ordered = both.repartition("group", "place").sortWithinPartitions("group", "place", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the members of the last place, whose queries may go on
        for part in parts(batches, 5):
            table, old = pa.Table.from_batches([part]), 0
            if held is not None and held["group"][0] == part.column(0)[0] and held["place"][0] == part.column(1)[0]:
                table, old = pa.concat_tables([held, table]).combine_chunks(), held.num_rows
            place = _numbers(table)
            held = table.filter(pa.array((place == place[-1]) & (table["role"].to_numpy() == 0)))
            held = held if held.num_rows else None
            yield from _pairs(table, place, old, gram, threshold)

    schema = T.StructType([T.StructField("text_a", kind), T.StructField("text_b", kind), T.StructField("common", T.IntegerType()), T.StructField("either", T.IntegerType())])
    return ordered.mapInArrow(compare, schema)


def _numbers(table: pa.Table) -> np.ndarray:
    """Numbers the places of a table that is sorted by them."""
    group, place = table["group"].to_numpy(), table["place"].to_numpy()
    return np.cumsum(np.append(False, (group[1:] != group[:-1]) | (place[1:] != place[:-1])))


def _pairs(table: pa.Table, place: np.ndarray, old: int, gram: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of a table's texts that agree, of each place's members with its queries and with each other.

    The first ``old`` rows are members whose pairs with each other were compared before.
    """
    table = table.combine_chunks()
    ids, texts = table["text_id"].combine_chunks(), table["letters"].combine_chunks()
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
    member, leads = table["role"].to_numpy() == 0, table["leads"].to_numpy(zero_copy_only=False)
    data, bounds = flat_letters(texts)
    keys, counts = distinct_grams(data, bounds, gram)
    first = np.append(0, np.cumsum(counts))
    code = keys & np.uint64((1 << 40) - 1)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    ends = np.append(starts[1:], len(place))
    every = np.flatnonzero(member)
    # Each member with the rows of its place, a bounded number of them at a time.
    width = (ends - starts)[place[every]]
    for some in np.split(every, np.flatnonzero(np.diff(np.cumsum(width) // _CHUNK)) + 1):
        n = (ends - starts)[place[some]]
        left = np.repeat(some, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[place[some]], n)
        small, large = np.minimum(counts[left], counts[right]), np.maximum(counts[left], counts[right])
        good = leads[right] & ((left >= old) | (right >= old)) & (small >= threshold * large) & (~member[right] | (rank[right] < rank[left]))
        left, right = left[good], right[good]
        load = counts[left] + counts[right]
        for cut in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(load) // _CHUNK)) + 1):
            if not len(cut):
                continue
            a, b = left[cut], right[cut]
            pair = np.arange(len(cut), dtype=np.uint64) << _CODE_BITS
            side = lambda rows: np.repeat(pair - 0, counts[rows]) | code[np.arange(counts[rows].sum()) + np.repeat(first[rows] - (np.cumsum(counts[rows]) - counts[rows]), counts[rows])]  # noqa: E731, B023
            met = np.sort(np.concatenate([side(a), side(b)]))
            common = np.bincount((met[1:][met[1:] == met[:-1]] >> _CODE_BITS).astype(np.int64), minlength=len(cut))
            either = counts[a] + counts[b] - common
            agree = np.flatnonzero(common >= threshold * either)
            low, high = np.where(rank[a] < rank[b], a, b)[agree], np.where(rank[a] < rank[b], b, a)[agree]
            if len(agree):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(low)), ids.take(pa.array(high)), pa.array(common[agree].astype(np.int32)), pa.array(either[agree].astype(np.int32))], names=["text_a", "text_b", "common", "either"])


def near_duplicates(df: DataFrame, id_col: str, text_col: str, gram: int = 8, threshold: float = 0.6, canonical=letters) -> DataFrame:
    """(record_a, record_b, similarity) of the pairs of records, record_a < record_b, whose canonical texts differ and agree to ``threshold``.

    The similarity is that of the sets of distinct ``gram``-letter substrings: those in both over those in either.

    Defined cases: rows with the same id are deliveries of one record; rows with a null id, null and empty texts, and
    texts shorter than ``gram`` are in no pair; records with equal texts make no pair with each other, and each its own
    with a third; repeated rows and ties change nothing; empty input gives no rows; further columns, whatever their names, are
    ignored.
    """
    pairs, records = similar_texts(df, id_col, text_col, gram, threshold, canonical)
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("text_a").alias("text_id")).union(pairs.select("text_b")).distinct()
    copies = stored(records.members().where("record_id <> text_id").join(ends, "text_id", "left_semi"), "members")
    # Every text stands for its own record, and for the further ones that have it.
    whole = copies.unionByName(ends.select(F.col("text_id").alias("record_id"), "text_id"))
    a = whole.select(F.col("record_id").alias("ra"), F.col("text_id").alias("text_a"))
    b = whole.select(F.col("record_id").alias("rb"), F.col("text_id").alias("text_b"))
    wide = pairs.join(a, "text_a").join(b, "text_b")
    return wide.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"), (F.col("common") / F.col("either")).alias("similarity"))
