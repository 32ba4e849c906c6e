"""Encoding with a public byte-pair vocabulary by dynamic programming over byte prefixes.

For every byte prefix of a piece of text there is exactly one token that the prefix's encoding can end
with. A table of these last tokens is filled from left to right: a token that ends at a prefix is the one
if the token before it, which the table already has, and the token itself are what merging gives for
their joint bytes. Reading the table backwards gives the ids. A filled table never changes when bytes are
appended, so appends continue it, and an edit re-encodes only until the pieces fall into step again.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after a piece that tell where it ends: two, as in ' before re, or in white space before white space before text.
_AHEAD = 2
# Fixed value: the published pattern that splits text before the merges of this family of vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A vocabulary file of more bytes isn't broadcast but refused; public ones have a few megabytes.
MAX_VOCABULARY_BYTES = 64 << 20
#: Remembered pieces and pairs of one Python worker. Beyond it they are forgotten and computed anew.
_MEMO = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file whose lines hold a token in base 64 and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class PieceTable:
    """The last token of each byte prefix of one piece. Grows by appending."""

    __slots__ = ("data", "last")

    def __init__(self) -> None:
        self.data = b""
        self.last: list[int] = [-1]


class PrefixEncoder:
    """Encodes text; keeps pieces that it met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN, ahead: int = _AHEAD) -> None:
        self.ranks, self.ahead = ranks, ahead
        self.token = {i: t for t, i in ranks.items()}
        # Endings of tokens, with the token that the ending itself is, if any: a scan backwards stops where none goes on.
        self.endings: dict[bytes, int] = {t[i:]: -1 for t in ranks for i in range(1, len(t))} | ranks
        self.split = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        """The bytes of at most two tokens, merged by rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands_alone(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self._merged(self.token[token])) == 1
        return known

    def _fits(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > _MEMO:
                self._pairs.clear()
            a, b = self.token[left], self.token[right]
            known = self._pairs[left, right] = self._merged(a + b) == [a, b]
        return known

    def extend(self, table: PieceTable, more: bytes) -> PieceTable:
        """Appends bytes to a piece; what the table holds stays."""
        data = table.data = table.data + more
        last, endings = table.last, self.endings
        for end in range(len(last), len(data) + 1):
            for begin in range(end - 1, -1, -1):
                token = endings.get(data[begin:end])
                if token is None:
                    raise ValueError("the vocabulary lacks single bytes")
                if token >= 0 and (self._fits(last[begin], token) if begin else self._stands_alone(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return table

    def ids_of(self, table: PieceTable) -> list[int]:
        if table.data in self.ranks:  # a piece that is a token is that token, whether or not merges lead to it
            return [self.ranks[table.data]]
        out, end = [], len(table.data)
        while end:
            out.append(table.last[end])
            end -= len(self.token[table.last[end]])
        return out[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self._pieces.get(piece)
        if known is None:
            if len(self._pieces) > _MEMO:
                self._pieces.clear()
            data = piece.encode()
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else tuple(self.ids_of(self.extend(PieceTable(), data)))
            if len(data) < 256:
                self._pieces[piece] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or missing one."""
        out: list[int] = []
        if text:
            piece, get = self.piece, self._pieces.get
            for p in self.split.findall(text):
                out.extend(get(p) or piece(p))
        return out


class PrefixText:
    """A text with its piece boundaries and tables, for exact appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder = encoder
        self.text = ""
        self.starts: list[int] = []
        self.tables: list[PieceTable] = []
        self.append(text)

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.ids_of(t)]

    def _table(self, piece: str, old: PieceTable | None = None) -> PieceTable:
        data = piece.encode()
        if old is not None and data.startswith(old.data):
            return self.encoder.extend(old, data[len(old.data) :])
        return self.encoder.extend(PieceTable(), data)

    def append(self, more: str) -> int:
        """Only the last pieces can change; where the one that the text goes on in grows, its table is continued."""
        return self.replace(len(self.text), len(self.text), more) if more else 0

    def replace(self, begin: int, end: int, new: str) -> int:
        """Replaces text[begin:end]; gives the number of pieces that were encoded anew."""
        # Where a piece ends may depend on as many characters after it as the pattern looks ahead.
        kept = bisect.bisect_left(self.starts, begin - self.encoder.ahead + 1)
        while kept and (self.starts[kept] if kept < len(self.starts) else len(self.text)) + self.encoder.ahead > begin:
            kept -= 1
        shift = len(new) - (end - begin)
        later = bisect.bisect_left(self.starts, end)
        text = self.text[:begin] + new + self.text[end:]
        at = self.starts[kept] if kept < len(self.starts) else 0
        old = self.tables[kept] if kept < later else None
        starts, tables, fresh = self.starts[:kept], self.tables[:kept], 0
        for m in self.encoder.split.finditer(text, at):
            while later < len(self.starts) and self.starts[later] + shift < m.start():
                later += 1
            if later < len(self.starts) and self.starts[later] + shift == m.start():
                starts += [s + shift for s in self.starts[later:]]
                tables += self.tables[later:]
                break
            starts.append(m.start())
            tables.append(self._table(m.group(), old))
            old = None
            fresh += 1
        self.text, self.starts, self.tables = text, starts, tables
        return fresh


def encode_corpus(df: DataFrame, text_col: str, vocabulary: str, ids_col: str = "ids", keep: list[str] | None = None, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``df``'s columns ``keep`` (all other columns by default) and ``ids_col``, an array of int.

    ``vocabulary`` is the path of a rank file on the driver; its content is broadcast, being of bounded size.
    No special tokens: strings that look like one are ordinary text. Each row is encoded by itself, in one pass
    without a shuffle.

    Defined cases: a null and an empty text give an empty list; texts of any length, white space or script are
    encoded whole; repeated rows give repeated results; an input column named like ``ids_col`` is replaced; an
    empty input gives no rows.
    """
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (text_col, ids_col)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(read_ranks(shared.value), pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flat: list[int] = []
                offsets = [0]
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    flat.extend(encoder.encode(text))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*kept, ids_col])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType(), True))])
    return source.mapInArrow(encode, schema)
