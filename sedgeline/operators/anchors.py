"""Anchors between pairs of sequences: finding them, and choosing among them."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.operators import kernel
from sedgeline.operators.intervals import covered_periods


#: Letters of the pairs that are looked at together, and the meetings of their windows.
_LETTERS, _MEETINGS = 1 << 18, 1 << 20


class _Windows:
    """All windows of ``least`` letters of some texts: the texts' letters after one another, where the windows begin, whose they are, and a hash of each with its owner."""

    def __init__(self, texts: list[str], owners: np.ndarray, least: int) -> None:
        self.letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        end, begin, owner = (np.repeat(v, sizes) for v in (ends, ends - sizes, owners))
        at = np.flatnonzero(np.arange(len(self.letters)) + least <= end)
        self.at, self.begin, self.end, self.owner = at, begin[at], end[at], owner[at]
        h = np.zeros(max(len(self.letters) - least + 1, 0), np.uint64)
        for k in range(least):
            h = h * np.uint64(0x100000001B3) + self.letters[k : k + len(h)]
        self.hash = (h[at] ^ self.owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)


def _meetings(x: _Windows, y: _Windows, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the windows of both sides that have one owner and the same letters, some at a time."""
    bits = 22
    there = np.zeros(1 << bits, bool)
    place = lambda w: (w.hash >> np.uint64(64 - bits)).astype(np.int64)
    there[place(y)] = True
    wx = np.flatnonzero(there[place(x)])
    there[:] = False
    there[place(x)[wx]] = True
    wy = np.flatnonzero(there[place(y)])
    wy = wy[np.argsort(y.hash[wy], kind="stable")]
    first, last = (np.searchsorted(y.hash[wy], x.hash[wx], side=side) for side in ("left", "right"))
    n = last - first
    wx, first, n = wx[n > 0], first[n > 0], n[n > 0]
    upto = np.cumsum(n)
    at = 0
    while at < len(wx):
        done = upto[at - 1] if at else 0
        stop = max(int(np.searchsorted(upto, done + _MEETINGS, side="right")), at + 1)
        k = np.repeat(np.arange(at, stop), n[at:stop])
        i, j = wx[k], wy[first[k] + np.arange(len(k)) - (upto[k] - n[k] - done)]
        same = x.owner[i] == y.owner[j]
        for d in range(least):
            same &= x.letters[x.at[i] + d] == y.letters[y.at[j] + d]
        yield i[same], j[same]
        at = stop


def _maximal_runs(texts: list[tuple[str, str]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the pair, start_1, start_2, length) of all maximal common substrings. Of the meetings, only those are kept that begin or end a run."""
    numbers = np.arange(len(texts))
    x, y = (_Windows([t[side] for t in texts], numbers, least) for side in (0, 1))
    heads, tails = [], []
    for i, j in _meetings(x, y, least):
        p, q = x.at[i], y.at[j]
        head = (p == x.begin[i]) | (q == y.begin[j]) | (x.letters[p - 1] != y.letters[q - 1])
        r, s = np.minimum(p + least, len(x.letters) - 1), np.minimum(q + least, len(y.letters) - 1)
        tail = (p + least == x.end[i]) | (q + least == y.end[j]) | (x.letters[r] != y.letters[s])
        for keep, out in ((head, heads), (tail, tails)):
            out.append(np.stack([x.owner[i], p - x.begin[i], q - y.begin[j]])[:, keep])
    # In order of the pair, the diagonal and the place, a run's head and its tail have one number.
    head, tail = (np.concatenate(v, axis=1) if v else np.zeros((3, 0), np.int64) for v in (heads, tails))
    head, tail = (v[:, np.lexsort((v[1], v[1] - v[2], v[0]))] for v in (head, tail))
    return head[0], head[1], head[2], tail[1] - head[1] + least


def _crossed_runs(xs: list[str], ys: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start_1, start_2, length) for a key that several pairs have: each first text meets each second one, and meetings are counted along a diagonal as often as they are there."""
    x, y = (_Windows(v, np.zeros(len(v), np.int64), least) for v in (xs, ys))
    met = [(x.at[i] - x.begin[i], y.at[j] - y.begin[j]) for i, j in _meetings(x, y, least)]
    p, q = (np.concatenate([m[side] for m in met]) if met else np.zeros(0, np.int64) for side in (0, 1))
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    first = np.flatnonzero(np.diff(p - q, prepend=np.iinfo(np.int64).min))
    number = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    runs = pd.DataFrame({"d": p - q, "g": p - number, "p": p, "q": q}).groupby(["d", "g"]).agg(p=("p", "min"), q=("q", "min"), last=("p", "max"))
    return runs["p"].to_numpy(), runs["q"].to_numpy(), (runs["last"] - runs["p"]).to_numpy() + least


def longest_apart(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[int]:
    """Numbers of the substrings (start_1, start_2, length) that are kept if the longest go first and one that covers a position already covered on either sequence is dropped.

    None is longer than those kept before it, so one that overlaps any of them begins or ends within it.
    """
    out: list[int] = []
    on_x, on_y = bytearray(int((x + n).max(initial=0))), bytearray(int((y + n).max(initial=0)))
    order = np.lexsort((y, x, -n))
    for i, p, q, k in zip(*(v.tolist() for v in (order, x[order], y[order], n[order])), strict=True):
        if not (on_x[p] or on_x[p + k - 1] or on_y[q] or on_y[q + k - 1]):
            on_x[p : p + k] = on_y[q : q + k] = b"\1" * k
            out.append(i)
    return out


def shared_substrings(pairs: DataFrame, key: str, a: str, b: str, least: int = 30, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], list[int]] | None = None) -> DataFrame:
    """(key, start_1, start_2, length): all maximal common substrings of at least ``least`` letters of each pair, or those of each key whose numbers ``choose`` gives.

    Windows of that many letters meet within a pair, by their hashes and then by their letters; those next to each other on a diagonal
    are one. Neither windows nor meetings are rows, nor what ``choose`` drops, so what is shuffled is the texts. A null key has no row.
    All pairs of one key count as one.
    """
    long = lambda c: F.collect_list(F.when(F.length(c) >= least, F.col(c)))
    rows = pairs.where(F.col(key).isNotNull()).groupBy(key).agg(long(a).alias("__x"), long(b).alias("__y")).where("size(__x) > 0 and size(__y) > 0")

    def found(xs: list[list[str]], ys: list[list[str]], parts: list[list[int]], crossed: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        for part in parts:
            n, *run = _maximal_runs([(xs[k][0], ys[k][0]) for k in part], least)
            yield np.array(part)[n], *run
        for k in crossed:
            run = _crossed_runs(xs[k], ys[k], least)
            yield np.full(len(run[0]), k), *run

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            single = [k for k in range(len(xs)) if len(xs[k]) == len(ys[k]) == 1]
            parts: list[list[int]] = [[]]
            letters = 0
            for k in single:
                if letters > _LETTERS:
                    parts.append([])
                    letters = 0
                parts[-1].append(k)
                letters += len(xs[k][0]) + len(ys[k][0])
            for k, *run in found(xs, ys, [part for part in parts if part], sorted(set(range(len(xs))) - set(single))):
                if choose is not None:
                    # A key's runs follow one another.
                    ends = [*(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
                    kept = [at + i for at, end in zip([0, *ends], ends, strict=False) for i in sorted(choose(*(v[at:end] for v in run)))]
                    k, *run = (v[kept] for v in (k, *run))
                for at in range(0, len(k), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k[cut])), *(pa.array(v[cut].astype(np.int32)) for v in run)], names=[key, "start_1", "start_2", "length"])

    return rows.mapInArrow(find, T.StructType([pairs.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("start_1", "start_2", "length"))]))


def _per_pair(df: DataFrame, key: list[str], choose) -> DataFrame:
    """Keeps the rows of each pair whose positions ``choose`` gives, in one task a pair: the choice is sequential."""

    def kept(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[sorted(choose(rows))]

    return df.groupBy(*key).applyInPandas(kept, df.schema)


def _order(rows: pd.DataFrame, first: list[tuple[str, bool]]) -> np.ndarray:
    """Row numbers in the order of (column, descending), equal rows by their further columns."""
    keys = [-rows[c].to_numpy() if down else rows[c].to_numpy() for c, down in first]
    rest = [pd.factorize(rows[c], sort=True)[0] for c in rows.columns if c not in dict(first)]
    return np.lexsort([*rest[::-1], *keys[::-1]])


def _greedy(rows: pd.DataFrame) -> list[int]:
    x, y, n = (rows[c].to_numpy() for c in ("start_1", "start_2", "length"))
    out: list[int] = []
    for i in _order(rows, [("length", True), ("start_1", False), ("start_2", False)]).tolist():
        k = np.array(out, int)
        if not ((x[i] < x[k] + n[k]) & (x[k] < x[i] + n[i]) | (y[i] < y[k] + n[k]) & (y[k] < y[i] + n[i])).any():
            out.append(i)
    return out


def greedy_non_overlapping(anchors: DataFrame, key: list[str]) -> DataFrame:
    """Longest anchors first; one that covers a position already covered on either sequence is dropped."""
    return _per_pair(anchors, key, _greedy)


def _colinear(rows: pd.DataFrame) -> list[int]:
    y, score = rows["start_2"].tolist(), rows["score"].tolist()
    chain: list[int] = []
    for i in _order(rows, [("start_1", False), ("start_2", False)]).tolist():
        while chain and y[chain[-1]] > y[i] and score[chain[-1]] < score[i]:
            chain.pop()
        if not chain or y[chain[-1]] <= y[i]:
            chain.append(i)
    return chain


def colinear(anchors: DataFrame, key: list[str]) -> DataFrame:
    """Anchors in the same order on both sequences: of two neighbours that cross, the lower score is dropped, the later one on a tie.

    Equal places are taken in order of the further columns.
    """
    return _per_pair(anchors.where("score is not null"), key, _colinear)


def _consistent(total: int, partly: int):
    def choose(rows: pd.DataFrame) -> list[int]:
        x, y, n = (rows[c].to_numpy(np.int64) for c in ("start_1", "start_2", "length"))
        kept: list[int] = []
        references: list[int] = []
        for i in _order(rows, [("score", True), ("start_1", False), ("start_2", False)]).tolist():
            q = np.array(references, int)
            apart = abs((x[i] - y[i]) - (x[q] - y[q]))
            crosses = (x[i] - x[q]) * (y[i] - y[q]) < 0
            contained = (x[i] >= x[q]) & (x[i] + n[i] <= x[q] + n[q]) | (y[i] >= y[q]) & (y[i] + n[i] <= y[q] + n[q])
            overlaps = (x[i] < x[q] + n[q]) & (x[q] < x[i] + n[i]) | (y[i] < y[q] + n[q]) & (y[q] < y[i] + n[i])
            if ((crosses | contained) & (apart > total) | overlaps & (apart > partly)).any():
                continue
            kept.append(i)
            if not (crosses | contained).any():
                references.append(i)
        return kept

    return choose


def without_bad_hits(anchors: DataFrame, key: list[str], total: int = 50, partly: int = 400) -> DataFrame:
    """Anchors, in order of score, that don't contradict a better one: those that cross one or lie within it must be on a diagonal
    at most ``total`` away, those that overlap one at most ``partly``. Close ones that cross are kept but judge no others."""
    return _per_pair(anchors.where("score is not null"), key, _consistent(total, partly))


def empty_blocks(chain: DataFrame, key: list[str]) -> DataFrame:
    """(key, x0, x1, y0, y1, area): the blocks between neighbouring anchors of a colinear chain, the one before the first among them.

    An anchor that overlaps the one before begins a block of no area; such blocks are left out.
    """
    along = Window.partitionBy(*key).orderBy("start_1", "start_2", "length")
    end = lambda c: F.coalesce(F.lag(F.col(c) + F.col("length")).over(along), F.lit(0))
    blocks = chain.select(*key, end("start_1").alias("x0"), F.col("start_1").alias("x1"), end("start_2").alias("y0"), F.col("start_2").alias("y1"))
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(0)).cast("long") * F.greatest(F.col("y1") - F.col("y0"), F.lit(0))
    return blocks.withColumn("area", area).where("area > 0")


def relieved_blocks(blocks: DataFrame, key: list[str], limit: int) -> DataFrame:
    """``blocks`` with ``gap``: whether a block's cells aren't filled, but led around by gaps, so that a pair's cells fit ``limit``.

    The largest blocks go first, equals from the left, and no more of them than needed.
    """
    order = [F.col("area").desc(), "x0", "y0"]
    every, before = Window.partitionBy(*key), Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("area").over(every) - F.coalesce(F.sum("area").over(before), F.lit(0))
    return blocks.withColumn("gap", left > limit)


def band(anchors: list[tuple[int, int, int]], n: int, m: int, offset: int = 15, limit: int | None = None) -> tuple[list[int], list[int]]:
    """For each site 0..n of the first sequence, the sites of the second that an alignment near the anchors (start_1, start_2, length)
    may pair it with: between neighbouring anchors the whole block between them, and ``offset`` more on either side, always connected.

    With a ``limit`` on the blocks' cells, the largest blocks are led around by gaps (first along the one sequence, then the other)
    until the rest fits.
    """
    lo, hi = [m] * (n + 1), [0] * (n + 1)
    ends = [(0, 0)] + [p for s1, s2, k in sorted(anchors) for p in ((s1, s2), (s1 + k, s2 + k))] + [(n, m)]
    # Blocks and anchors take turns.
    blocks = [(x0, y0, x1, y1, k % 2 == 1) for k, ((x0, y0), (x1, y1)) in enumerate(zip(ends, ends[1:], strict=False))]
    area = [0 if diagonal else max(x1 - x0, 0) * max(y1 - y0, 0) for x0, y0, x1, y1, diagonal in blocks]
    around: set[int] = set()
    for k in sorted(range(len(blocks)), key=lambda k: -area[k]):
        if limit is None or sum(area) - sum(area[r] for r in around) <= limit:
            break
        around.add(k)
    for k, (x0, y0, x1, y1, diagonal) in enumerate(blocks):
        for x in range(x0, x1 + 1):
            lo[x] = min(lo[x], max(0, (y0 + x - x0 if diagonal else y0) - offset))
            hi[x] = max(hi[x], min(m, (y0 + x - x0 if diagonal else y0 if k in around and x < x1 else y1) + offset))
    for x in range(1, n + 1):
        hi[x] = max(hi[x], hi[x - 1])
    for x in range(n - 1, -1, -1):
        lo[x] = min(lo[x], lo[x + 1])
    return lo, hi


def covered_share(anchors: DataFrame, key: list[str], size: str) -> DataFrame:
    """(key, share): the part of the first sequence (of ``size`` letters) that its anchors cover, overlaps counted once."""
    placed = anchors.where("length > 0 and start_1 >= 0").select(F.struct(*key).alias("k"), F.col("start_1").alias("s"), (F.col("start_1") + F.col("length")).alias("e"), size)
    sizes = placed.groupBy("k").agg(F.max(size).alias("size"))
    covered = covered_periods(placed, "k", "s", "e").where("kind = 'period'").groupBy("k").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("n"))
    return covered.join(sizes, "k").select("k.*", (F.col("n") / F.col("size")).alias("share"))


#: Letters of the substrings that long sequences are anchored by, and the cells of a pair beyond which they are.
_ANCHOR, _WHOLE_CELLS = 16, 1 << 20


def unique_anchors(x: str, y: str, k: int = _ANCHOR) -> list[tuple[int, int, int]]:
    """A colinear chain of substrings of k letters that stand once in each of two sequences: (start_1, start_2, length), runs joined."""

    def once(s: str) -> dict[str, int]:
        seen: dict[str, int] = {}
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            seen[w] = -1 if w in seen else i
        return seen

    there = once(y)
    met = [(i, there[w]) for w, i in once(x).items() if i >= 0 and there.get(w, -1) >= 0]
    met.sort()
    # The longest ascending subsequence.
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(met)
    for p, (_, j) in enumerate(met):
        at = bisect.bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            ends.append(p)
        else:
            tails[at], ends[at] = j, p
        before[p] = ends[at - 1] if at else -1
    chain, p = [], ends[-1] if ends else -1
    while p >= 0:
        chain.append(met[p])
        p = before[p]
    out: list[tuple[int, int, int]] = []
    for i, j in chain[::-1]:
        if out and i - out[-1][0] == j - out[-1][1] and i <= out[-1][0] + out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], i + k - out[-1][0])
        elif not out or i >= out[-1][0] + out[-1][2] and j >= out[-1][1] + out[-1][2]:
            out.append((i, j, k))
    return out


def tunnel(x: str, y: str, offset: int = 15, limit: int = 1 << 28) -> tuple[list[int], list[int]] | None:
    """The band in which two sequences are aligned: around the substrings that they share, with the largest empty blocks led around by
    gaps if more than ``limit`` cells are left. None, that is all of it, for pairs of at most _WHOLE_CELLS cells."""
    if len(x) * len(y) <= _WHOLE_CELLS:
        return None
    return band(unique_anchors(x, y), len(x), len(y), offset, limit)


def aligned(x: str, y: str, model: kernel.Model) -> tuple[list[tuple[str, int, int]], float]:
    """The best path of two sequences, within their tunnel if they are long, and its score."""
    a, b = kernel.linear(x).states, kernel.linear(y).states
    steps, score = kernel.chain_path(a, b, model, tunnel(x, y))
    return (steps, score) if np.isfinite(score) else kernel.chain_path(a, b, model)


def aligned_all(xs: list[str], ys: list[str], model: kernel.Model) -> list[tuple[np.ndarray, float]]:
    """The best paths of pairs of sequences, as ``aligned`` finds them, as the matrices (0 to 2 for M, X and Y) of their steps, and their scores."""
    out: list[tuple[np.ndarray, float]] = [None] * len(xs)
    whole = [k for k in range(len(xs)) if len(xs[k]) * len(ys[k]) <= _WHOLE_CELLS]
    for k, found in zip(whole, kernel.chain_paths([(kernel.letter_states(xs[k]), kernel.letter_states(ys[k])) for k in whole], model), strict=True):
        out[k] = found
    for k in range(len(xs)):
        if out[k] is None:
            steps, score = aligned(xs[k], ys[k], model)
            out[k] = np.array(["MXY".index(s[0]) for s in steps], np.uint8), score
    return out
