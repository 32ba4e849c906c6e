"""Keyword-stuffed and link-list pages, by a hidden Markov model over a page's lines.

A page is cut into lines, and long lines into sentences and stretches of words. The model labels each as prose, link
list, tag list or menu (running data such as logs and tables are a second prose state); neighbouring lines inform each
other through the transitions. A page is flagged when more than half of its words stand in lines that aren't prose.

The model is trained here, by expectation maximisation on rated pages. At most ``MAX_RATED`` rated pages (those with
the smallest hash of their id) of at most ``MAX_RATED_CHARS`` characters are used, so the fit has the same cost at every
size; all pages are labelled.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rated pages that the model is fitted on, at most, and the characters of each; longer ones aren't used for the fit.
MAX_RATED, MAX_RATED_CHARS = 1500, 50_000
STATES = ("prose", "data", "links", "tags", "menu")
_LISTS = (2, 3, 4)
#: Weight of the list states in a page that raters took for a proper one: raters err, and proper pages have a few such lines.
_DOUBT = 0.05
#: Words of one line's stretch.
_STRETCH = 12
#: Bytes of text that are labelled at once, at least one page.
_BATCH_BYTES = 1 << 20
#: Words that a worker remembers; beyond that they are forgotten.
_MEMO = 400_000

_URL = re.compile(r"(?:https?://|www\.)", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"(?<=[.!?;])\s+|(?<=>)\s+(?=<)")


def lines_of(text: str) -> list[list[str]]:
    """The page's lines as lists of words; long ones are cut after sentences and into stretches."""
    out = []
    for line in text.splitlines():
        words = line.split()
        if len(words) <= _STRETCH:
            if words:
                out.append(words)
            continue
        for sentence in _CUT.split(line):
            words = sentence.split()
            for i in range(0, len(words), _STRETCH):
                out.append(words[i : i + _STRETCH])
    return [w for w in out if w]


#: Values of each feature of a line.
_BINS = (3, 3, 6, 3, 3, 3, 2)


class _Words(dict):
    """Numbers of words, with what a line's features take from each; remembered up to a bound."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.parts: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.part_ids, self.part_ends = array('q'), array('q', [0])
        self._numbers = np.zeros((1024, 7))
        self._filled = 0

    def numbers(self) -> np.ndarray:
        """A row for each word met so far. Only words that are new since the last time are converted."""
        fresh = len(self.rows)
        if fresh:
            if self._filled + fresh > len(self._numbers):
                self._numbers = np.concatenate([self._numbers[: self._filled], np.zeros((self._filled + 2 * fresh, 7))])
            self._numbers[self._filled : self._filled + fresh] = self.rows
            self._filled += fresh
            self.rows = []
        return self._numbers

    def __missing__(self, word: str) -> int:
        url = bool(_URL.search(word))
        parts = [] if url else _LETTERS.findall(word.lower())
        self.part_ids.extend([self.parts.setdefault(p, len(self.parts)) for p in parts])
        self.part_ends.append(len(self.part_ids))
        marks = sum(map(word.count, "#|<>[]+~")) + (word[-1] == ":")
        self.rows.append((url, marks, sum(self.odds.get(p, 0.0) for p in parts), len(parts), sum(map(str.isdigit, word)), len(word), word[:1].islower()))
        n = self[word] = self._filled + len(self.rows) - 1
        return n


def _features(pages: list[list[list[str]]], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all pages: a row of small numbers for each, its number of words, and its page."""
    if len(words) > _MEMO:
        words.forget()
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    lines = [line for p in pages for line in p]
    n = np.array([len(line) for line in lines], np.int64)
    if not len(lines):
        return np.zeros((0, len(_BINS)), np.int8), n, page
    ids = np.array([words[w] for line in lines for w in line])
    at = np.cumsum(n) - n
    urls, marks, odds, plain, digits, size, low = np.add.reduceat(words.numbers()[ids], at).T
    # Words that stand at least three times in their page.
    ends, part_ids = (np.frombuffer(a, np.int64) if len(a) else np.zeros(0, np.int64) for a in (words.part_ends, words.part_ids))
    count = ends[ids + 1] - ends[ids]
    part = part_ids[np.arange(count.sum()) + np.repeat(ends[ids] - (np.cumsum(count) - count), count)]
    line_of = np.repeat(np.repeat(np.arange(len(n)), n), count)
    _, which, times = np.unique((page[line_of] << 32) | part, return_inverse=True, return_counts=True)
    again = np.bincount(line_of, times[which] >= 3, len(n)) / np.maximum(plain, 1)
    ending = np.array([line[-1][-1] in ".?!" for line in lines]) & (n >= 5)
    share = lambda x, of: np.where(x > 0, np.where(x / of < 0.3, 1, 2), 0)
    rows = [share(urls, n), share(marks, n), np.searchsorted((-1.0, -0.3, 0.1, 0.6, 1.5), odds / (plain + 1)), np.digitize(again, (0.4, 0.8)), np.digitize(digits / size, (0.03, 0.25)), np.digitize(low / n, (0.4, 0.85)), ending]
    return np.stack(rows, 1).astype(np.int8), n, page


def _rule(rows: np.ndarray) -> np.ndarray:
    """Where the fit begins: how well each state suits each line, by its look alone."""
    url, mark, score, again, digits, low, ends = rows.T
    out = np.full((len(rows), len(STATES)), 0.02)
    out[:, 0] += np.where((url == 0) & (mark == 0) & (score <= 2), 1.0, 0.0) + 0.3 * ends
    out[:, 1] += np.where((url == 0) & (digits == 2) & (score <= 2), 1.0, 0.0) + np.where((mark == 1) & (score <= 1), 0.3, 0.0)
    out[:, 2] += np.where(url == 2, 2.0, 0.0)
    out[:, 3] += np.where((url < 2) & (score >= 4) & (digits < 2), 1.0, 0.0) + np.where((again == 2) & (score >= 3), 0.3, 0.0)
    out[:, 4] += np.where((url < 2) & (mark >= 1) & (score >= 3), 1.5, 0.0)
    return out / out.sum(1, keepdims=True)


@dataclass
class PageModel:
    """Log probabilities of the first state, the transitions and each feature's values, and the words' log odds."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]
    odds: dict[str, float]

    def log_emission(self, rows: np.ndarray) -> np.ndarray:
        return sum(e[:, rows[:, f]].T for f, e in enumerate(self.emit))

    def states(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most probable states (Viterbi) of the lines of many pages at once, which follow one another in ``rows``.

        Holds a byte for each line and state, whatever the pages' lengths.
        """
        out = np.zeros(len(rows), np.int8)
        order = np.argsort(-lengths, kind="stable")
        firsts, longest = (np.cumsum(lengths) - lengths)[order], int(lengths.max(initial=0))
        if not longest:
            return out
        live = np.searchsorted(-lengths[order], -np.arange(longest))  # pages with more than t lines
        back, below = np.zeros((len(rows), len(STATES)), np.int8), np.cumsum(live) - live
        best = self.start + self.log_emission(rows[firsts[: live[0]]])
        last = np.zeros(len(order), np.int8)
        for t in range(1, longest):
            last[live[t] : live[t - 1]] = best[live[t] :].argmax(1)
            through = best[: live[t], :, None] + self.move
            back[below[t] : below[t] + live[t]] = through.argmax(1)
            best = through.max(1) + self.log_emission(rows[firsts[: live[t]] + t])
        last[: len(best)] = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            now = slice(0, live[t])
            out[firsts[now] + t] = last[now]
            if t:
                last[now] = back[np.arange(below[t], below[t] + live[t]), last[now]]
        return out


def _word_odds(pages: list[tuple[str, bool]]) -> dict[str, float]:
    """Log odds of each word to stand in pages rated as spam rather than proper ones, shrunk for rare words."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, spam in pages:
        seen[spam].update(set(_LETTERS.findall(text.lower())))
    n = {k: sum(1 for _, spam in pages if spam == k) for k in (True, False)}
    if not n[True] or not n[False]:
        return {}
    return {
        w: float(np.log((seen[True][w] + 0.5) / (n[True] + 1)) - np.log((seen[False][w] + 0.5) / (n[False] + 1))) * (c / (c + 2))
        for w in seen[True].keys() | seen[False].keys()
        if (c := seen[True][w] + seen[False][w]) >= 2
    }


def fit_pages(pages: list[tuple[str, bool]], rounds: int = 8) -> PageModel:
    """Fits the model to rated texts: (text, whether rated as spam). Without any, it stays where the rules begin."""
    odds = _word_odds(pages)
    cut = [(lines, s) for text, s in pages if (lines := lines_of(text))]
    spam = [s for _, s in cut]
    every, _, page = _features([lines for lines, _ in cut], _Words(odds))
    rows = np.split(every, np.flatnonzero(np.diff(page)) + 1) if cut else []
    if not rows:  # no page to learn from: every combination of values, as the rules see it
        rows, spam = [np.stack(np.meshgrid(*map(range, _BINS), indexing="ij"), -1).reshape(-1, len(_BINS)).astype(np.int8)], [True]
        rounds = 0
    k = len(STATES)
    weight = [_rule(r) * np.where(np.isin(np.arange(k), _LISTS) & (not s), _DOUBT, 1.0) for r, s in zip(rows, spam, strict=True)]
    weight = [w / w.sum(1, keepdims=True) for w in weight]
    stay = np.full((k, k), 0.05) + np.eye(k)
    model = _maximised(rows, weight, sum(w[0] for w in weight) + 1, stay * 10, odds)
    for _ in range(rounds):
        weight, starts, moves = [], np.ones(k), stay.copy()
        for r, s in zip(rows, spam, strict=True):
            gamma, xi = _expected(model, r, np.where(np.isin(np.arange(k), _LISTS) & (not s), np.log(_DOUBT), 0.0))
            weight.append(gamma)
            starts += gamma[0]
            moves += xi
        model = _maximised(rows, weight, starts, moves, odds)
    return model


def _maximised(rows: list[np.ndarray], weight: list[np.ndarray], starts: np.ndarray, moves: np.ndarray, odds: dict[str, float]) -> PageModel:
    every, w = np.concatenate(rows), np.concatenate(weight)
    emit = []
    for f, bins in enumerate(_BINS):
        counts = np.stack([np.bincount(every[:, f], w[:, s], bins) for s in range(w.shape[1])]) + 0.5
        emit.append(np.log(counts / counts.sum(1, keepdims=True)))
    return PageModel(np.log(starts / starts.sum()), np.log(moves / moves.sum(1, keepdims=True)), emit, odds)


def _expected(model: PageModel, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward passes over one page, scaled: the states' weights and the expected transitions."""
    e = model.log_emission(rows) + bias
    e = np.exp(e - e.max(1, keepdims=True))
    move, n = np.exp(model.move), len(rows)
    ahead, behind = np.zeros_like(e), np.ones_like(e)
    ahead[0] = np.exp(model.start) * e[0]
    ahead[0] /= ahead[0].sum()
    for t in range(1, n):
        ahead[t] = (ahead[t - 1] @ move) * e[t]
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        behind[t] = move @ (e[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    gamma = ahead * behind
    gamma /= gamma.sum(1, keepdims=True)
    if n == 1:
        return gamma, np.zeros_like(move)
    xi = ahead[:-1, :, None] * move * (e[1:] * behind[1:])[:, None, :]
    return gamma, (xi / xi.sum((1, 2), keepdims=True)).sum(0)


def rated_pages(docs: DataFrame, ratings: DataFrame, doc_id: str, text: str, label: str) -> list[tuple[str, bool]]:
    """Texts of at most MAX_RATED rated pages, and whether they are spam by most of their ratings (a tie is dropped)."""
    votes = ratings.where(F.col(label).isin("spam", "page") & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("d")).agg(F.sum(F.when(F.col(label) == "spam", 1).otherwise(-1)).alias("v")).where("v <> 0")
    some = votes.orderBy(F.xxhash64("d"), "d").limit(MAX_RATED)
    joined = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).join(F.broadcast(some), "d").where(F.col("t").isNotNull() & (F.length("t") <= MAX_RATED_CHARS))
    return [(r["t"], r["v"] > 0) for r in joined.groupBy("d").agg(F.max("t").alias("t"), F.max("v").alias("v")).orderBy("d").collect()]


def page_shares(docs: DataFrame, model: PageModel, doc_id: str, text: str) -> DataFrame:
    """(doc_id, words, links, tags, menu): each document's words, and how many of them stand in lines of each list kind.

    Each row is labelled by itself, in one pass without a shuffle. Defined cases: a null, empty or blank text has 0
    words; null ids stay null; repeated rows give repeated results; texts of any length are labelled whole; empty
    input gives no rows; further columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of MAX_RATED pages
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = _Words(m.odds)
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy())
            # At most so many rows and about so many bytes at once; a longer page comes alone.
            cuts = np.flatnonzero(np.diff(np.append(-1, (size - 1) // _BATCH_BYTES * 2 + (np.arange(len(size)) // 256) % 2))) if len(size) else []
            for at, end in zip(cuts, [*cuts[1:], len(size)], strict=True):
                batch = whole.slice(at, end - at)
                pages = [lines_of(t) if t else [] for t in batch.column(1).to_pylist()]
                rows, sizes, page = _features(pages, words)
                path = m.states(rows, np.array([len(p) for p in pages]))
                counts = np.bincount(page * len(STATES) + path, sizes, len(pages) * len(STATES)).astype(np.int64).reshape(-1, len(STATES))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in (counts.sum(1), counts[:, 2], counts[:, 3], counts[:, 4])]], names=["doc_id", "words", "links", "tags", "menu"])

    schema = T.StructType([source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("words", "links", "tags", "menu")]])
    return source.mapInArrow(label, schema)


def list_pages(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", share: float = 0.5) -> DataFrame:
    """``page_shares`` of the documents of which more than ``share`` of the words aren't prose.

    Cases are defined as for ``page_shares``; without usable ratings the model is the one that the rules begin with.
    """
    model = fit_pages(rated_pages(docs, ratings, doc_id, text, label))
    return page_shares(docs, model, doc_id, text).where((F.col("links") + F.col("tags") + F.col("menu")) > share * F.col("words"))
