"""Alignment of two sequence graphs: a pair hidden Markov model with affine gaps, in numpy. No Spark here.

A graph has sites 0 to n+1, of which the first and the last are its ends, and weighted edges from earlier to later
sites. A path through both graphs pairs sites (M), or takes one of the left (X) or of the right graph alone (Y). The
matrices are filled row by row; a row is vectorised over the right graph, whose few edges that leave the chain are patched in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from sedgeline.functions.models import GAPS, Alphabet, GapModel, dna_scores, gap_logs
from sedgeline.functions.sequence import BASE_BITS, DNA

NO = -np.inf
_BITS = np.array([BASE_BITS[c] for c in DNA])
_STATE = np.zeros(16, np.int64)
_STATE[_BITS] = np.arange(15)
# States of the characters up to 127; other letters count as N.
_LETTER_STATE = np.array([DNA.find(chr(c)) if chr(c) in DNA else len(DNA) - 1 for c in range(128)], np.int64)


def letter_states(seq: str) -> np.ndarray:
    """The states of a nucleotide sequence's letters."""
    return _LETTER_STATE[np.minimum(np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]


@dataclass
class Graph:
    """``states``: of the sites 1..n, as numbers of the nucleotide alphabet. Edges as columns, sorted by their end."""

    states: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    unused: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    age: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        order = np.lexsort((self.src, self.dst))
        zero = len(self.src)
        if len(self.unused) != zero:
            self.unused = np.zeros(zero, np.int64)
        if len(self.age) != zero:
            self.age = np.zeros(zero)
        for name in ("src", "dst", "weight", "unused", "age"):
            setattr(self, name, np.asarray(getattr(self, name))[order])

    @property
    def n(self) -> int:
        return len(self.states)

    def into(self) -> list[np.ndarray]:
        """Numbers of the edges that end in each site."""
        cuts = np.searchsorted(self.dst, np.arange(self.n + 3))
        return [np.arange(cuts[i], cuts[i + 1]) for i in range(self.n + 2)]


def linear(seq: str, alphabet: Alphabet | None = None) -> Graph:
    """The chain of a sequence, of nucleotides unless an alphabet is given; letters outside the alphabet count as N."""
    states = alphabet.states(seq) if alphabet else letter_states(seq)
    at = np.arange(len(states) + 1)
    return Graph(states, at, at + 1, np.ones(len(at)))


def with_edges(seq: str, edges: list[tuple[int, int, float]]) -> Graph:
    """The chain with further edges (from, to, weight), such as those that skip homopolymer sites."""
    g = linear(seq)
    inside = [(a, b, w) for a, b, w in edges if 0 <= a < b - 1 and b <= g.n + 1]
    return Graph(g.states, np.append(g.src, [e[0] for e in inside]).astype(int), np.append(g.dst, [e[1] for e in inside]).astype(int), np.append(g.weight, [e[2] for e in inside]))


@dataclass
class Model:
    """Scores of pairs of states and the logs of the gap probabilities, for one distance."""

    scores: np.ndarray
    match: float
    open: float
    extend: float
    end: float


def model_at(t: float, pi: tuple[float, float, float, float] = (0.25,) * 4, gaps: GapModel = GAPS["dna"]) -> Model:
    return Model(dna_scores(t, pi), *gap_logs(t, gaps))


def alphabet_model(alphabet: Alphabet, t: float) -> Model:
    return Model(alphabet.scores(t), *gap_logs(t, GAPS[alphabet.name]))


class Matrices:
    """Viterbi, or forward, scores of all pairs of sites (the ends included), in logs."""

    def __init__(self, a: Graph, b: Graph, model: Model, total: bool = False, band: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.a, self.b, self.model, self.total, self.band = a, b, model, total, band
        self.add = np.logaddexp if total else np.maximum
        self.ea, self.eb = a.into(), b.into()
        self.wa, self.wb = 0.5 * np.log(a.weight), 0.5 * np.log(b.weight)
        n, m = a.n + 1, b.n + 1
        self.M, self.X, self.Y = (np.full((n, m), NO) for _ in range(3))
        self.M[0, 0] = 0.0
        # The right graph's plain steps (one edge, from the site before), and the edges that aren't.
        plain = np.array([len(e) == 1 and b.src[e[0]] == j - 1 for j, e in enumerate(self.eb)])
        self.breaks = [j for j in range(1, m) if not plain[j]]
        self.chain = np.full(m, NO)
        self.extra = []
        for j in range(1, m):
            for e in self.eb[j]:
                if b.src[e] == j - 1:
                    self.chain[j] = self.wb[e]
                else:
                    self.extra.append((int(b.src[e]), j, self.wb[e]))
        q, j, w = (np.array(c) for c in zip(*self.extra, strict=True)) if self.extra else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.extra_from, self.extra_to, self.extra_weight = q, j, w
        # Stretches whose sites each follow from the one before.
        cut = np.append(np.append(0, np.flatnonzero(self.chain[1:] == NO) + 1), m)
        self.stretches = [(int(x), int(y)) for x, y in zip(cut, cut[1:], strict=False) if y - x > 1]
        for i in range(n):
            self._row(i, m)
        self.end = NO
        for ends in self._ends():
            self.end = self.add(self.end, ends[0])

    def _row(self, i: int, m: int) -> None:
        mo, x = self.model, self.model.extend
        M, X, Y, a = self.M, self.X, self.Y, self.a
        step = np.full(m, x)
        step[0] = step[-1] = mo.end
        for e in self.ea[i]:
            p = int(a.src[e])
            best = self.add(M[p] + 2 * mo.match, self.add(X[p], Y[p]) + mo.match)
            come = np.full(m, NO)
            come[1:] = best[:-1] + self.chain[1:]
            if len(self.extra_to):
                self.add.at(come, self.extra_to, best[self.extra_from] + self.extra_weight)
            M[i, 1:] = self.add(M[i, 1:], come[1:] + self.wa[e])
            opened = M[p] + mo.match + (0.0 if p == 0 else mo.open)
            X[i] = self.add(X[i], self.add(X[p] + step, self.add(Y[p] + mo.open, opened)))
        if i and m > 1:
            M[i, 1:] += mo.scores[a.states[i - 1], self.b.states]
        if self.band is not None:
            lo, hi = self.band[0][i], self.band[1][i]
            for mat in (M, X):
                mat[i, :lo] = mat[i, hi + 1 :] = NO
            if i == 0:
                M[0, 0] = 0.0
        self._along(i, m)
        if self.band is not None:
            Y[i, :lo] = Y[i, hi + 1 :] = NO

    def _along(self, i: int, m: int) -> None:
        """Y of a row: each site follows from the one before, so plain stretches are a running best."""
        mo, Y = self.model, self.Y
        x = mo.end if i in (0, self.a.n) else mo.extend
        base = self.add(self.X[i] + mo.open, self.M[i] + mo.match + mo.open)
        base[0] = self.add(self.X[i, 0] + mo.open, self.M[i, 0] + mo.match)
        if not self.total:
            self._along_best(i, m, x, base)
            return
        run = np.logaddexp.accumulate
        at = 1
        for stop in [*self.breaks, m]:
            if stop > at:  # sites at..stop-1 come by plain steps
                k = np.arange(at - 1, stop - 1)
                first = base[at - 1 : stop - 1].copy()
                first[0] = self.add(first[0], Y[i, at - 1] + x)
                with np.errstate(invalid="ignore"):
                    Y[i, at:stop] = run(first - k * x) + k * x
            if stop < m:
                for e in self.eb[stop]:
                    q = int(self.b.src[e])
                    Y[i, stop] = self.add(Y[i, stop], self.add(base[q], Y[i, q] + x))
            at = stop + 1

    def _along_best(self, i: int, m: int, x: float, base: np.ndarray) -> None:
        """As ``_along`` for the best path: running bests along the stretches and steps over other edges, until none betters."""
        y = np.full(m, NO)
        y[1:] = np.where(self.chain[1:] > NO, base[:-1], NO)
        np.maximum.at(y, self.extra_to, base[self.extra_from])
        at = np.arange(m) * x
        while True:
            y -= at
            for a, b in self.stretches:
                np.maximum.accumulate(y[a:b], out=y[a:b])
            y += at
            if not len(self.extra_to):
                break
            over = y[self.extra_from] + x
            if not (over > y[self.extra_to] + 1e-12).any():
                break
            np.maximum.at(y, self.extra_to, over)
        self.Y[i] = np.maximum(self.Y[i], y)

    def _ends(self):
        """(score, matrix, p, q, left edge, right edge) of the ways into both ends."""
        mo = self.model
        for e in self.ea[self.a.n + 1]:
            for f in self.eb[self.b.n + 1]:
                p, q = int(self.a.src[e]), int(self.b.src[f])
                for mat, score in (("M", self.M[p, q] + mo.match), ("X", self.X[p, q]), ("Y", self.Y[p, q])):
                    yield score, mat, p, q, int(e), int(f)

    def path(self, rng: np.random.Generator | None = None) -> tuple[list[tuple[str, int, int]], set[int], set[int]]:
        """The best path, or one drawn in proportion to its probability: steps (matrix, i, j), and the edges used on each side.

        Of equally good ways the first counts: M before X before Y, gaps going on before they open, earlier edges first.
        """
        ways = list(self._ends())
        _, mat, i, j, e, f = ways[self._choose([w[0] for w in ways], rng)]
        steps, left, right, mo = [], {e}, {f}, self.model
        while i or j:
            steps.append((mat, i, j))
            ways = []
            if mat == "M":
                for e in self.ea[i]:
                    for f in self.eb[j]:
                        p, q = int(self.a.src[e]), int(self.b.src[f])
                        w = self.wa[e] + self.wb[f]
                        ways += [(self.M[p, q] + 2 * mo.match + w, "M", p, q, e, f), (self.X[p, q] + mo.match + w, "X", p, q, e, f), (self.Y[p, q] + mo.match + w, "Y", p, q, e, f)]
            elif mat == "X":
                step = mo.end if j in (0, self.b.n) else mo.extend
                for e in self.ea[i]:
                    p = int(self.a.src[e])
                    ways += [(self.X[p, j] + step, "X", p, j, e, None), (self.Y[p, j] + mo.open, "Y", p, j, e, None), (self.M[p, j] + mo.match + (0.0 if p == 0 else mo.open), "M", p, j, e, None)]
            else:
                step = mo.end if i in (0, self.a.n) else mo.extend
                for f in self.eb[j]:
                    q = int(self.b.src[f])
                    ways += [(self.Y[i, q] + step, "Y", i, q, None, f), (self.X[i, q] + mo.open, "X", i, q, None, f), (self.M[i, q] + mo.match + (0.0 if q == 0 else mo.open), "M", i, q, None, f)]
            _, mat, i, j, e, f = ways[self._choose([w[0] for w in ways], rng)]
            if e is not None:
                left.add(int(e))
            if f is not None:
                right.add(int(f))
        return steps[::-1], left, right

    @staticmethod
    def _choose(scores: list[float], rng: np.random.Generator | None) -> int:
        s = np.array(scores)
        if rng is None:
            return int(np.flatnonzero(s >= s.max() - 1e-9)[0])
        p = np.exp(s - s.max())
        return int(rng.choice(len(s), p=p / p.sum()))


def reversed_graph(g: Graph) -> Graph:
    """The graph read backwards."""
    last = g.n + 1
    return Graph(g.states[::-1], last - g.dst, last - g.src, g.weight, g.unused, g.age)


def posteriors(a: Graph, b: Graph, model: Model) -> tuple[np.ndarray, float, float]:
    """Probability that sites i and j are paired, for linear or other graphs, and the forward and the backward total.

    The backward pass is written out, since gaps that begin at an end are treated apart from those that end there.
    """
    f = Matrices(a, b, model, total=True)
    n, m, mo = a.n + 1, b.n + 1, model
    fa, fb = [[] for _ in range(n + 1)], [[] for _ in range(m + 1)]
    for e in range(len(a.src)):
        fa[a.src[e]].append(e)
    for e in range(len(b.src)):
        fb[b.src[e]].append(e)
    back = {k: np.full((n, m), NO) for k in "MXY"}
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            out = {"M": NO, "X": NO, "Y": NO}
            for e in fa[i]:
                k = int(a.dst[e])
                for g in fb[j]:
                    h = int(b.dst[g])
                    if k == n and h == m:
                        for s, cost in (("M", mo.match), ("X", 0.0), ("Y", 0.0)):
                            out[s] = np.logaddexp(out[s], cost)
                    elif k < n and h < m:
                        to = f.wa[e] + f.wb[g] + mo.scores[a.states[k - 1], b.states[h - 1]] + back["M"][k, h]
                        for s, cost in (("M", 2 * mo.match), ("X", mo.match), ("Y", mo.match)):
                            out[s] = np.logaddexp(out[s], cost + to)
                if k < n:
                    step = mo.end if j in (0, b.n) else mo.extend
                    to = back["X"][k, j]
                    for s, cost in (("X", step), ("Y", mo.open), ("M", mo.match + (0.0 if i == 0 else mo.open))):
                        out[s] = np.logaddexp(out[s], cost + to)
            for g in fb[j]:
                h = int(b.dst[g])
                if h < m:
                    step = mo.end if i in (0, a.n) else mo.extend
                    to = back["Y"][i, h]
                    for s, cost in (("Y", step), ("X", mo.open), ("M", mo.match + (0.0 if j == 0 else mo.open))):
                        out[s] = np.logaddexp(out[s], cost + to)
            for s in "MXY":
                back[s][i, j] = out[s]
    paired = np.exp(f.M + back["M"] - f.end)
    paired[0, 0] = 0.0
    return paired, float(f.end), float(back["M"][0, 0])


#: The range of logs within a row that numbers can hold without getting lost, and the sites of a stretch that is summed at once.
_RANGE, _STRETCH = 600.0, 64


class _Sums:
    """Sums and products of probabilities for ``chain_posteriors``: as numbers, each row brought to a highest of 1, or as logs."""

    def __init__(self, as_logs: bool) -> None:
        self.as_logs, self.zero = as_logs, NO if as_logs else 0.0
        self.fallen: dict[float, tuple[np.ndarray, np.ndarray]] = {}
        self.add, self.times = (np.logaddexp, np.add) if as_logs else (np.add, np.multiply)

    def of(self, logs):
        return logs if self.as_logs else np.exp(logs)

    def along(self, c: np.ndarray, x: float) -> np.ndarray:
        """z[j] = c[j] + z[j - 1] times x (a log), of each row."""
        k = np.arange(c.shape[1])
        if self.as_logs:
            return np.logaddexp.accumulate(c - k * x, axis=1) + k * x
        out = np.empty_like(c)
        falls, carried = self._falls(x)
        for at in range(0, len(k), _STRETCH):
            part = c[:, at : at + _STRETCH]
            w = part.shape[1]
            np.matmul(part, falls[:w, :w], out=out[:, at : at + w])
            if at:
                out[:, at : at + w] += out[:, at - 1 : at] * carried[:w]
        return out

    def _falls(self, x: float) -> tuple[np.ndarray, np.ndarray]:
        """What each site of a stretch passes on to each later one, and what the site before it does."""
        if x not in self.fallen:
            k = np.arange(_STRETCH)
            d = k - k[:, None]
            self.fallen[x] = np.where(d >= 0, np.exp(np.maximum(d, 0) * x), 0.0), np.exp((k + 1) * x)
        return self.fallen[x]

    def brought_down(self, *rows: np.ndarray) -> np.ndarray:
        """The logs of what rows were divided by, in place."""
        if self.as_logs:
            return np.zeros(len(rows[0]))
        top = np.maximum.reduce([r.max(axis=1) for r in rows])
        for r in rows:
            r /= top[:, None]
        return np.log(top)


def chain_posteriors(a: np.ndarray, b: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``posteriors`` gives, for many pairs of chains of one size at once: rows of ``a`` and ``b`` are the chains' states."""
    (size, n), m, mo = a.shape, b.shape[1], model
    steepest = min(mo.extend, mo.end, 0.0)
    spread = min(n, m) * max(mo.scores.max(), 0.0) - mo.scores.min() - (n + m) * steepest - 4 * (mo.open + mo.match)
    o = _Sums(as_logs=spread > _RANGE)
    add, times = o.add, o.times
    match, twice, opened, step_x = o.of(mo.match), o.of(2 * mo.match), o.of(mo.open), np.full(m + 1, o.of(mo.extend))
    step_x[[0, m]] = o.of(mo.end)
    both_opened = o.of(mo.match + mo.open)
    profile = o.of(mo.scores)[:, b]  # state, pair, site
    pairs = np.arange(size)
    along = lambda i: mo.end if i in (0, n) else mo.extend
    paired, down = np.empty((n + 1, size, m + 1)), np.zeros((n + 1, size))
    M, X, Y = (np.full((size, m + 1), o.zero) for _ in range(3))
    M[:, 0] = o.of(0.0)
    for i in range(n + 1):
        if i:
            best = add(times(M, twice), times(add(X, Y), match))
            X = add(times(X, step_x), add(times(Y, opened), times(M, match if i == 1 else both_opened)))
            M = np.full((size, m + 1), o.zero)
            M[:, 1:] = times(best[:, :-1], profile[a[:, i - 1], pairs])
        base = add(times(X, opened), times(M, both_opened))
        base[:, 0] = add(times(X[:, 0], opened), times(M[:, 0], match))
        Y = np.full((size, m + 1), o.zero)
        Y[:, 1:] = o.along(base[:, :-1], along(i))
        down[i] = o.brought_down(M, X, Y) + (down[i - 1] if i else 0.0)
        paired[i] = M
    end = add(times(M[:, m], match), add(X[:, m], Y[:, m]))
    total = (end if o.as_logs else np.log(end)) + down[n]
    above = np.zeros(size)
    for i in range(n, -1, -1):
        c = np.full((size, m + 1), o.zero)  # what the ways on to the next row give: to M there, and to X
        if i < n:
            c[:, :-1] = times(profile[a[:, i], pairs], M[:, 1:])
            to_x = X
        else:
            to_x = np.full((size, m + 1), o.zero)
        y = add(times(c, match), times(to_x, opened))
        if i == n:
            y[:, m] = o.of(0.0)
        Y = o.along(y[:, ::-1], along(i))[:, ::-1].copy()
        to_y = np.full((size, m + 1), o.zero)
        to_y[:, :-1] = Y[:, 1:]
        gap = times(to_y, both_opened)
        gap[:, 0] = times(to_y[:, 0], match)
        M = add(times(c, twice), add(times(to_x, match if i == 0 else both_opened), gap))
        X = add(times(c, match), add(times(to_x, step_x), times(to_y, opened)))
        if i == n:
            M[:, m], X[:, m] = o.of(mo.match), o.of(0.0)
        above = above + o.brought_down(M, X, Y)
        whole = (down[i] + above - total)[:, None]
        paired[i] = np.exp(paired[i] + M + whole) if o.as_logs else paired[i] * M * np.exp(whole)
    backward = (M[:, 0] if o.as_logs else np.log(M[:, 0])) + above
    paired = paired.transpose(1, 0, 2)
    paired[:, 0, 0] = 0.0
    return paired, total, backward


def on_paths(g: Graph) -> np.ndarray:
    """The sites, both ends included, that some path through the graph leads over."""
    ahead, behind = (np.zeros(g.n + 2, bool) for _ in range(2))
    ahead[0] = behind[-1] = True
    for e in range(len(g.src)):  # sorted by their end
        ahead[g.dst[e]] |= ahead[g.src[e]]
    for e in np.argsort(-g.src, kind="stable"):
        behind[g.src[e]] |= behind[g.dst[e]]
    return np.flatnonzero(ahead & behind)


def compact(g: Graph, sites: np.ndarray) -> tuple[Graph, np.ndarray]:
    """The graph of these sites alone, and the numbers of its edges in the whole one."""
    number = np.full(g.n + 2, -1)
    number[sites] = np.arange(len(sites))
    edges = np.flatnonzero((number[g.src] >= 0) & (number[g.dst] >= 0))
    return Graph(g.states[sites[1:-1] - 1], number[g.src[edges]], number[g.dst[edges]], g.weight[edges]), edges


@dataclass
class Rules:
    """How long an edge that alignments don't use stays open, and what its weight becomes."""

    skip_weight: float = 0.9
    most_unused: int = 10
    most_age: float = 0.5


@dataclass
class Aligned:
    """The graph of a node above two others, and each of its sites' sites below (0: none)."""

    graph: Graph
    left: np.ndarray
    right: np.ndarray
    score: float


def ancestor(a: Graph, b: Graph, t_left: float, t_right: float, model: Model, rules: Rules = Rules(), band=None, alphabet: Alphabet | None = None) -> Aligned:
    """Aligns two graphs and builds their parent's.

    A band holds for the sites that paths lead over. Every site of either child has a place in the parent, also those that the path skips. A parent's state is what the
    paired children's have in common, or else what they may be. Children's edges are inherited: one that the path didn't use
    loses weight the first time, and is dropped after too many unused branches or too long a time, which settles that what it
    led through was an insertion, or that what it skipped was none.
    """
    # Sites that no path leads over any more keep their columns, but take no part.
    sites_a, sites_b = on_paths(a), on_paths(b)
    (small_a, edges_a), (small_b, edges_b) = compact(a, sites_a), compact(b, sites_b)
    found = Matrices(small_a, small_b, model, band=band)
    if not np.isfinite(found.end) and band is not None:
        found = Matrices(small_a, small_b, model)
    if not np.isfinite(found.end):
        raise ValueError("the graphs have no path through them")
    steps, used_left, used_right = found.path()
    steps = [(mat, int(sites_a[i]), int(sites_b[j])) for mat, i, j in steps]
    used_left, used_right = {int(edges_a[e]) for e in used_left}, {int(edges_b[e]) for e in used_right}
    left, right = [], []
    i0 = j0 = 0
    for mat, i, j in steps:
        if mat in "MX":
            left += range(i0 + 1, i)
            right += [0] * (i - i0 - 1)
        if mat in "MY":
            left += [0] * (j - j0 - 1)
            right += range(j0 + 1, j)
        left.append(i if mat in "MX" else 0)
        right.append(j if mat in "MY" else 0)
        i0, j0 = i if mat in "MX" else i0, j if mat in "MY" else j0
    left += [*range(i0 + 1, a.n + 1), *[0] * (b.n - j0)]
    right += [*[0] * (a.n - i0), *range(j0 + 1, b.n + 1)]
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    n = len(left)
    on_left, on_right = left > 0, right > 0
    if alphabet is None:
        lb, rb = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lb[on_left] = _BITS[a.states[left[on_left] - 1]]
        rb[on_right] = _BITS[b.states[right[on_right] - 1]]
        states = _STATE[np.where(lb & rb > 0, lb & rb, lb | rb)]
    else:
        states, both = np.zeros(n, np.int64), on_left & on_right
        states[on_left] = a.states[left[on_left] - 1]
        states[on_right & ~on_left] = b.states[right[on_right & ~on_left] - 1]
        states[both] = alphabet.common(a.states[left[both] - 1], b.states[right[both] - 1])
    edges: dict[tuple[int, int], tuple[float, int, float]] = {}
    for g, to_child, used, t in ((a, left, used_left, t_left), (b, right, used_right, t_right)):
        place = np.zeros(g.n + 2, np.int64)
        place[to_child[to_child > 0]] = np.flatnonzero(to_child > 0) + 1
        place[g.n + 1] = n + 1
        for e in range(len(g.src)):
            key = int(place[g.src[e]]), int(place[g.dst[e]])
            w, unused, age = float(g.weight[e]), int(g.unused[e]), float(g.age[e])
            if e not in used:
                unused, age = unused + 1, age + t
                if unused > rules.most_unused or age > rules.most_age:
                    continue
                if unused == 1:
                    w *= rules.skip_weight
            else:
                unused, age = 0, 0.0
            old = edges.get(key)
            # An edge of both children: the one used more lately, of the higher weight.
            edges[key] = (w, unused, age) if old is None else (max(w, old[0]), min(unused, old[1]), min(age, old[2]))
    keys = sorted(edges)
    values = [edges[k] for k in keys]
    graph = Graph(states, np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([v[0] for v in values]), np.array([v[1] for v in values]), np.array([v[2] for v in values]))
    return Aligned(graph, left, right, float(found.end))


def replayed(x: str, y: str, a: Graph, b: Graph) -> list[tuple[str, int, int]]:
    """The steps (matrix, i, j) of a known alignment of two chains' letters, given as rows; columns that are gaps in both are left out."""
    steps, i, j = [], 0, 0
    for p, q in zip(x, y, strict=True):
        i, j = i + (p != "-"), j + (q != "-")
        if p != "-" or q != "-":
            steps.append(("M" if p != "-" and q != "-" else "X" if p != "-" else "Y", i, j))
    if (i, j) != (a.n, b.n):
        raise ValueError("the rows' letters aren't the graphs' sites")
    return steps


def path_score(steps: list[tuple[str, int, int]], a: Graph, b: Graph, model: Model) -> float:
    """The score of a path through two chains, step by step."""
    total, before = 0.0, "M"
    for mat, i, j in steps:
        first = i + j == 1
        if mat == "M":
            total += (2 if before == "M" else 1) * model.match + model.scores[a.states[i - 1], b.states[j - 1]]
        else:
            at_end = (j in (0, b.n)) if mat == "X" else (i in (0, a.n))
            at_start = (i == 1) if mat == "X" else (j == 1)
            if before == mat and not first:
                total += model.end if at_end else model.extend
            else:
                total += model.open if before != "M" else model.match + (0.0 if at_start else model.open)
        before = mat
    return total + (model.match if before == "M" else 0.0)


def merged_paths(graphs: list[Graph]) -> Graph:
    """The graphs that sampled paths gave over the same sites, as one: every edge once, with its highest weight and least disuse."""
    edges: dict[tuple[int, int], tuple[float, int, float]] = {}
    for g in graphs:
        if not np.array_equal(g.states, graphs[0].states):
            raise ValueError("graphs over other sites")
        for key, *value in zip(zip(g.src.tolist(), g.dst.tolist(), strict=True), g.weight.tolist(), g.unused.tolist(), g.age.tolist(), strict=True):
            old = edges.get(key)
            edges[key] = tuple(value) if old is None else (max(value[0], old[0]), min(value[1], old[1]), min(value[2], old[2]))
    keys = sorted(edges)
    src, dst = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    return Graph(graphs[0].states, src, dst, *(np.array([edges[k][i] for k in keys]) for i in range(3)))


def aligned_rows(x: str, y: str, steps: list[tuple[str, int, int]]) -> tuple[str, str]:
    """Both sequences of two chains as rows of the same length."""
    return "".join(x[i - 1] if mat in "MX" else "-" for mat, i, _ in steps), "".join(y[j - 1] if mat in "MY" else "-" for mat, _, j in steps)


def symmetric(g: Graph) -> bool:
    """Whether every edge leads forward between sites that exist, and none is there twice."""
    inside = (g.src >= 0) & (g.dst <= g.n + 1) & (g.src < g.dst)
    return bool(inside.all()) and len(set(zip(g.src.tolist(), g.dst.tolist(), strict=True))) == len(g.src)


def chain_path(a: np.ndarray, b: np.ndarray, model: Model, band: tuple[list[int], list[int]] | None = None) -> tuple[list[tuple[str, int, int]], float]:
    """The best path of two chains of states and its score, as ``Matrices`` finds it, in a row's memory and three bytes a cell of the band."""
    n, m = len(a), len(b)
    lo, hi = band if band is not None else ([0] * (n + 1), [m] * (n + 1))
    rows = [[np.full(m + 2, NO) for _ in range(3)] for _ in range(2)]  # place 0 stands before the first site
    ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gap_ends = np.full(m + 1, model.extend)
    gap_ends[[0, m]] = model.end
    scores, steps_right = model.scores, np.arange(m + 1)
    sites = b[np.maximum(steps_right - 1, 0)] if m else None
    for i in range(n + 1):
        (M, X, Y), (P, Q, R) = rows[i % 2], rows[1 - i % 2]
        x0, x1 = lo[i], hi[i] + 1
        if i > 1:
            for row in (M, X, Y):
                row[lo[i - 2] + 1 : hi[i - 2] + 2] = NO
        if i:
            top, from_m = _first_best(P[x0:x1] + 2 * model.match, Q[x0:x1] + model.match, R[x0:x1] + model.match)
            # The first column has no site of the right chain.
            M[x0 + 1 : x1 + 1] = top + scores[a[i - 1]][sites[x0:x1]] if m else NO
            if x0 == 0:
                M[1] = NO
            X[x0 + 1 : x1 + 1], from_x = _first_best(Q[x0 + 1 : x1 + 1] + gap_ends[x0:x1], R[x0 + 1 : x1 + 1] + model.open, P[x0 + 1 : x1 + 1] + (model.match + (0.0 if i == 1 else model.open)))
        else:
            M[1] = 0.0
            from_m = from_x = np.zeros(x1 - x0, np.int8)
        x = model.end if i in (0, n) else model.extend
        by_x, by_m = X[x0:x1] + model.open, M[x0:x1] + (model.match + model.open)
        if x0 == 0:
            if x1 > 1:
                by_m[1] = M[1] + model.match
            by_x[0] = by_m[0] = NO
        base = np.maximum(by_x, by_m)
        slope = steps_right[: x1 - x0] * x
        run = np.maximum.accumulate(base - slope) + slope
        Y[x0 + 1 : x1 + 1] = run
        from_y = (by_x < base - 1e-9).astype(np.int8) + 1
        from_y[1:][run[:-1] + x >= base[1:] - 1e-9] = 0
        ways.append((from_m, from_x, from_y))
    M, X, Y = rows[n % 2]
    ends = np.array([M[m + 1] + model.match, X[m + 1], Y[m + 1]])
    if not np.isfinite(ends.max()):
        return [], NO
    at, i, j = int(np.flatnonzero(ends >= ends.max() - 1e-9)[0]), n, m
    steps = []
    # What each number of a matrix's ways leads to: 0, 1 and 2 are M, X and Y.
    leads = ((0, 1, 2), (1, 2, 0), (2, 1, 0))
    while i or j:
        steps.append(("MXY"[at], i, j))
        k = leads[at][int(ways[i][at][j - lo[i]])]
        i, j = i - (at != 2), j - (at != 1)
        at = k
    return steps[::-1], float(ends.max())


#: Bytes that the ways of the pairs aligned together may take, how many pairs are, and how many times their cells may be filled.
_WAY_BYTES, _TOGETHER, _PADDED = 1 << 25, 128, 1.5
# What a cell's ways lead to, by the matrix (M, X, Y, done) and the cell's bits: two for each matrix (the first way isn't as good, the second isn't), whether
# M of the next cell begins the path, and whether a gap here does.
_NEXT = np.array([[3 if at == 3 or c & (64 if at == 0 else 128) else ((0, 1, 2), (1, 2, 0), (2, 1, 0))[at][0 if not c >> 2 * at & 1 else 1 if not c >> 2 * at & 2 else 2] for c in range(256)] for at in range(4)], np.uint8).ravel()


def chain_paths(chains: list[tuple[np.ndarray, np.ndarray]], model: Model) -> list[tuple[np.ndarray, float]]:
    """As ``chain_path``, for many pairs of chains: the matrices of a path's steps (0 for M, 1 for X, 2 for Y) and its score.

    Pairs of about one size are aligned together, by diagonals, on which no cell waits for another. Logs are kept less the cost of going on from the
    start, so that a gap goes on for nothing, and M with the match that follows it, so that all openings cost the same.
    """
    out: list[tuple[np.ndarray, float]] = [None] * len(chains)
    n, m = (np.array([len(c[side]) for c in chains], np.int64) for side in (0, 1))
    order = np.lexsort((m, n // 24, np.minimum(n, m) > 0)).tolist()  # empty ones first
    at = 0
    while at < len(order):
        part: list[int] = []
        wide = high = cells = 0
        while at < len(order) and len(part) < _TOGETHER:
            k = order[at]
            w, h = max(wide, int(m[k])), max(high, int(n[k]))
            if part and ((w + h + 1) * (h + 2) * (len(part) + 1) > _WAY_BYTES or (min(n[k], m[k]) > 0) != (min(n[part[0]], m[part[0]]) > 0) or len(part) > 15 and w * h * (len(part) + 1) > _PADDED * (cells + n[k] * m[k])):
                break
            part, wide, high, cells, at = [*part, k], w, h, cells + int(n[k] * m[k]), at + 1
        if len(part) > 3 and min(n[part[0]], m[part[0]]) > 0:
            found = _paths_together([chains[k] for k in part], model)
        else:
            found = []
            for k in part:
                steps, score = chain_path(*chains[k], model)
                found.append((np.array(["MXY".index(s[0]) for s in steps], np.uint8), score))
        for k, f in zip(part, found, strict=True):
            out[k] = f
    return out


def _paths_together(chains: list[tuple[np.ndarray, np.ndarray]], model: Model) -> list[tuple[np.ndarray, float]]:
    size = len(chains)
    n, m = (np.array([len(c[side]) for c in chains], np.int64) for side in (0, 1))
    N, W = int(n.max()), int(m.max())
    a, b = np.zeros((N, size), np.int64), np.zeros((W, size), np.int64)
    for k, (x, y) in enumerate(chains):
        a[: len(x), k] = x * model.scores.shape[1]
        b[W - len(y) :, k] = y[::-1]
    scores = (model.scores + 2 * model.match - 2 * model.extend).ravel()
    opened, at_end, eps = model.open - model.extend, model.end - model.extend, 1e-9
    edge = model.match + np.arange(-1, max(N, W)) * model.end - np.arange(max(N, W) + 1) * model.extend  # of a gap of each length at the start
    # Row i is the left site, the last one takes what is beyond; T is the best of all three, by the diagonal before and the one before that.
    (M, X, Y, P, Q, R), T = (np.full((N + 2, size), NO) for _ in range(6)), [np.full((N + 2, size), NO) for _ in range(3)]
    ways = np.zeros((N + W + 1, N + 2, size), np.uint8)
    P[0] = T[0][0] = model.match
    ways[0, 0] = 64
    spare, low, got = (np.empty((N + 2, size)) for _ in range(3))
    number, flag = np.empty((N + 2, size), np.int64), np.empty((N + 2, size), bool)
    pairs = np.arange(size)
    ended: dict[int, list[int]] = {}
    for k, d in enumerate((n + m).tolist()):
        ended.setdefault(d, []).append(k)
    total = np.full(size, NO)
    top = np.empty(size, np.uint8)
    for d in range(1, N + W + 1):
        lo, hi = max(1, d - W), min(N, d - 1)
        t, before = T[d % 3], T[(d - 2) % 3]
        way = ways[d]
        if hi >= lo:
            here, back = slice(lo, hi + 1), slice(lo - 1, hi)
            h = hi + 1 - lo
            u, v, w, f, c = spare[:h], low[:h], got[:h], flag[:h], way[here]

            def noted(first: np.ndarray, second: np.ndarray, bit: int, f=f, g=f.view(np.uint8), c=c) -> None:
                """Whether ``first`` isn't as good as ``second``."""
                np.less(first, second, out=f)
                np.multiply(g, bit, out=g)
                np.bitwise_or(c, g, out=c)

            np.add(a[lo - 1 : hi], b[W - d + lo : W - d + hi + 1], out=number[:h])
            scores.take(number[:h], out=w, mode="clip")
            np.add(before[back], w, out=M[here])
            for out, own, other, matched, bit in ((X, Q[back], R[back], P[back], 4), (Y, R[here], Q[here], P[here], 16)):
                np.maximum(other, matched, out=u)
                np.subtract(u, eps, out=v)
                noted(other, v, 2 * bit)
                np.add(v, opened, out=v)
                noted(own, v, bit)
                np.add(u, opened, out=u)
                np.maximum(own, u, out=out[here])
            np.maximum(X[here], Y[here], out=u)
            np.maximum(u, M[here], out=t[here])
            np.subtract(t[here], eps, out=v)
            noted(M[here], v, 1)
            noted(X[here], v, 2)
        if d <= W:
            M[0] = X[0] = NO
            Y[0] = t[0] = edge[d]
            way[0] = 3 | (48 | 128 if d == 1 else 0)
        if d <= N:
            M[d] = Y[d] = NO
            X[d] = t[d] = edge[d]
            way[d] = 1 | (12 | 128 if d == 1 else 0)
        if d in ended:
            k = np.array(ended[d])
            total[k], top[k] = t[n[k], k] + d * model.extend, way[n[k], k]
        X.reshape(-1)[np.minimum(np.maximum(d - m, -1), N + 1) * size + pairs] += at_end
        Y.reshape(-1)[n * size + pairs] += at_end
        M, X, Y, P, Q, R = P, Q, R, M, X, Y
    # All pairs' paths, a step at a time from their ends.
    row, line = size, (N + 2) * size
    move, ahead = np.array([2 * line + row, line + row, line, 0]), np.array([2 * line + row, 0, 0, 0])
    at, place = _NEXT[top & 3], (n + m) * line + n * row + pairs
    flat = ways.reshape(-1)
    steps = np.full((N + W, size), 3, np.uint8)
    for s in range(N + W):
        steps[s] = at
        following = _NEXT.take(at.astype(np.int64) * 256 + flat.take(place - ahead.take(at)))
        place -= move.take(at)
        at = following
    count = (steps < 3).sum(axis=0)
    return [(steps[: count[k], k][::-1].copy(), float(total[k])) for k in range(size)]


def sites_of(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sites of both chains, from 1, that each of a path's steps has come to."""
    return np.cumsum(path != 2), np.cumsum(path != 1)


def chain_score(path: np.ndarray, a: np.ndarray, b: np.ndarray, model: Model) -> float:
    """As ``path_score``, of a path as ``chain_paths`` gives it."""
    (i, j), before = sites_of(path), np.append(0, path[:-1])
    pair, left = path == 0, path == 1
    out = np.zeros(len(path))
    out[pair] = (1 + (before[pair] == 0)) * model.match + model.scores[a[i[pair] - 1], b[j[pair] - 1]]
    at_end = np.where(left, (j == 0) | (j == len(b)), (i == 0) | (i == len(a)))
    at_start = np.where(left, i, j) == 1
    gap = np.where(before == path, np.where(at_end, model.end, model.extend), np.where(before != 0, model.open, model.match + np.where(at_start, 0.0, model.open)))
    out[~pair] = gap[~pair]
    return float(out.sum()) + (model.match if not len(path) or path[-1] == 0 else 0.0)


def _first_best(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of three rows, place by place, and the first of them that is as good."""
    top = np.maximum(np.maximum(first, second), third)
    low = top - 1e-9
    which = (first < low).astype(np.int8)
    which += (first < low) & (second < low)
    return top, which
