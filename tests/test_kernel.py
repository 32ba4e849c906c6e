import itertools

import numpy as np
import pytest

from sedgeline.operators import kernel as k

MODEL = k.model_at(0.2)


def brute(a, b, model):
    """All paths of two small graphs: the best score and the sum, by enumeration."""
    best, total = -np.inf, -np.inf
    into_a = {i: [e for e in range(len(a.src)) if a.dst[e] == i] for i in range(a.n + 2)}
    into_b = {j: [e for e in range(len(b.src)) if b.dst[e] == j] for j in range(b.n + 2)}

    def walk(mat, i, j, score):
        nonlocal best, total
        if (mat, i, j) == ("M", 0, 0):
            best, total = max(best, score), np.logaddexp(total, score)
            return
        if mat == "M":
            if not i or not j:
                return
            s = score + model.scores[a.states[i - 1], b.states[j - 1]]
            for e, f in itertools.product(into_a[i], into_b[j]):
                w = 0.5 * np.log(a.weight[e]) + 0.5 * np.log(b.weight[f])
                for m, c in (("M", 2 * model.match), ("X", model.match), ("Y", model.match)):
                    walk(m, a.src[e], b.src[f], s + w + c)
        elif mat == "X":
            for e in into_a[i] if i else []:
                p = a.src[e]
                walk("X", p, j, score + (model.end if j in (0, b.n) else model.extend))
                walk("Y", p, j, score + model.open)
                walk("M", p, j, score + model.match + (0 if p == 0 else model.open))
        else:
            for f in into_b[j] if j else []:
                q = b.src[f]
                walk("Y", i, q, score + (model.end if i in (0, a.n) else model.extend))
                walk("X", i, q, score + model.open)
                walk("M", i, q, score + model.match + (0 if q == 0 else model.open))

    for e, f in itertools.product(into_a[a.n + 1], into_b[b.n + 1]):
        for m, c in (("M", model.match), ("X", 0.0), ("Y", 0.0)):
            walk(m, a.src[e], b.src[f], c)
    return best, total


def graphs():
    rng = np.random.default_rng(3)
    for _ in range(25):
        make = lambda: "".join(rng.choice(list("ACGTN"), rng.integers(1, 5)))
        x, y = make(), make()
        skip = lambda s: [(i, i + 2, 0.5) for i in range(len(s)) if rng.random() < 0.5]
        yield k.with_edges(x, skip(x)), k.with_edges(y, skip(y))


def test_all_paths():
    for a, b in graphs():
        best, total = brute(a, b, MODEL)
        assert k.Matrices(a, b, MODEL).end == pytest.approx(best, abs=1e-9)
        assert k.Matrices(a, b, MODEL, total=True).end == pytest.approx(total, abs=1e-9)


def test_posteriors():
    for a, b in graphs():
        paired, forward, backward = k.posteriors(a, b, MODEL)
        assert forward == pytest.approx(backward, abs=1e-9)
        assert (paired.sum(0) < 1 + 1e-9).all() and (paired.sum(1) < 1 + 1e-9).all()


def test_identical_and_symmetric():
    s = "ACGTTGCAACGGTATTACG"
    steps, _, _ = k.Matrices(k.linear(s), k.linear(s), MODEL).path()
    assert k.aligned_rows(s, s, steps) == (s, s)
    t = "ACGTTGCACGGTATTAC"
    assert k.Matrices(k.linear(s), k.linear(t), MODEL).end == pytest.approx(k.Matrices(k.linear(t), k.linear(s), MODEL).end)
    rows = k.aligned_rows(s, t, k.Matrices(k.linear(s), k.linear(t), MODEL).path()[0])
    assert len(rows[0]) == len(rows[1]) and rows[0].replace("-", "") == s and rows[1].replace("-", "") == t


def test_band_and_sampling():
    s, t = "ACGTTGCAACGGTATTACG", "ACGTTGCACGGTATTAC"
    full = k.Matrices(k.linear(s), k.linear(t), MODEL)
    wide = np.zeros(len(s) + 1, int), np.full(len(s) + 1, len(t))
    assert k.Matrices(k.linear(s), k.linear(t), MODEL, band=wide).end == pytest.approx(full.end)
    rng = np.random.default_rng(1)
    forward = k.Matrices(k.linear(s), k.linear(t), MODEL, total=True)
    drawn = [forward.path(rng)[0] for _ in range(50)]
    assert all(k.aligned_rows(s, t, d)[0].replace("-", "") == s for d in drawn)
    assert sum(d == full.path()[0] for d in drawn) > 1


def test_ancestors_keep_all_sites_and_edges_hold():
    x = k.ancestor(k.linear("ACGTACGTTT"), k.linear("ACGTTTT"), 0.1, 0.1, MODEL)
    assert sorted(x.left[x.left > 0]) == list(range(1, 11)) and sorted(x.right[x.right > 0]) == list(range(1, 8))
    assert k.symmetric(x.graph)
    # The skipped stretch may be an insertion or a deletion: both ways through stay open.
    assert any(d - s > 1 for s, d in zip(x.graph.src, x.graph.dst))
    y = k.ancestor(x.graph, k.linear("ACGTTTT"), 0.1, 0.1, MODEL)
    assert sorted(y.left[y.left > 0]) == list(range(1, x.graph.n + 1)) and k.symmetric(y.graph)


def test_unused_edges_are_dropped():
    g = k.ancestor(k.linear("ACGTACGTTT"), k.linear("ACGTTTT"), 0.1, 0.1, MODEL)
    for _ in range(8):
        g = k.ancestor(g.graph, k.linear("ACGTTTT"), 0.1, 0.1, MODEL)
    inserted = {int(d) for s, d in zip(g.graph.src, g.graph.dst)}
    assert len(inserted) < g.graph.n + 1


def test_empty_sequences():
    end = k.Matrices(k.linear(""), k.linear("ACG"), MODEL)
    assert [m for m, _, _ in end.path()[0]] == ["Y", "Y", "Y"]
    assert k.Matrices(k.linear(""), k.linear(""), MODEL).path()[0] == []


@pytest.mark.parametrize("n, m, spread", [(1, 1, 1e9), (1, 9, 1e9), (7, 5, 1e9), (7, 5, 0), (70, 66, 1e9), (70, 66, 0)])
def test_posteriors_of_many_chains(monkeypatch, n, m, spread):
    """As the passes of one pair give them, as numbers and as logs."""
    monkeypatch.setattr(k, "_RANGE", spread)
    rng = np.random.default_rng(n + m)
    a, b = (rng.integers(0, 15, (4, size)) for size in (n, m))
    b[0, : min(n, m)] = a[0, : min(n, m)]
    paired, forward, backward = k.chain_posteriors(a, b, MODEL)
    for row in range(2 if n > 9 else 4):
        x, y = (k.linear("".join("ACGTRYMKWSBDHVN"[c] for c in v[row])) for v in (a, b))
        x.states, y.states = a[row], b[row]
        p, ahead, back = k.posteriors(x, y, MODEL)
        assert paired[row] == pytest.approx(p, abs=1e-9) and (forward[row], backward[row]) == pytest.approx((ahead, back), abs=1e-8)


def test_posteriors_of_long_chains_keep_their_totals():
    """Sizes beyond what a row of numbers can hold, which took a Python step a cell."""
    rng = np.random.default_rng(2)
    for n, m in ((3, 4000), (900, 800)):
        paired, forward, backward = k.chain_posteriors(rng.integers(0, 4, (1, n)), rng.integers(0, 4, (1, m)), MODEL)
        assert np.isfinite(forward).all() and forward == pytest.approx(backward, abs=1e-6) and paired.sum(axis=2).max() < 1 + 1e-6


def test_paths_of_many_chains(monkeypatch):
    """The paths and scores of single pairs, whatever the sizes that are aligned together, for random and for related chains and for ties."""
    rng = np.random.default_rng(11)
    alone = k.chain_path
    chains = []
    for size in [0, 1, 1, 2, 3, 5, 8, 13, 40, 41, 60, 90] * 6:
        a = rng.integers(0, rng.choice([2, 4, 15]), size)
        keep = rng.random(size) < 0.9
        b = np.insert(a[keep], rng.integers(0, keep.sum() + 1), rng.integers(0, 4, rng.integers(0, 9))) if rng.random() < 0.5 else rng.integers(0, 4, rng.integers(0, 90))
        chains += [(a, b), (b, a)]
    expected = [alone(a, b, MODEL) for a, b in chains]
    calls = []
    monkeypatch.setattr(k, "chain_path", lambda *x: calls.append(1) or alone(*x))
    found = k.chain_paths(chains, MODEL)
    assert len(calls) < len(chains) / 2
    for (a, b), (path, score), (steps, best) in zip(chains, found, expected, strict=True):
        i, j = k.sites_of(path)
        assert [("MXY"[p], x, y) for p, x, y in zip(path, i, j, strict=True)] == steps and score == pytest.approx(best, abs=1e-9)
        if steps:
            x, y = k.linear(""), k.linear("")
            x.states, y.states = a, b
            assert k.chain_score(path, a, b, MODEL) == pytest.approx(k.path_score(steps, x, y, MODEL), abs=1e-9) == pytest.approx(score, abs=1e-8)
