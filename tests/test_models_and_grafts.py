import itertools
import random

import numpy as np
import pytest

from sedgeline.functions import models as fm
from sedgeline.operators import anchors as an
from sedgeline.operators import grafting as og
from sedgeline.operators import kernel
from sedgeline.operators import placement as pl
from sedgeline.sources import formats as sf


def some(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(n)))


def test_chains_in_rows_are_the_matrices_best_paths():
    rng, model = random.Random(1), kernel.model_at(0.2)
    for _ in range(150):
        x = some(rng, "ACGTN", 20)
        y = rng.choice([x[rng.randrange(5) :], some(rng, "ACGT", 20)])
        a, b = kernel.linear(x), kernel.linear(y)
        full = kernel.Matrices(a, b, model)
        steps, score = kernel.chain_path(a.states, b.states, model)
        assert score == pytest.approx(full.end) and steps == [(m, int(i), int(j)) for m, i, j in full.path()[0]]
        assert kernel.replayed(*kernel.aligned_rows(x, y, steps), a, b) == steps
        assert kernel.path_score(steps, a, b, model) == pytest.approx(score)
    with pytest.raises(ValueError):
        kernel.replayed("A-", "-C", kernel.linear("AA"), kernel.linear("C"))


def test_long_chains_are_aligned_in_their_tunnel():
    rng, model = random.Random(2), kernel.model_at(0.2)
    x = "".join(rng.choice("ACGT") for _ in range(3000))
    y = x[:700] + x[760:2000] + "ACG" * 20 + x[2000:]
    assert an.tunnel(x, y) is not None
    steps, score = an.aligned(x, y, model)
    whole = kernel.chain_path(kernel.linear(x).states, kernel.linear(y).states, model)
    assert score == pytest.approx(whole[1])
    other = "".join(rng.choice("ACGT") for _ in range(3000))
    assert an.unique_anchors(x, other) == [] and len(an.aligned(x, other, model)[0]) >= 3000


def test_largest_blocks_are_led_around_by_gaps():
    lo, hi = an.band([(40, 40, 5)], 100, 100, 2, limit=0)
    cells = sum(b - a + 1 for a, b in zip(lo, hi))  # noqa: B905
    free = sum(b - a + 1 for a, b in zip(*an.band([(40, 40, 5)], 100, 100, 2)))  # noqa: B905
    assert cells < free / 4 and lo[0] == 0 and hi[-1] == 100
    assert np.isfinite(kernel.chain_path(kernel.linear("A" * 100).states, kernel.linear("A" * 100).states, kernel.model_at(0.2), (lo, hi))[1])


@pytest.mark.parametrize("alphabet,letters", [(fm.PROTEIN, "ARNDX"), (fm.codon_alphabet(), None)])
def test_other_alphabets_against_all_paths(alphabet, letters):
    rng, model = random.Random(3), kernel.alphabet_model(alphabet, 0.3)
    for _ in range(12):
        make = lambda: some(rng, letters, 5) if letters else "".join(rng.choice(["ATG", "ATA", "TTT", "GGG"]) for _ in range(rng.randrange(4)))
        a, b = kernel.linear(make(), alphabet), kernel.linear(make(), alphabet)
        best = float("-inf")
        for kinds in itertools.product("MXY", repeat=a.n + b.n) if a.n + b.n else [()]:
            i = j = 0
            steps = []
            for k in kinds:
                i, j = i + (k != "Y"), j + (k != "X")
                steps.append((k, i, j))
                if (i, j) == (a.n, b.n) or i > a.n or j > b.n:
                    break
            if (i, j) == (a.n, b.n):
                best = max(best, kernel.path_score(steps, a, b, model))
        assert kernel.Matrices(a, b, model).end == pytest.approx(best)


def test_states_of_pairs():
    p = fm.PROTEIN
    of = lambda x: p.number[x]
    both = p.common(np.array([of("A")]), np.array([of("R")]))
    assert {int(p.first[both][0]), int(p.second[both][0])} == {of("A"), of("R")}
    assert p.common(both, np.array([of("R")]))[0] == of("R") and p.common(both, np.array([p.anything]))[0] == both[0]
    assert p.below(both, np.array([of("N")]))[0] == of("N") and p.below(both, np.array([of("A")]))[0] == of("A")
    assert p.tokens[int(p.likely(both)[0])] == "A"  # the more frequent one
    node = kernel.ancestor(kernel.linear("MAW", p), kernel.linear("MRW", p), 0.1, 0.1, kernel.alphabet_model(p, 0.2), alphabet=p).graph
    assert node.states.tolist() == [of("M"), both[0], of("W")]
    exchange, pi = fm.read_exchange("1 2 3 0.2 0.3 0.5")
    assert exchange.tolist() == [[0, 1, 2], [1, 0, 3], [2, 3, 0]] and pi.tolist() == [0.2, 0.3, 0.5]


def test_sampled_paths_are_one_graph():
    g = kernel.linear("ACG")
    h = kernel.Graph(g.states, np.array([0, 1, 3]), np.array([1, 3, 4]), np.array([1.0, 0.5, 1.0]))
    merged = kernel.merged_paths([g, h])
    assert sorted(zip(merged.src, merged.dst)) == [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)] and kernel.symmetric(merged)  # noqa: B905
    with pytest.raises(ValueError):
        kernel.merged_paths([g, kernel.linear("AAA")])


def test_grafts(spark):
    rows = spark.createDataFrame([(1, "a", "AC-GT"), (1, "b", "ACTGT"), (2, "c", "")], "alignment int, name string, row string")
    placed = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "nowhere"), ("q4", "b")], "query string, node string")
    queries = spark.createDataFrame([("q1", "ACGT"), ("q2", "ACTTTGT"), ("q3", "A"), ("q4", "")], "name string, seq string")
    found = {r["name"]: r["row"] for r in og.grafted_rows(rows, og.grafted_cells(rows, placed, queries)).collect()}
    assert set(found) == {"a", "b", "q1", "q2"} and len({len(r) for r in found.values()}) == 1
    assert {n: r.replace("-", "") for n, r in found.items()} == {"a": "ACGT", "b": "ACTGT", "q1": "ACGT", "q2": "ACTTTGT"}
    assert found["q1"] == found["a"]  # the same letters in the same columns
    empty = og.grafted_rows(rows, og.grafted_cells(rows, placed.limit(0), queries))
    assert {r["name"]: r["row"] for r in empty.collect()} == {"a": "AC-GT", "b": "ACTGT"}


def test_one_by_one_sees_what_was_placed(spark):
    rng = random.Random(5)
    s, t = ("".join(rng.choice("ACGT") for _ in range(80)) for _ in range(2))
    reads = spark.createDataFrame([(1, 1, "r1", s[:70]), (1, 2, "r2", s[:69]), (1, 3, "far", t), (None, 1, "x", s), (1, 4, None, s)], "g int, o int, name string, seq string")
    targets = spark.createDataFrame([(1, "t", s)], "g int, name string, seq string")
    found = {r["name"]: (r["node"], r["verdict"]) for r in og.one_by_one(reads, "g", "o", "name", "seq", targets).collect()}
    assert found["r1"] == ("t", "placed") and found["r2"][1] == "placed" and found["far"][1] == "discarded" and len(found) == 3
    assert pl.placement_mode(pileup=True) == "pileup" and pl.placement_mode(fragments=True, find_orfs=True) == "fragments-orf"


def test_further_inputs(spark):
    lines = spark.createDataFrame([("vulgar: q 0 9 + t 5 14 - 33 M 4 4 G 0 1 M 5 5",), ("nothing",), (None,)], "line string")
    hit = sf.parse_gapped_hits(lines, "line").collect()[0]
    assert hit["score"] == 33 and [tuple(o) for o in hit["ops"]] == [("M", 4, 4), ("G", 0, 1), ("M", 5, 5)]
    segments = spark.createDataFrame([("a\tb\t3\t7\t9\t5\t12",), ("#",)], "line string")
    assert [tuple(r) for r in sf.parse_segments(segments, "line").collect()] == [("a", "b", 2, 4, 5, 12, True, False)]
    text = spark.createDataFrame([(" 2 6\nx  ACG\nTTT\n\ny GGG\n AAA\n\n",), ("no file",)], "text string")
    assert {tuple(r) for r in sf.parse_relaxed_phylip(text, "text").collect()} == {("#x#", "ACGTTT"), ("#y#", "GGGAAA")}
