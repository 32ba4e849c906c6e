import itertools

import numpy as np

from sedgeline.functions.models import dna_matrix
from sedgeline.operators.ancestors import _neighbour_joining, distant_leaves, guide_trees, likelihood_rows, parsimony_rows

TREE = [(1, 1, None, None), (1, 2, 1, 0.1), (1, 3, 1, 0.2), (1, 4, 2, 0.1), (1, 5, 2, 0.05)]


def frames(spark, rows):
    return spark.createDataFrame(TREE, "tree int, node_id int, parent_id int, branch_length double"), spark.createDataFrame(rows, "node_id int, row string")


def test_parsimony(spark):
    tree, rows = frames(spark, [(3, "AC-G"), (4, "RCA"), (5, "CCAT")])
    found = {r["node_id"]: r["row"] for r in parsimony_rows(tree, rows).collect()}
    assert found == {1: "ACAK", 2: "ACAT"}


def test_likelihood(spark):
    tree, rows = frames(spark, [(3, "AGA"), (4, "AGC"), (5, "ATC")])
    found = {r["node_id"]: r["row"] for r in likelihood_rows(tree, rows).collect()}
    pi, lengths = np.full(4, 0.25), {n: t for _, n, _, t in TREE}
    for i, column in enumerate(zip("AGA", "AGC", "ATC", strict=True)):
        p = {n: dna_matrix(lengths[n], (0.25,) * 4) for n in (2, 3, 4, 5)}
        c, a, b = ("ACGT".index(x) for x in column)
        root = [sum(pi[x] * p[3][x, c] * p[2][x, y] * p[4][y, a] * p[5][y, b] for y in range(4)) for x in range(4)]
        assert "ACGT"[int(np.argmax(root))] == found[1][i]
        x = int(np.argmax(root))
        assert "ACGT"[int(np.argmax([p[2][x, y] * p[4][y, a] * p[5][y, b] for y in range(4)]))] == found[2][i]


def test_neighbour_joining_recovers_additive_distances():
    d = np.array([[0, 3, 7, 8], [3, 0, 8, 9], [7, 8, 0, 9], [8, 9, 9, 0]], float)
    rows = {r[0]: r for r in _neighbour_joining(list("abcd"), d)}

    def up(n):
        out = {n: 0.0}
        total = 0.0
        while rows[n][1] is not None:
            total += rows[n][3]
            n = rows[n][1]
            out[n] = total
        return out

    for i, j in itertools.combinations(range(1, 5), 2):
        a, b = up(i), up(j)
        assert min(a[k] + b[k] for k in a if k in b) == d[i - 1, j - 1]


def test_guide_trees_and_distant_leaves(spark):
    seqs = spark.createDataFrame([("g", 1, "ACGTACGTAA"), ("g", 2, "ACGTACGTAC"), ("g", 3, "TTTTGGGGTT"), ("h", 4, "ACGT"), (None, 5, "A")], "g string, n int, s string")
    rows = guide_trees(seqs, "g", "n", "s").collect()
    assert sorted(r["g"] for r in rows) == ["g"] * 5 + ["h"]
    d = spark.createDataFrame([(1, 2, 1.0), (1, 3, 5.0), (2, 3, 4.5), (1, 4, 2.0), (2, 4, 2.0), (3, 4, 3.0)], "leaf_a int, leaf_b int, distance double")
    assert distant_leaves(d, 3) == [1, 3, 4] and distant_leaves(d, 9) == [1, 2, 3, 4] and distant_leaves(d.limit(0), 2) == []
