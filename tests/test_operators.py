import numpy as np
import pytest

from sedgeline.functions import models as fm
from sedgeline.functions import sequence as fs
from sedgeline.operators import anchors as an
from sedgeline.operators import kernel
from sedgeline.operators import progressive as op
from sedgeline.operators import trees as ot
from sedgeline.operators.alignments import branch_events
from sedgeline.operators.placement import PlacementOptions, banded_pair, numbered_placements, pileup, placements
from sedgeline.plans import column_queries
from sedgeline.sources import formats as sf
from sedgeline.sources import writers as sw


def one(spark, expression, **values):
    from pyspark.sql import functions as F

    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first()["x"]


def test_sequence_functions(spark):
    from pyspark.sql import functions as F

    s = F.col("s")
    assert one(spark, fs.reverse_complement(s), s="ACGTRYKMBVDHN") == "NDHBVKMRYACGT"
    assert one(spark, fs.translate_codons(s), s="ATGAAATAGTG") == "MKXX"
    assert one(spark, fs.translate_codons(s), s="") == ""
    assert one(spark, fs.back_translate(s, F.col("d")), s="M-K", d="ATGAAA") == "ATG---AAA"
    assert one(spark, fs.back_translate(s, F.col("d")), s="-MK", d="ATGA") == "---ATGNNN"
    assert one(spark, fs.translate_degenerate(s), s="GTRACN") == "VT"
    assert one(spark, fs.mask_low_quality(s, F.col("q")), s="ACG", q="!5I") == "nCG"
    assert [one(spark, fs.branch_length(F.lit(x).cast("double"))) for x in (0.0, 0.5, None, -1.0)] == [0.001, 0.2, 0.001, 0.001]


def test_models():
    for pi in ((0.25,) * 4, (0.3, 0.2, 0.2, 0.3), (0.1, 0.4, 0.3, 0.2)):
        for t in (0.01, 0.2, 0.4):
            p = fm.dna_matrix(t, pi)
            assert np.allclose(p.sum(1), 1) and np.allclose(np.array(pi) @ p, pi)
            assert np.allclose(fm.dna_matrix(t / 2, pi) @ fm.dna_matrix(t / 2, pi), p)
    exchange, pi = fm.protein_model()
    p = fm.reversible_matrix(exchange, pi, 0.3)
    assert np.allclose(p.sum(1), 1) and np.allclose(pi[:, None] * p, (pi[:, None] * p).T) and np.allclose(fm.reversible_matrix(exchange, pi, 0.0), np.eye(20))


def test_events(spark):
    rows = spark.createDataFrame([(1, "AC--GT", "A-TTGA"), (2, "AC--GT", "A---GA"), (3, "AAA", "A--")], "k int, p string, c string")
    found = sorted((r["k"], r["kind"], r["first"], r["last"]) for r in branch_events(rows, "k", "p", "c").collect())
    assert found == [(1, "del", 2, 2), (1, "ins", 3, 4), (1, "sub", 6, 6), (2, "del", 2, 4), (2, "sub", 6, 6), (3, "del", 2, 3)]


def test_events_beyond_the_shorter_row(spark, tmp_path):
    from sedgeline.plans.registry import queries

    nodes = [(1, None, "root", None), (2, 1, "a", "left"), (3, 1, "b", "right")]
    spark.createDataFrame(nodes, "node_id int, parent_id int, name string, side string").write.parquet(f"{tmp_path}/tree_node.parquet")
    spark.createDataFrame([("a", "ACG"), ("b", "ACGTT")], "name string, sequence string").write.parquet(f"{tmp_path}/ref_entry.parquet")
    found = queries()["w14_g16_whole_events"](spark, str(tmp_path)).collect()
    assert [(r["kind"], r["first"], r["last"]) for r in found] == [("ins", 4, 5)]


def tree_frame(spark, text):
    rows = sf.tree_rows(sf.binary(sf.parse_newick(text)))
    return spark.createDataFrame(rows, "node_id int, parent_id int, side string, name string, branch_length double, tid string"), rows


def test_newick():
    text = "((a:0.1,'b c':0.2):0.05,(d:0.3[&&NHX:TID=t1],e,f:1e-3):0.1);"
    rows = sf.tree_rows(sf.binary(sf.parse_newick(text)))
    names = {r[3]: r for r in rows}
    assert set(names) == {"a", "b c", "d", "e", "f", "#1#", "#2#", "#3#", "#4#"} and names["d"][5] == "t1" and names["f"][4] == 0.001
    with pytest.raises(ValueError):
        sf.binary(sf.parse_newick("(a,b,c);"))
    with pytest.raises(ValueError):
        sf.parse_newick("((a,b);")
    rooted = sf.midpoint_rooted(sf.parse_newick("(a:1,b:1,c:4);"))
    assert len(rooted.children) == 2 and sorted(c.length for c in rooted.children) == [1.5, 2.5]
    deep = "(" * 3000 + "x" + ",y)" * 3000 + ";"
    assert len(sf.tree_rows(sf.parse_newick(deep))) == 6001


def test_deep_tree(spark):
    tree, rows = tree_frame(spark, "((((((a:1,b:1):1,c:1):1,d:1):1,e:1):1,f:1):1,g:1);")
    pairs = ot.ancestry(tree)
    far = pairs.where("steps = 6").count()
    assert far == 2 and pairs.count() == sum(1 for _ in rows) + sum(depth for depth in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6))
    kept = ot.pruned(tree, pairs, spark.createDataFrame([("a",), ("g",), ("d",)], "name string")).collect()
    assert sorted((r["name"], r["branch_length"]) for r in kept if r["name"] in "agd") == [("a", 3.0), ("d", 1.0), ("g", 1.0)]
    distances = {(r["leaf_a"], r["leaf_b"]): r["distance"] for r in ot.leaf_distances(pairs, ot.leaves(tree)).collect()}
    assert len(distances) == 21 and max(distances.values()) == 7.0


def test_target_candidates(spark, tmp_path):
    from sedgeline.plans.registry import queries

    nodes = [(1, None, "#1#", "t1"), (2, 1, "a", "t1"), (3, 1, "#2#", None), (4, 3, "b", ""), (5, 3, "c", "t2")]
    spark.createDataFrame(nodes, "node_id int, parent_id int, name string, tid string").write.parquet(f"{tmp_path}/tree_node.parquet")
    reads = [("r1", "t1"), ("r1", "t1"), ("r1", "t2"), ("r2", None), ("r3", ""), ("r4", "T1"), (None, "t1")]
    spark.createDataFrame(reads, "name string, tid string").write.parquet(f"{tmp_path}/fasta_entry.parquet")
    names = [n[2] for n in nodes]
    expected = [("r1", "t1", "#1#", "tid"), ("r1", "t1", "a", "tid"), ("r1", "t2", "c", "tid")] + [(q, t, n, "all") for q, t in (("r2", None), ("r3", ""), ("r4", "T1")) for n in names]
    assert sorted(map(str, map(tuple, queries()["j08_read_candidates"](spark, str(tmp_path)).collect()))) == sorted(map(str, expected))
    tree, q = spark.read.parquet(f"{tmp_path}/tree_node.parquet"), spark.createDataFrame([("r1", "t1"), ("r2", None)], "query string, tid string")
    for how, of in (("terminal", "abc"), ("internal", ["#1#", "#2#"]), ("all", names)):
        assert sorted((r["query"], r["target"], r["how"]) for r in ot.target_candidates(q, tree, how).collect()) == sorted((x, n, how) for x in ("r1", "r2") for n in of)
    with pytest.raises(ValueError):
        ot.target_candidates(q, tree, "none")


def test_rows_along_a_tree_in_several_rounds(spark):
    tree, rows = tree_frame(spark, "((((a:0.1,b:0.1):0.1,c:0.1):0.1,d:0.1):0.1,((e:0.1,f:0.1):0.1,g:0.1):0.1);")
    seqs = dict(zip("abcdefg", ["ACGTACGTTT", "ACGTCGTTT", "ACGACGTTT", "ACGTACGTT", "ACGTACGGGGTTT", "ACGTACGGTTT", "CGTACGTTT"], strict=True))
    leaves = spark.createDataFrame([(r[0], seqs[r[3]]) for r in rows if r[3] in seqs], "node_id int, seq string")
    for block in (2, 64):
        nodes = op.progressive_alignment(tree, op.leaf_graphs(leaves), block)
        maps = op.column_maps(nodes)
        found = {r["node_id"]: r["row"] for r in op.alignment_rows(maps, leaves).collect()}
        assert {k: v.replace("-", "") for k, v in found.items()} == {r[0]: seqs[r[3]] for r in rows if r[3] in seqs}
        assert len({len(v) for v in found.values()}) == 1 and all(any(v[i] != "-" for v in found.values()) for i in range(len(next(iter(found.values())))))
        above = op.ancestor_rows(maps, nodes).collect()
        assert len(above) == 6 and {len(r["row"]) for r in above} == {len(v) for v in found.values()}


def test_files(spark, tmp_path):
    (tmp_path / "a.fas").write_text(">x one TID=t9 NumDuplicates=3\r\nac gt\nACG\n>\nAAA\n>y\n\n>x\nA-C\n")
    rows = sf.read_fasta(spark, str(tmp_path / "a.fas")).orderBy("pos").collect()
    assert [(r["name"], r["comment"], r["sequence"], r["tid"], r["num_duplicates"]) for r in rows] == [("x", "one TID=t9 NumDuplicates=3", "ACGTACG", "t9", 3), ("x", "", "A-C", None, 1)]
    assert [r["name"] for r in sf.renamed_duplicates(sf.read_fasta(spark, str(tmp_path / "a.fas"), True), "name", ["pos"]).orderBy("pos").collect()] == ["x", "x.1"]
    (tmp_path / "a.fq").write_text("@r1 c\nACG\n+more\n@I!\n@r2\nA\n+\n@\n")
    rows = sf.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("pos").collect()
    assert [(r["name"], r["comment"], r["sequence"], r["quality"]) for r in rows] == [("r1", "c ; more", "ACG", "@I!"), ("r2", "", "A", "@")]
    (tmp_path / "bad.fq").write_text("@r1\nACG\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        sf.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    named = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, name string")
    assert [r["name"] for r in sw.numbered_duplicates(named, "name", ["pos"]).orderBy("pos").collect()] == ["a/1", "b", "a/2"]


def test_anchor_choices(spark):
    rows = [(1, 0, 0, 30, 60), (1, 10, 10, 10, 20), (1, 50, 5, 20, 40), (1, 80, 80, 10, 20)]
    df = spark.createDataFrame(rows, "k int, start_1 int, start_2 int, length int, score int")
    assert sorted(r["start_1"] for r in an.greedy_non_overlapping(df, ["k"]).collect()) == [0, 80]
    assert sorted(r["start_1"] for r in an.colinear(df, ["k"]).collect()) == [0, 50, 80]
    pairs = spark.createDataFrame([(1, "AACCGGTTAC", "TTCCGGTTCC"), (2, "", "A"), (3, None, "A")], "k int, a string, b string")
    assert [tuple(r) for r in an.shared_substrings(pairs, "k", "a", "b", 4).collect()] == [(1, 2, 2, 6)]
    lo, hi = an.band([(5, 5, 20)], 30, 30, 2)
    assert all(a <= b for a, b in zip(lo, hi)) and lo[0] == 0 and hi[30] == 30 and hi[10] - lo[10] <= 8


def test_kept_anchors(spark, tmp_path):
    from sedgeline.plans.registry import queries

    rng = np.random.default_rng(7)
    parts = ["".join(rng.choice(list("ACGT"), n)) for n in (14, 20, 16, 30)]
    seqs = {"x": "A".join(parts), "y": "C".join([parts[3], parts[0], parts[1][:15], parts[1][4:], parts[2]]), "z": parts[1] + parts[1]}
    spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs.items())], "entry_id long, name string, sequence string").selectExpr("*", "'r' as run", "0L as pos", "'' as comment", "'' as quality", "'' as tid", "1 as num_duplicates").write.parquet(f"{tmp_path}/fasta_entry.parquet")
    rows = [(k, a, b, int(rng.integers(0, 60)), int(rng.integers(0, 60)), 5, int(rng.integers(0, 4))) for k, (a, b) in enumerate([("x", "y")] * 6 + [("x", "z")] * 5)] + [(20, "x", "y", 0, 0, 5, None)]
    spark.createDataFrame(rows, "anchor_id long, seq_1 string, seq_2 string, start_1 int, start_2 int, length int, score int").write.parquet(f"{tmp_path}/anchor.parquet")
    expected = []
    for k, a, b, *_ in rows:
        s, t, runs = seqs[a], seqs[b], []
        for i in range(len(s)):
            for j in range(len(t)):
                if i and j and s[i - 1] == t[j - 1]:
                    continue
                n = 0
                while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
                    n += 1
                if n >= 12:
                    runs.append((-n, i, j))
        kept = []
        for n, i, j in sorted(runs):
            if all((i - n <= p or p + m <= i) and (j - n <= q or q + m <= j) for p, q, m in kept):
                kept.append((i, j, -n))
        assert len(kept) < len(runs)
        expected += [(k, *x) for x in kept]
    assert sorted(map(tuple, queries()["w10_a04_prefix_anchors"](spark, str(tmp_path)).collect())) == sorted(expected)
    expected = []
    for pair in (("x", "y"), ("x", "z")):
        chain = sorted((r for r in rows if r[1:3] == pair and r[6] is not None), key=lambda r: r[3:5])
        while crossing := [i for i in range(len(chain) - 1) if chain[i + 1][4] < chain[i][4]]:
            i = crossing[0]
            del chain[i if chain[i][6] < chain[i + 1][6] else i + 1]
        expected += chain
    assert len(expected) < 11
    assert sorted(map(tuple, queries()["w11_colinear_anchors"](spark, str(tmp_path)).collect())) == sorted(expected)


def test_shared_substrings_meet_within_their_pair(spark):
    """Long repeats, keys that are null or there twice, and letters beyond ASCII, against the query's SQL; no window or meeting is a row."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ACGT"), n))
    core, other = word(40), word(25)
    rows = [(1, "A" * 400, "A" * 300), (2, word(9) + core + "C" + other, other + "G" + core), (3, core, core[:11]), (None, core, core), (4, core + other, other), (4, other, word(5) + core), (4, other, other), (5, None, core), (6, "éü" * 8, "ü" + "éü" * 7), (7, core, other)]
    pairs = spark.createDataFrame(rows, "k long, a string, b string")
    found = an.shared_substrings(pairs, "k", "a", "b", 12)
    assert found.dtypes == [("k", "bigint"), ("start_1", "int"), ("start_2", "int"), ("length", "int")]
    con = duckdb.connect()
    con.execute("CREATE TABLE prs (anchor_id BIGINT, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO prs VALUES (?, ?, ?)", rows)
    tail = column_queries._SHARED[column_queries._SHARED.index("x AS (") :]
    expected = con.execute(f"WITH {tail} SELECT anchor_id, start_1, start_2, length FROM found").fetchall()
    assert {r[0] for r in expected} == {1, 2, 4, 6} and sorted(map(tuple, found.collect())) == sorted(expected)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_prefix_anchors_of_long_repeats(spark, tmp_path):
    """Two records of one letter have as many runs as diagonals and a hundred times as many meetings, none of which is a row."""
    from sedgeline.plans.registry import queries

    rows = [(1, "x", "A" * 900 + "C" + "GT" * 300), (2, "y", "A" * 700 + "T" + "GT" * 200)]
    spark.createDataFrame(rows, "entry_id long, name string, sequence string").selectExpr("*", "'r' as run", "0L as pos", "'' as comment", "'' as quality", "'' as tid", "1 as num_duplicates").write.parquet(f"{tmp_path}/fasta_entry.parquet")
    spark.createDataFrame([(5, "x", "y", 0, 0, 5, 1)], "anchor_id long, seq_1 string, seq_2 string, start_1 int, start_2 int, length int, score int").write.parquet(f"{tmp_path}/anchor.parquet")
    found = queries()["w10_a04_prefix_anchors"](spark, str(tmp_path))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    kept = sorted(map(tuple, found.collect()))
    assert kept[0] == (5, 0, 0, 700) and kept[-1][1] + kept[-1][3] <= 1501
    assert all(b[1] >= a[1] + a[3] for a, b in zip(kept, kept[1:], strict=False)) and sum(k[3] for k in kept) >= 1100


def test_prefix_anchors_are_chosen_where_they_are_found(spark, tmp_path):
    """Repeats, keys that are null or there twice, and pairs without a run, against the query's SQL; a run that isn't kept is no row."""
    duckdb = pytest.importorskip("duckdb")
    from sedgeline.plans.registry import oracle_sql, queries

    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("ACGT"), n))
    core, other = word(40), word(25)
    seqs = ["A" * 60 + "CGT" * 9, "A" * 45, core + "C" + other, other + core[:30] + "G" + core, "GT" * 30 + core, "GT" * 20, word(11), "ACG" * 15 + other]
    rows = [(k, chr(97 + k), s) for k, s in enumerate(seqs)]
    spark.createDataFrame(rows, "entry_id long, name string, sequence string").selectExpr("*", "'r' as run", "0L as pos", "'' as comment", "'' as quality", "'' as tid", "1 as num_duplicates").write.parquet(f"{tmp_path}/fasta_entry.parquet")
    pairs = [(1, "a", "b"), (2, "c", "d"), (3, "e", "f"), (4, "a", "g"), (5, "d", "e"), (5, "c", "h"), (5, "a", "h"), (None, "a", "b"), (6, "d", "d"), (7, "a", "a"), (8, "h", "a"), (9, "a", "none")]
    spark.createDataFrame(pairs, "anchor_id long, seq_1 string, seq_2 string").write.parquet(f"{tmp_path}/anchor.parquet")
    found = queries()["w10_a04_prefix_anchors"](spark, str(tmp_path))
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for t in ("fasta_entry", "anchor"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "anchor_id, start_1, start_2, length"
    expected = con.execute(f"SELECT {columns} FROM ({oracle_sql()['w10_a04_prefix_anchors']})").fetchall()
    assert {r[0] for r in expected} == {1, 2, 3, 5, 6, 7} and sorted(map(tuple, found.select(*columns.split(", ")).collect())) == sorted(expected)
    assert found.count() < queries()["j10_shared_substrings"](spark, str(tmp_path)).count() / 3


def test_band_keeps_the_best_path():
    x, y = "ACGTTGCAACGGTATTACGACGGATCCA", "ACGTTGCACGGTATTACGACGATCCA"
    model = kernel.model_at(0.1)
    assert banded_pair(x, y, [(0, 0, 8), (12, 11, 8)], model, 6).end == pytest.approx(kernel.Matrices(kernel.linear(x), kernel.linear(y), model).end)


def test_placement(spark):
    hits = spark.createDataFrame([("q", "a", 50, 0, 9, 0, 9, "+", "+"), ("q", "b", 50, 0, 9, 0, 9, "+", "+"), ("q", "c", 10, 0, 9, 0, 9, "+", "+"), ("r", "a", 9, 0, 9, 0, 9, "-", "+"), ("x", "a", 9, 0, 1, 0, 1, "+", "+"), (None, "a", 9, 0, 1, 0, 1, "+", "+")], "query string, node string, score int, q_start int, q_end int, t_start int, t_end int, q_strand string, t_strand string")
    targets = spark.createDataFrame([("a", "ACGGTTACGA"), ("b", "ACGGTTACGC"), ("c", "TTTTTTTTTT")], "name string, seq string")
    queries = spark.createDataFrame([("q", "ACGGTTACGA"), ("r", "TCGTAACCGT"), ("x", "CCCCCCCCCC")], "name string, seq string")
    found = {r["query"]: r for r in placements(hits, queries, targets, PlacementOptions(aligned=2)).collect()}
    assert found["q"]["node"] == "a" and found["q"]["identity"] == 1.0 and found["q"]["verdict"] == "placed"
    assert found["r"]["reversed"] and found["r"]["verdict"] == "placed" and found["x"]["verdict"] == "discarded"
    assert numbered_placements(spark.createDataFrame([("q", "b"), ("q", "a")], "query string, node string")).orderBy("node").first()["label"] == "q"


def test_hits_on_nodes_without_letters_take_no_place(spark):
    inner = [("q", f"#{k}#", 90 + k, 0, 9, 0, 9, "+", "+") for k in range(12)] + [("q", "empty", 99, 0, 9, 0, 9, "+", "+"), ("q", "null", 99, 0, 9, 0, 9, "+", "+")]
    leaves = [("q", "b", 50, 0, 9, 0, 9, "+", "+"), ("q", "a", 40, 0, 9, 0, 9, "+", "+"), ("only", "#1#", 40, 0, 9, 0, 9, "+", "+")]
    hits = spark.createDataFrame(inner + leaves, "query string, node string, score int, q_start int, q_end int, t_start int, t_end int, q_strand string, t_strand string")
    targets = spark.createDataFrame([("a", "ACGGTTACGA"), ("b", "ACGGTTACGC"), ("empty", ""), ("null", None)], "name string, seq string")
    queries = spark.createDataFrame([("q", "ACGGTTACGA"), ("only", "ACGGTTACGA")], "name string, seq string")
    assert [(r["query"], r["node"], r["verdict"]) for r in placements(hits, queries, targets).collect()] == [("q", "a", "placed")]


def test_placements_align_together(spark):
    """Pairs are aligned many at a time, with the results of one at a time: sizes that differ, turned queries, letters that are no bases, and a pair too long for the whole matrix."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACGTRN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.02, 0.02]))
    targets = [(f"t{k}", word(int(rng.integers(1, 120)))) for k in range(12)] + [("long", word(1200))]
    queries = [(f"q{k}", ("EFZ" if k % 5 == 0 else "") + targets[k % 13][1][3:] + word(int(rng.integers(1, 40)))) for k in range(40)]
    hit = [(q, t, int(rng.integers(1, 99)), 0, 9, 0, 9, "+", "+-"[k % 2]) for k, (q, _) in enumerate(queries) for t in {targets[k % 13][0], targets[3 * k % 12][0]}]
    hits = spark.createDataFrame(hit, "query string, node string, score int, q_start int, q_end int, t_start int, t_end int, q_strand string, t_strand string")
    names = "name string, seq string"
    found = placements(hits, spark.createDataFrame(queries, names), spark.createDataFrame(targets, names)).coalesce(1).collect()
    q, t, model = dict(queries), dict(targets), kernel.model_at(0.101)
    turned = lambda s: s.translate(str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD"))[::-1]
    best = {}
    for query, node, *_, there in hit:
        x, y = turned(q[query]) if there == "-" else q[query], t[node]
        on = [(i, j) for mat, i, j in an.aligned(x, y, model)[0] if mat == "M"]
        a, b = kernel.linear(x).states, kernel.linear(y).states
        score = sum(model.scores[a[i - 1], b[j - 1]] for i, j in on)
        same = sum(x[i - 1] == y[j - 1] for i, j in on)
        best.setdefault(query, []).append((round(score / model.scores[a, a].sum(), 9), node, round(score, 6), len(on) / len(x), same / max(len(on), 1)))
    expected = {(k, r[1]): r for k, v in best.items() for r in v if r[0] == max(v)[0]}
    assert {(r["query"], r["node"]) for r in found} == set(expected)
    for r in found:
        assert (r["normalised"], r["score"], r["overlap"], r["identity"]) == pytest.approx((expected[r["query"], r["node"]][0], *expected[r["query"], r["node"]][2:]), abs=1e-6)


def test_pileup(spark):
    reads = spark.createDataFrame([(1, 0, "ACGGTTACGATTACC"), (1, 1, "ACGGTACGATTACC"), (1, 2, "GGTAATCGTAACCGT"), (1, 3, "CCCCCCCCCCCC"), (2, 0, "AC"), (None, 1, "AC")], "g int, o int, s string")
    rows = {(r["g"], r["o"]): r for r in pileup(reads, "g", "o", "s").collect()}
    assert rows[1, 1]["used"] and rows[1, 2]["used"] and not rows[1, 3]["used"] and rows[1, 1]["row"].replace("-", "") == "ACGGTACGATTACC"
    assert len({len(r["row"]) for r in rows.values() if r["g"] == 1 and r["used"]}) == 1 and rows[2, 0]["row"] == "AC"
