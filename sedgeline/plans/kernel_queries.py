"""The kernel's parts on whole tables: known alignments, tunnels, sampled paths, graphs with further edges, and the trees' own parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.config import Options
from sedgeline.functions import sequence as fs
from sedgeline.operators import anchors as an
from sedgeline.operators import ancestors as oc
from sedgeline.operators import kernel
from sedgeline.operators import progressive as op
from sedgeline.operators import trees as ot
from sedgeline.operators.placement import candidates
from sedgeline.plans.alignment_queries import _FAMILIES, _PAIR_SQL, _pairs, families
from sedgeline.plans.column_queries import _WHOLE
from sedgeline.plans.model_queries import _sibling_columns, _sibling_sql
from sedgeline.plans.relational_queries import _MERGED, _UP
from sedgeline.plans.scalar_queries import f15_flow_skip_edges, f16_homopolymer_skip_edges
from sedgeline.plans.tables import RECORDS, REFERENCES, hits, records, references, tree
from sedgeline.sources import formats as sf
from sedgeline.workspace import stored

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sibling_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows p and c of sibling leaves, of one width, with gaps put into both."""
    t, r = tree(spark, d), references(spark, d).select("name", "seq")
    side = lambda s, c: t.where(F.col("side") == s).select(F.col("parent_id").alias("node_id"), "name").join(r, "name").select("node_id", F.col("seq").alias(c))
    both = side("left", "a").join(side("right", "b"), "node_id").withColumn("n", F.greatest(F.length("a"), F.length("b")))
    return both.select("node_id", F.regexp_replace(F.expr("rpad(a, n, '-')"), "(.{5})..", "$1--").alias("p"), F.regexp_replace(F.expr("rpad(b, n, '-')"), "(.{8})...", "$1---").alias("c"))


@query(f"WITH {_WHOLE} SELECT node_id, count(*) FILTER (p <> '-' AND c <> '-') AS paired, count(*) FILTER (p <> '-' AND c = '-') AS left_only, count(*) FILTER (p = '-' AND c <> '-') AS right_only, true AS no_better_than_best FROM cells GROUP BY node_id")
def a18_known_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Given rows replayed as paths of the kernel: steps of each kind, and a score that the best path isn't below."""
    rows = _sibling_rows(spark, d)

    def replay(frames):
        model = kernel.model_at(0.2)
        for frame in frames:
            out = []
            for node, p, c in frame.itertuples(index=False):
                x, y = p.replace("-", ""), c.replace("-", "")
                a, b = kernel.linear(x), kernel.linear(y)
                steps = kernel.replayed(p, c, a, b)
                best = an.aligned(x, y, model)[1]
                out.append((node, *(sum(m == k for m, _, _ in steps) for k in "MXY"), kernel.path_score(steps, a, b, model) <= best + 1e-6))
            yield pd.DataFrame(out, columns=["node_id", "paired", "left_only", "right_only", "no_better_than_best"])

    return rows.repartition(op._places(rows)).mapInPandas(replay, "node_id int, paired long, left_only long, right_only long, no_better_than_best boolean")


@query(_PAIR_SQL.replace("SELECT anchor_id, a.seq AS ungapped_a, b.seq AS ungapped_b, true AS same_width, true AS best_score", "SELECT anchor_id, CAST(length(a.seq) + 1 AS BIGINT) AS rows, true AS connected, true AS anchored, true AS within"))
def a01_a06_tunnels(spark: SparkSession, d: str) -> DataFrame:
    """The band around the substrings that each anchor's two records share: a row's sites for each site; what must hold of it."""
    pairs = _pairs(spark, d).select("anchor_id", "a", "b")

    def bands(frames):
        for frame in frames:
            out = []
            for key, x, y in frame.itertuples(index=False):
                found = an.unique_anchors(x, y, 12)
                lo, hi = an.band(found, len(x), len(y), 5, 10_000)
                connected = lo[0] == 0 and hi[-1] == len(y) and all(b >= a and c <= e + 1 for a, b, c, e in zip(lo, hi, lo[1:], hi))  # noqa: B905
                anchored = all(lo[i + k] <= j + k <= hi[i + k] for i, j, n in found for k in range(n))
                out.append((key, len(lo), connected, anchored, all(0 <= a and b <= len(y) for a, b in zip(lo, hi, strict=True))))
            yield pd.DataFrame(out, columns=["anchor_id", "rows", "connected", "anchored", "within"])

    return pairs.repartition(op._places(pairs)).mapInPandas(bands, "anchor_id long, rows long, connected boolean, anchored boolean, within boolean")


@query(f"WITH {_WHOLE} SELECT node_id, count(*) FILTER (p <> '-') AS left_sites, true AS best_kept, true AS forward, true AS not_above_best FROM cells GROUP BY node_id")
def a12_a13_sampled_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths drawn by their probability, besides the best one, and their edges as one graph: it has the best one's edges, all of them lead forward."""
    rows = _sibling_rows(spark, d)

    def sample(frames):
        model = kernel.model_at(0.2)
        for frame in frames:
            out = []
            for node, p, c in frame.itertuples(index=False):
                x, y = p.replace("-", ""), c.replace("-", "")
                a, b = kernel.linear(x), kernel.linear(y)
                total = kernel.Matrices(a, b, model, total=True)
                best, score = an.aligned(x, y, model)
                drawn = [total.path(np.random.default_rng(node * 10 + k))[0] for k in range(2)]
                graphs = []
                for steps in (best, *drawn):
                    used = sorted({i for mat, i, _ in steps if mat != "Y" and (mat == "M" or i)})
                    sites = [0, *used, a.n + 1]
                    graphs.append(kernel.Graph(a.states, np.array(sites[:-1]), np.array(sites[1:]), np.ones(len(sites) - 1)))
                merged = kernel.merged_paths(graphs)
                edges = set(zip(merged.src.tolist(), merged.dst.tolist(), strict=True))
                kept = set(zip(graphs[0].src.tolist(), graphs[0].dst.tolist(), strict=True)) <= edges
                scores = [kernel.path_score(s, a, b, model) for s in drawn]
                out.append((node, len(a.states), kept, kernel.symmetric(merged), max(scores) <= score + 1e-6))
            yield pd.DataFrame(out, columns=["node_id", "left_sites", "best_kept", "forward", "not_above_best"])

    return rows.repartition(op._places(rows)).mapInPandas(sample, "node_id int, left_sites long, best_kept boolean, forward boolean, not_above_best boolean")


_EDGE_SQL = f"""WITH {RECORDS}, c AS (SELECT entry_id, i, substr(seq, CAST(i AS INT), 1) AS letter FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM rec)),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY entry_id, letter ORDER BY i) AS g FROM c), runs AS (SELECT entry_id, min(i) AS first, max(i) AS last, count(*) AS run FROM r GROUP BY entry_id, letter, g),
    skips AS (SELECT entry_id, last - unnest(range(1, run)) AS a, last + 1 AS b, 0.25::DOUBLE AS w FROM runs WHERE run >= 2 UNION ALL SELECT entry_id, last - 1, last + 1, 0.9 FROM runs WHERE run > 2 UNION ALL SELECT entry_id, last - 2, last + 1, 0.9 FROM runs WHERE run >= 5),
    edges AS (SELECT entry_id, a AS edge_from, b AS edge_to, max(w) AS weight FROM skips GROUP BY ALL)"""


@query(f"{_EDGE_SQL} SELECT CAST(entry_id AS BIGINT) AS entry_id, CAST(edge_from AS BIGINT) AS edge_from, CAST(edge_to AS BIGINT) AS edge_to, weight FROM edges")
def u05_edge_union(spark: SparkSession, d: str) -> DataFrame:
    """Edges of several graphs over the same sites as one set, each with its highest weight."""
    return _skip_edges(spark, d)


def _skip_edges(spark: SparkSession, d: str) -> DataFrame:
    some = [f(spark, d).select("entry_id", F.col("edge_from").cast("long"), F.col("edge_to").cast("long"), "weight") for f in (f15_flow_skip_edges, f16_homopolymer_skip_edges)]
    return some[0].unionByName(some[1]).groupBy("entry_id", "edge_from", "edge_to").agg(F.max("weight").alias("weight"))


@query(f"{_EDGE_SQL} SELECT entry_id, CAST(edge_from AS BIGINT) AS edge_from, CAST(edge_to AS BIGINT) AS edge_to, weight, x.letter AS from_letter, y.letter AS to_letter FROM edges JOIN c x USING (entry_id) JOIN c y USING (entry_id) WHERE x.i = edge_from AND y.i = edge_to")
def f18_explicit_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges attached to the sites of their sequences; those that lead out of them are left out."""
    return op.attached_edges(records(spark, d), _skip_edges(spark, d), "entry_id", "seq")


@query(f"WITH {REFERENCES} SELECT name, length(seq) AS sites, length(seq) + 1 AS edges, CAST(instr('{fs.DNA}', substr(seq, 1, 1)) - 1 AS INT) AS first_state, true AS chain FROM ref WHERE seq <> ''")
def f26_leaf_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The references' graphs, as they are attached to leaves."""
    r = references(spark, d).where("seq <> ''").select(F.col("name").alias("node_id"), "seq")
    g = op.leaf_graphs(r)
    return g.select(F.col("node_id").alias("name"), F.size("states").cast("long").alias("sites"), F.size("src").cast("long").alias("edges"), F.col("states")[0].alias("first_state"), F.expr("forall(arrays_zip(src, dst), e -> e.dst = e.src + 1)").alias("chain"))


def _stars(spark: SparkSession, d: str) -> DataFrame:
    """Of each taxon with three references or more a tree of two branches, the first reference and all others, as text."""
    r = references(spark, d).where("seq <> '' and tid <> ''").select("tid", F.struct("name", F.length("seq").alias("n")).alias("x")).groupBy("tid").agg(F.array_sort(F.collect_list("x")).alias("x")).where("size(x) > 2")
    leaf = lambda x: F.concat(x["name"], F.lit(":"), (x["n"] / 1000).cast("string"))
    rest = F.array_join(F.transform(F.expr("slice(x, 2, size(x) - 1)"), leaf), ",")
    return r.select("tid", F.concat(F.lit("("), leaf(F.col("x")[0]), F.lit(",("), rest, F.lit("):0.0);")).alias("text"))


@query(f"WITH {REFERENCES} SELECT tid, count(*) AS leaves, count(*) - 1 AS inner, true AS pairs FROM ref WHERE seq <> '' AND tid <> '' GROUP BY tid HAVING count(*) > 2")
def s09_multifurcations(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of many children become pairs: all leaves are kept, and each inner node has two children."""

    def resolve(frames):
        for frame in frames:
            out = []
            for tid, text in frame.itertuples(index=False):
                rows = sf.tree_rows(sf.binary(sf.parse_newick(text)))
                children = pd.Series([r[1] for r in rows if r[1] is not None]).value_counts()
                out.append((tid, len(rows) - len(children), len(children), bool((children == 2).all())))
            yield pd.DataFrame(out, columns=["tid", "leaves", "inner", "pairs"])

    return _stars(spark, d).mapInPandas(resolve, "tid string, leaves long, inner long, pairs boolean")


@query(f"""WITH {REFERENCES}, n AS (SELECT tid, length(seq) / 1000 AS l, row_number() OVER (PARTITION BY tid ORDER BY length(seq) DESC) AS k, count(*) OVER (PARTITION BY tid) AS c FROM ref WHERE seq <> '' AND tid <> '')
    SELECT tid, round(sum(l) / 2, 9) AS depth, round(sum(l) / 2, 9) AS other_depth FROM n WHERE k <= 2 AND c > 2 GROUP BY tid""")
def s10_midpoint_root(spark: SparkSession, d: str) -> DataFrame:
    """Stars rooted in the middle of their longest path: the deepest leaves on either side are half of it away."""

    def rooted(frames):
        for frame in frames:
            out = []
            for tid, text in frame.itertuples(index=False):
                top = sf.midpoint_rooted(sf.parse_newick(text))

                def depth(n):
                    return (n.length or 0.0) + max((depth(c) for c in n.children), default=0.0)

                deep = sorted((depth(c) for c in top.children), reverse=True)
                out.append((tid, round(deep[0], 9), round(deep[1], 9)))
            yield pd.DataFrame(out, columns=["tid", "depth", "other_depth"])

    return _stars(spark, d).mapInPandas(rooted, "tid string, depth double, other_depth double")


@query(_sibling_sql() + ", p AS (SELECT *, CASE WHEN a & b > 0 THEN a & b ELSE a | b END AS parent, CASE WHEN a & 5 > 0 THEN a & 5 ELSE a | 5 END AS grafted FROM z) SELECT node_id, i, grafted, CASE WHEN parent & grafted > 0 THEN parent & grafted ELSE grafted END AS resolved FROM p")
def t07_one_sided_parsimony(spark: SparkSession, d: str) -> DataFrame:
    """After a query (here a purine everywhere) is grafted above the left child: the new node's sets, and in the light of the node above."""
    z = _sibling_columns(spark, d).withColumn("parent", fs.parsimony(F.col("a"), F.col("b")))
    grafted, resolved = oc.one_sided(F.col("parent"), F.col("a"), F.lit(5))
    return z.select("node_id", "i", grafted.alias("grafted"), resolved.alias("resolved"))


@query(_sibling_sql() + " SELECT node_id, i, CASE WHEN bit_count(a & b) = 1 AND bit_count(a | b) > 2 THEN a & b ELSE a END AS left_set, CASE WHEN bit_count(a & b) = 1 AND bit_count(a | b) > 2 THEN a & b ELSE b END AS right_set FROM z")
def t08_resolved_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sibling columns whose sets have one base in common and more than two together are fixed to it."""
    a, b = F.col("a"), F.col("b")
    one = (F.bit_count(a.bitwiseAND(b)) == 1) & (F.bit_count(a.bitwiseOR(b)) > 2)
    fixed = lambda own: F.when(one, a.bitwiseAND(b)).otherwise(own)
    return _sibling_columns(spark, d).select("node_id", "i", fixed(a).alias("left_set"), fixed(b).alias("right_set"))


@query(f"""WITH {_UP}, u AS (SELECT up.node_id, ancestor_id, steps, distance FROM up JOIN tips USING (node_id)), met AS (SELECT a.node_id AS a, b.node_id AS b, a.distance + b.distance AS d, a.steps FROM u a JOIN u b USING (ancestor_id) WHERE a.node_id < b.node_id),
    dist AS (SELECT a, b, round(d, 9) AS d FROM met QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY steps) = 1), two AS (SELECT a, b FROM dist ORDER BY d DESC, a, b LIMIT 1),
    each AS (SELECT a, b, d FROM dist UNION ALL SELECT b, a, d FROM dist), third AS (SELECT each.a AS node_id FROM each, two WHERE each.b IN (two.a, two.b) AND each.a NOT IN (two.a, two.b) GROUP BY each.a ORDER BY min(d) DESC, each.a LIMIT 1)
    SELECT a AS node_id FROM two UNION ALL SELECT b FROM two UNION ALL SELECT node_id FROM third""")
def t11_distant_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The three leaves of the guide tree that are farthest from each other."""
    t = tree(spark, d)
    distances = stored(ot.leaf_distances(ot.ancestry(t), ot.leaves(t)).withColumn("distance", F.round("distance", 9)), "distances")
    return spark.createDataFrame([(n,) for n in oc.distant_leaves(distances, 3)], "node_id int")


@query("WITH w AS (SELECT DISTINCT name AS query, t.name AS node FROM fasta_entry f JOIN (SELECT name, tid FROM tree_node WHERE tid <> '') t USING (tid) WHERE f.name IS NOT NULL), k AS (SELECT query, node, max(score) AS score FROM hit GROUP BY query, node)".replace("SELECT DISTINCT name AS query, t.name", "SELECT DISTINCT f.name AS query, t.name") + " SELECT w.query, w.node, k.score, k.query IS NOT NULL AS known FROM w LEFT JOIN k ON k.query = w.query AND k.node = w.node")
def j11_memo_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Which wanted pairs of read and node have hits already, so that no search is needed for them."""
    q = spark.read.parquet(f"{d}/fasta_entry.parquet").select(F.col("name").alias("query"), "tid").where("query is not null and tid <> ''").distinct()
    wanted = q.join(tree(spark, d).select(F.col("name").alias("node"), "tid"), "tid").select("query", "node").distinct()
    known = hits(spark, d).groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("known", F.lit(True))
    return wanted.join(known, ["query", "node"], "left").select("query", "node", "score", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT * FROM (VALUES ('block', '64'), ('min_orf_length', '30'), ('query_distance', '0.1'), ('real_branches', 'True'), ('min_query_overlap', '0.7')) o(name, value)")
def s16_options(spark: SparkSession, d: str) -> DataFrame:
    """Options from lines of a file, laid over the defaults, and as a placement's."""
    o = Options.from_text("min-orf-length = 30\n# a comment\nreal-branches =\nmin-query-overlap = 0.7\n")
    names = ("block", "min_orf_length", "query_distance", "real_branches")
    return spark.createDataFrame([*((n, str(getattr(o, n))) for n in names), ("min_query_overlap", str(o.placement().least_overlap))], "name string, value string")


@query(f"""WITH {RECORDS}, e AS (SELECT name, min(seq) AS seq FROM rec GROUP BY name), c AS (SELECT anchor_id, substr(a.seq, start_1 + 1, length) AS x, substr(b.seq, start_2 + 1, length) AS y FROM anchor JOIN e a ON a.name = seq_1 JOIN e b ON b.name = seq_2 WHERE plus_1 AND plus_2 AND length > 0 AND start_1 >= 0 AND start_2 >= 0)
    SELECT anchor_id, true AS totals_agree, true AS at_most_one FROM c WHERE x <> '' AND y <> ''""")
def a08_a10_k18_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor's stretches of its two records: the passes from either end give one total, and no site is paired with a probability above 1."""
    e = records(spark, d).groupBy("name").agg(F.min("seq").alias("seq"))
    a, b = e.select(F.col("name").alias("seq_1"), F.col("seq").alias("x")), e.select(F.col("name").alias("seq_2"), F.col("seq").alias("y"))
    rows = spark.read.parquet(f"{d}/anchor.parquet").where("plus_1 and plus_2 and length > 0 and start_1 >= 0 and start_2 >= 0").join(a, "seq_1").join(b, "seq_2")
    cut = rows.select("anchor_id", F.expr("substring(x, start_1 + 1, length)").alias("a"), F.expr("substring(y, start_2 + 1, length)").alias("b"))
    p = op.posterior_sums(cut, "anchor_id")
    return p.select("anchor_id", (F.abs(F.col("forward") - F.col("backward")) < 1e-6).alias("totals_agree"), (F.col("most") < 1 + 1e-6).alias("at_most_one"))


@query(f"""WITH {_MERGED}, {REFERENCES}, t AS (SELECT DISTINCT t.name AS node FROM tree_node t JOIN ref USING (name) WHERE seq <> '' AND node_id NOT IN (SELECT parent_id FROM tree_node WHERE parent_id IS NOT NULL)),
    m AS (SELECT query, node, score FROM merged SEMI JOIN t USING (node)), ten AS (SELECT * FROM m QUALIFY rank() OVER (PARTITION BY query ORDER BY score DESC) <= 10)
    SELECT query, node, score FROM ten QUALIFY rank() OVER (PARTITION BY query ORDER BY score DESC) <= 3""")
def r06_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The leaves that each query is aligned with before it is placed."""
    from sedgeline.plans.alignment_queries import _leaf_letters

    targets = _leaf_letters(spark, d).where("seq <> ''").select(F.col("name").alias("node"))
    return candidates(hits(spark, d).join(targets, "node", "left_semi")).select("query", "node", "score")


@query(f"""{_FAMILIES}, c AS (SELECT fam, node_id, i, substr(seq, CAST(i AS INT), 1) AS letter FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM members)),
    same AS (SELECT fam, i, min(letter) AS letter FROM c GROUP BY fam, i HAVING count(*) = 4 AND min(letter) = max(letter) AND min(letter) IN ('A', 'C', 'G', 'T'))
    SELECT CAST(fam * 8 + n AS INT) AS node_id, count(*) AS settled, 0::BIGINT AS wrong FROM same, (VALUES (1), (2), (3)) x(n) GROUP BY fam, n""")
def t09_likely_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes of the families' trees by likelihood, over the members side by side: where all members have one base, so do their ancestors."""
    members, nodes = families(spark, d)
    shape = nodes.withColumn("tree", F.floor(F.col("node_id") / 8).cast("int"))
    found = oc.likelihood_rows(shape, members.withColumnRenamed("seq", "row"))
    letters = lambda df, row: df.select("*", F.posexplode(F.split(row, "")).alias("i", "letter")).where("letter <> ''")
    own = letters(members.withColumn("tree", F.floor(F.col("node_id") / 8).cast("int")), "seq").groupBy("tree", "i").agg(F.min("letter").alias("one"), F.max("letter").alias("other"), F.count("*").alias("n"))
    same = own.where("n = 4 and one = other and one in ('A', 'C', 'G', 'T')").select("tree", "i", "one")
    inner = letters(found.select("tree", "node_id", "row"), "row").select("tree", "node_id", "i", "letter")
    return inner.join(same, ["tree", "i"]).groupBy("node_id").agg(F.count("*").alias("settled"), F.count_if(F.col("letter") != F.col("one")).alias("wrong"))
