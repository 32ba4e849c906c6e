"""Alignments: of the references along the guide tree, of pairs that anchors name, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgeline.functions.models import dna_scores
from sedgeline.functions.sequence import DNA
from sedgeline.operators import progressive as op
from sedgeline.operators import ancestors as oc
from sedgeline.operators import trees as ot
from sedgeline.operators.alignments import branch_events
from sedgeline.plans.model_queries import _BITS
from sedgeline.operators.placement import placements
from sedgeline.plans.tables import RECORDS, REFERENCES, anchors, hits, records, references, tree
from sedgeline.workspace import stored

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Families of homologs with known differences, one for each leaf of the guide tree: member k has a block of 12 letters substituted
# at 11 + 40k, and 3k letters deleted after it. A family's tree is ((4, 5), (6, 7)) with the root 1, its node ids are 8 times the leaf's more.
_MEMBER = "concat(substr(seq, 1, 10 + 40 * k), translate(substr(seq, 11 + 40 * k, 12), 'ACGT', 'CGTA'), substr(seq, 23 + 40 * k + 3 * k))"
_FAMILIES = f"""WITH {REFERENCES}, tips AS (SELECT node_id AS fam, seq FROM tree_node JOIN ref USING (name) WHERE node_id NOT IN (SELECT parent_id FROM tree_node WHERE parent_id IS NOT NULL)),
    members AS (SELECT fam, fam * 8 + 4 + k AS node_id, {_MEMBER} AS seq FROM tips, (VALUES (0), (1), (2), (3)) x(k))"""


def families(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The families' members (node_id, seq) and their trees."""
    tips = ot.leaves(tree(spark, d)).select(F.col("node_id").alias("fam"), "name").join(references(spark, d).select("name", "seq"), "name")
    members = tips.select("fam", "seq", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).select((F.col("fam") * 8 + 4 + F.col("k")).alias("node_id"), F.expr(_MEMBER).alias("seq"))
    shape = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(side).alias("side")) for n, p, side in ((1, None, None), (2, 1, "left"), (3, 1, "right"), (4, 2, "left"), (5, 2, "right"), (6, 3, "left"), (7, 3, "right"))])
    nodes = tips.select("fam", F.explode(shape).alias("x")).select((F.col("fam") * 8 + F.col("x.n")).alias("node_id"), (F.col("fam") * 8 + F.col("x.p")).alias("parent_id"), "x.side", F.lit(None).cast("string").alias("name"), (F.lit(0.01) * F.col("x.n")).alias("branch_length"))
    return members, nodes


def _aligned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members, nodes = families(spark, d)
    aligned = op.progressive_alignment(nodes, op.leaf_graphs(members))
    return members, aligned, op.column_maps(aligned)


@query(f"{_FAMILIES} SELECT node_id, seq AS ungapped, true AS same_width, 0 AS gap_only, true AS homologous FROM members")
def t01_progressive_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Families aligned along their trees; what must hold: rows without gaps are the sequences, a family's rows are as wide, no column is empty,
    and three quarters of each member's letters stand with the letters of the first member that they were made from."""
    members, _, maps = _aligned(spark, d)
    rows = stored(op.alignment_rows(maps, members), "rows")
    columns = rows.select("root_id", F.posexplode(F.split("row", "")).alias("i", "c")).where("c <> ''").groupBy("root_id", "i").agg(F.min((F.col("c") == "-").cast("int")).alias("gap"))
    empty = columns.groupBy("root_id").agg(F.sum("gap").cast("int").alias("gap_only"), F.count("*").alias("width"))
    # Where each letter of a member was in the sequence that its family was made from: what follows its block lost 3k letters.
    cells = rows.select("root_id", "node_id", F.posexplode(F.split("row", "")).alias("i", "c")).where("c <> '' and c <> '-'").withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy("i")))
    k = F.col("node_id") % 8 - 4
    placed = cells.withColumn("k", k).withColumn("origin", F.when(F.col("n") <= 22 + 40 * k, F.col("n")).otherwise(F.col("n") + 3 * k))
    first = placed.where("k = 0").select("root_id", "i", F.col("origin").alias("first"))
    right = placed.join(first, ["root_id", "i"], "left").groupBy("node_id").agg((F.avg(F.coalesce((F.col("origin") == F.col("first")).cast("int"), F.lit(0))) >= 0.75).alias("homologous"))
    joined = rows.join(empty, "root_id").join(right, "node_id")
    return joined.select("homologous", "node_id", F.replace(F.col("row"), F.lit("-"), F.lit("")).alias("ungapped"), (F.length("row") == F.col("width")).alias("same_width"), "gap_only")


@query(f"{_FAMILIES} SELECT fam * 8 + n AS node_id, 0 AS bad_edges, 0 AS twice, true AS weighted, true AS covers FROM tips, (VALUES (1), (2), (3)) x(n)")
def a22_graph_validity(spark: SparkSession, d: str) -> DataFrame:
    """The inner nodes' graphs: edges that don't lead forward between two of their sites, edges that are there twice, weights from 0 to 1,
    and whether each child's sites stand in order, each once, among the node's."""
    members, nodes = families(spark, d)
    aligned = op.progressive_alignment(nodes, op.leaf_graphs(members))
    return aligned.select("node_id", F.expr("size(filter(arrays_zip(src, dst), e -> e.src < 0 or e.dst > size(states) + 1 or e.src >= e.dst))").alias("bad_edges"), F.expr("size(src) - size(array_distinct(arrays_zip(src, dst)))").alias("twice"), F.expr("forall(weight, w -> w > 0 and w <= 1)").alias("weighted"), F.expr("filter(left, i -> i > 0) = sequence(1, array_max(left)) and filter(right, i -> i > 0) = sequence(1, array_max(right)) and forall(arrays_zip(left, right), x -> x.left > 0 or x.right > 0) and size(left) = size(states)").alias("covers"))


@query(None)
def e01_branch_events(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions, insertions and deletions on every branch of the families' trees, from the aligned and the reconstructed rows."""
    members, aligned, maps = _aligned(spark, d)
    rows = stored(op.alignment_rows(maps, members).unionByName(op.ancestor_rows(maps, aligned)).select("node_id", "row"), "rows")
    _, nodes = families(spark, d)
    branches = nodes.where("parent_id is not null").select("node_id", "parent_id").join(rows.withColumnRenamed("row", "child"), "node_id").join(rows.select(F.col("node_id").alias("parent_id"), F.col("row").alias("parent")), "parent_id")
    return branch_events(branches, "node_id", "parent", "child")


_PAIR_SQL = f"""WITH {RECORDS}, e AS (SELECT name, min(seq) AS seq FROM rec GROUP BY name)
    SELECT anchor_id, a.seq AS ungapped_a, b.seq AS ungapped_b, true AS same_width, true AS best_score FROM anchor JOIN e a ON a.name = seq_1 JOIN e b ON b.name = seq_2"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = records(spark, d).groupBy("name").agg(F.min("seq").alias("seq"))
    a, b = e.select(F.col("name").alias("seq_1"), F.col("seq").alias("a")), e.select(F.col("name").alias("seq_2"), F.col("seq").alias("b"))
    return anchors(spark, d).select("anchor_id", "seq_1", "seq_2").join(a, "seq_1").join(b, "seq_2")


@query(_PAIR_SQL)
def a07_pair_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor's two records aligned from end to end; what must hold: the rows are the records', and score what the best path does."""
    rows = op.pairwise(_pairs(spark, d), key="anchor_id")
    plain = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    return rows.select("anchor_id", plain("row_a").alias("ungapped_a"), plain("row_b").alias("ungapped_b"), (F.length("row_a") == F.length("row_b")).alias("same_width"), (F.abs(F.col("score") - F.col("rescored")) < 1e-6).alias("best_score"))


_SCORES = " ".join(f"WHEN x = '{a}' AND y = '{b}' THEN {float(v):.17g}::DOUBLE" for a, row in zip(DNA, dna_scores(0.2)) for b, v in zip(DNA, row))  # noqa: B905


@query(f"""WITH {RECORDS}, e AS (SELECT name, min(seq) AS seq FROM rec GROUP BY name), p AS (SELECT anchor_id, a.seq AS a, b.seq AS b FROM anchor JOIN e a ON a.name = seq_1 JOIN e b ON b.name = seq_2),
    c AS (SELECT anchor_id, substr(a, CAST(i AS INT), 1) AS x, substr(b, CAST(i AS INT), 1) AS y FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM p)),
    s AS (SELECT anchor_id, x, y, CASE {_SCORES} ELSE 0 END AS v FROM c), own AS (SELECT anchor_id, sum(CASE {_SCORES} ELSE 0 END) AS own FROM (SELECT anchor_id, x, x AS y FROM c) GROUP BY anchor_id)
    SELECT anchor_id, round(sum(v), 5) AS score, round(sum(v) / nullif(max(own), 0), 5) AS normalised, round(count(*) FILTER (y <> '') / count(*), 9) AS overlap, round(count(*) FILTER (x = y) / nullif(count(*) FILTER (y <> ''), 0), 9) AS identity
    FROM s JOIN own USING (anchor_id) GROUP BY anchor_id""")
def g07_match_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, its share of the first record's score with itself, overlap and identity of each anchor's two records, laid side by side from the start."""
    return op.match_scores(_pairs(spark, d), "anchor_id", "a", "b", 0.2)


@query(None)
def r06_placements(spark: SparkSession, d: str) -> DataFrame:
    """Every query with hits, placed on the leaf it aligns best with."""
    e = records(spark, d).groupBy("name").agg(F.min("seq").alias("seq"))
    r = references(spark, d).select("name", "seq")
    both = e.join(r.select("name"), "name", "left_anti").unionByName(r)
    found = placements(hits(spark, d), both, _leaf_letters(spark, d))
    return found.select("query", "node", "reversed", *[F.round(c, 6).alias(c) for c in ("score", "overlap", "identity", "normalised")], "verdict")


def _leaf_letters(spark: SparkSession, d: str) -> DataFrame:
    return ot.leaves(tree(spark, d)).select("node_id", "name").join(references(spark, d).select("name", "seq"), "name").select("name", "seq")


def _fitch_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} & {b} > 0 THEN {a} & {b} ELSE {a} | {b} END"


_CELLS = f"""{_FAMILIES}, {{bits}}, w AS (SELECT fam, max(length(seq)) AS w FROM members GROUP BY fam),
    grid AS (SELECT fam, unnest(range(1, w + 1)) AS i FROM w),
    cells AS (SELECT g.fam, g.i, {', '.join(f"coalesce(b{k}.bits, 0) AS s{k}" for k in range(4))} FROM grid g
        {' '.join(f"JOIN members m{k} ON m{k}.fam = g.fam AND m{k}.node_id = g.fam * 8 + {4 + k} LEFT JOIN bits b{k} ON b{k}.letter = substr(m{k}.seq, CAST(g.i AS INT), 1)" for k in range(4))}),
    up AS (SELECT *, {_fitch_sql('s0', 's1')} AS p2, {_fitch_sql('s2', 's3')} AS p3 FROM cells), top AS (SELECT *, {_fitch_sql('p2', 'p3')} AS p1 FROM up),
    down AS (SELECT fam, i, p1, CASE WHEN p1 & p2 > 0 THEN p1 & p2 ELSE p2 END AS p2, CASE WHEN p1 & p3 > 0 THEN p1 & p3 ELSE p3 END AS p3 FROM top),
    long AS (SELECT fam * 8 + 1 AS node_id, i, p1 AS b FROM down UNION ALL SELECT fam * 8 + 2, i, p2 FROM down UNION ALL SELECT fam * 8 + 3, i, p3 FROM down)
    SELECT node_id, string_agg(coalesce(bits.letter, '-'), '' ORDER BY i) AS row FROM long LEFT JOIN bits ON bits.bits = long.b GROUP BY node_id"""


@query(_CELLS.format(bits=_BITS))
def t06_parsimony_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes of the families' trees by parsimony, over the members side by side from their first letters."""
    members, nodes = families(spark, d)
    shape = nodes.withColumn("tree", F.floor(F.col("node_id") / 8).cast("int"))
    return oc.parsimony_rows(shape, members.withColumnRenamed("seq", "row")).select("node_id", "row")


@query(f"""{_FAMILIES}, grams AS (SELECT DISTINCT fam, node_id, substr(seq, CAST(i AS INT), 6) AS g FROM (SELECT *, unnest(range(1, greatest(length(seq) - 5, 1) + 1)) AS i FROM members)),
    sizes AS (SELECT node_id, count(*) AS n FROM grams GROUP BY node_id), met AS (SELECT a.fam, a.node_id AS a, b.node_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.fam = b.fam AND a.g = b.g AND a.node_id < b.node_id GROUP BY ALL),
    d AS (SELECT p.fam, p.a % 8 - 4 AS a, p.b % 8 - 4 AS b, 1 - coalesce(c, 0) / least(x.n, y.n) AS d FROM (SELECT m.fam, m.node_id AS a, o.node_id AS b FROM members m JOIN members o ON m.fam = o.fam AND m.node_id < o.node_id) p LEFT JOIN met USING (fam, a, b) JOIN sizes x ON x.node_id = p.a JOIN sizes y ON y.node_id = p.b),
    sums AS (SELECT fam, sum(d) FILTER (a = 0 AND b = 1 OR a = 2 AND b = 3) AS s1, sum(d) FILTER (a = 0 AND b = 2 OR a = 1 AND b = 3) AS s2, sum(d) FILTER (a = 0 AND b = 3 OR a = 1 AND b = 2) AS s3 FROM d GROUP BY fam),
    low AS (SELECT fam, least(s1, s2, s3) AS m, s1, s2, s3 FROM sums)
    SELECT fam, 4 AS leaves, 7 AS nodes, true AS rooted, CASE WHEN CAST(s1 < m + 1e-9 AS INT) + CAST(s2 < m + 1e-9 AS INT) + CAST(s3 < m + 1e-9 AS INT) > 1 THEN true ELSE NULL END AS tied, CASE WHEN CAST(s1 < m + 1e-9 AS INT) + CAST(s2 < m + 1e-9 AS INT) + CAST(s3 < m + 1e-9 AS INT) > 1 THEN NULL WHEN s1 < m + 1e-9 THEN 1 WHEN s2 < m + 1e-9 THEN 2 ELSE 3 END AS partner FROM low""")
def t04_guide_trees(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each family: its size, that it has one root, and which member it parts from the others together with the first,
    which must be the pairing with the smallest sum of distances (null where that is tied)."""
    members, _ = families(spark, d)
    named = stored(members.withColumn("fam", F.floor(F.col("node_id") / 8).cast("int")), "members")
    trees = stored(oc.guide_trees(named, "fam", "node_id", "seq"), "trees")
    size = trees.groupBy("fam").agg(F.count("name").cast("int").alias("leaves"), F.count("*").cast("int").alias("nodes"), (F.count_if(F.col("parent_id").isNull()) == 1).alias("rooted"))
    cherry = trees.where("name is not null").groupBy("fam", "parent_id").agg(F.sort_array(F.collect_list(F.col("name") % 8 - 4)).alias("pair")).where("size(pair) = 2").groupBy("fam").agg(F.min_by("pair", "parent_id").alias("p"))
    other = F.when(F.col("p")[0] == 0, F.col("p")[1]).otherwise(6 - F.col("p")[0] - F.col("p")[1])
    # Ties of the distances, of which any pairing is right.
    grams = named.select("fam", (F.col("node_id") % 8 - 4).alias("k"), F.expr("array_distinct(transform(sequence(1, greatest(length(seq) - 5, 1)), i -> substring(seq, i, 6)))").alias("g"))
    rows = grams.groupBy("fam").agg(F.expr("transform(array_sort(collect_list(struct(k, g))), x -> x.g)").alias("s"))
    far = lambda i, j: F.lit(1.0) - F.size(F.array_intersect(F.col("s")[i], F.col("s")[j])) / F.least(F.size(F.col("s")[i]), F.size(F.col("s")[j]))
    sums = rows.select("fam", F.array(far(0, 1) + far(2, 3), far(0, 2) + far(1, 3), far(0, 3) + far(1, 2)).alias("sums"))
    tied = sums.select("fam", (F.size(F.expr("filter(sums, x -> x < array_min(sums) + 1e-9)")) > 1).alias("t"))
    return size.join(cherry, "fam").join(tied, "fam").select("fam", "leaves", "nodes", "rooted", F.when(F.col("t"), True).alias("tied"), F.when(~F.col("t"), other).cast("int").alias("partner"))
