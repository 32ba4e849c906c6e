"""Joins, aggregates and rankings over hits, anchors and the guide tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgeline.functions import sequence as fs
from sedgeline.operators import hits as oh
from sedgeline.operators import trees as ot
from sedgeline.plans.tables import HITS, RECORDS, REFERENCES, anchors, hits, records, references, tree
from sedgeline.workspace import numbered

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_MERGED = HITS + """,
    same AS (SELECT query, node, q_strand, t_strand, CAST(sum(score) AS BIGINT) AS score, min(q_start) AS q_start, max(q_end) AS q_end, min(t_start) AS t_start, max(t_end) AS t_end
             FROM h WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
    merged AS (SELECT * FROM same QUALIFY row_number() OVER (PARTITION BY query, node ORDER BY score DESC, q_strand, t_strand) = 1)
"""
_MORE = lambda spark, d: oh.merged_hits(hits(spark, d))


@query(f"WITH {_MERGED} SELECT * FROM merged")
def g10_merged_hits(spark: SparkSession, d: str) -> DataFrame:
    return _MORE(spark, d)


@query("""SELECT *, greatest(plus, minus) AS total, minus > plus AS reversed FROM (
    SELECT seq_1, seq_2, CAST(sum(CASE WHEN plus_1 AND plus_2 THEN coalesce(score, 0) ELSE 0 END) AS BIGINT) AS plus,
           CAST(sum(CASE WHEN plus_1 AND plus_2 THEN 0 ELSE coalesce(score, 0) END) AS BIGINT) AS minus FROM anchor GROUP BY seq_1, seq_2)""")
def g09_pair_totals(spark: SparkSession, d: str) -> DataFrame:
    return oh.pair_totals(anchors(spark, d))


@query(f"WITH {_MERGED} SELECT query, node, score, rank() OVER (PARTITION BY query ORDER BY score DESC) AS place FROM merged QUALIFY place <= 3")
def w01_top_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return oh.best_with_ties(_MORE(spark, d).select("query", "node", "score"), "query", "score", 3)


@query(f"WITH {_MERGED} SELECT query, node, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS place FROM merged QUALIFY place <= 6")
def w02_top_without_ties(spark: SparkSession, d: str) -> DataFrame:
    return oh.best_without_ties(_MORE(spark, d).select("query", "node", "score"), "query", "score", "node", 6)


@query(f"WITH {_MERGED}, t AS (SELECT query, node, score, CAST(floor(max(score) OVER (PARTITION BY query) * 0.8::DOUBLE) AS BIGINT) AS floor FROM merged) SELECT * FROM t WHERE score > floor")
def w03_above_fraction(spark: SparkSession, d: str) -> DataFrame:
    return oh.above_fraction(_MORE(spark, d).select("query", "node", "score"), "query", "score", 0.8)


@query(f"WITH {_MERGED} SELECT query, node, score FROM merged QUALIFY rank() OVER (PARTITION BY query ORDER BY score DESC) = 1")
def w04_best_placements(spark: SparkSession, d: str) -> DataFrame:
    return oh.best_with_ties(_MORE(spark, d).select("query", "node", "score"), "query", "score", 1).drop("place")


@query(f"WITH {_MERGED} SELECT query, node, score FROM merged QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node DESC) = 1")
def w05_single_placement(spark: SparkSession, d: str) -> DataFrame:
    return oh.single_best(_MORE(spark, d).select("query", "node", "score"), "query", "score", "node")


@query(f"WITH {_MERGED}, b AS (SELECT query, max(score) AS best FROM merged GROUP BY query) SELECT query, best, CASE WHEN best < 100 THEN 'discarded' ELSE 'placed' END AS verdict FROM b")
def w06_score_gate(spark: SparkSession, d: str) -> DataFrame:
    best = _MORE(spark, d).groupBy("query").agg(F.max("score").alias("best"))
    return best.withColumn("verdict", F.when(F.col("best") < 100, "discarded").otherwise("placed"))


@query(f"WITH {_MERGED} SELECT node, query, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, query) AS place FROM merged")
def w07_reads_in_node(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), "query")
    return _MORE(spark, d).select("node", "query", "score", F.row_number().over(order).alias("place"))


@query(f"WITH {RECORDS} SELECT run, entry_id, row_number() OVER (PARTITION BY run ORDER BY length(seq) DESC, coalesce(num_duplicates, 1) DESC, entry_id) AS place FROM rec")
def w08_by_length(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("run").orderBy(F.length("seq").desc(), F.coalesce("num_duplicates", F.lit(1)).desc(), "entry_id")
    return records(spark, d).select("run", "entry_id", F.row_number().over(order).alias("place"))


@query("SELECT node_id, name, row_number() OVER (ORDER BY starts_with(name, '#'), coalesce(try_cast(replace(name, '#', '') AS BIGINT), 0) * CAST(starts_with(name, '#') AS INT), name) AS place FROM tree_node")
def w09_node_names(spark: SparkSession, d: str) -> DataFrame:
    return numbered(tree(spark, d).select("node_id", "name"), oh.node_order("name"), "place")


@query("SELECT seq_1, anchor_id, max(start_1 + length) OVER (PARTITION BY seq_1 ORDER BY start_1, anchor_id ROWS UNBOUNDED PRECEDING) AS reach FROM anchor")
def w12_running_bound(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("seq_1").orderBy("start_1", "anchor_id").rowsBetween(Window.unboundedPreceding, 0)
    return anchors(spark, d).select("seq_1", "anchor_id", F.max(F.col("start_1") + F.col("length")).over(order).alias("reach"))


@query(f"""WITH {RECORDS}, c AS (SELECT sum(length(seq) - length(replace(seq, 'A', ''))) AS a, sum(length(seq) - length(replace(seq, 'C', ''))) AS c,
    sum(length(seq) - length(replace(seq, 'G', ''))) AS g, sum(length(seq) - length(replace(seq, 'T', ''))) AS t FROM rec)
    SELECT round(a / (a + c + g + t), 9) AS a, round(c / (a + c + g + t), 9) AS c, round(g / (a + c + g + t), 9) AS g, round(t / (a + c + g + t), 9) AS t FROM c""")
def g01_base_frequencies(spark: SparkSession, d: str) -> DataFrame:
    counts = records(spark, d).agg(*[F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))).alias(b.lower()) for b in "ACGT"])
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return counts.select(*[F.round(F.col(b) / total, 9).alias(b) for b in "acgt"])


@query(f"""WITH {RECORDS}, n AS (SELECT run, sum(len(regexp_replace(seq, '[^ACGTUN]', '', 'g'))) AS dna, sum(len(regexp_replace(seq, '[^ARNDCQEGHILKMFPSTWYV]', '', 'g'))) AS prot FROM rec GROUP BY run)
    SELECT run, CAST(dna AS BIGINT) AS dna, CAST(prot AS BIGINT) AS prot, CASE WHEN dna / prot > 0.9 THEN 'dna' ELSE 'protein' END AS molecule FROM n""")
def g02_molecule(spark: SparkSession, d: str) -> DataFrame:
    count = lambda letters: F.sum(F.length(F.regexp_replace("seq", f"[^{letters}]", "")))
    sums = records(spark, d).groupBy("run").agg(count("ACGTUN").alias("dna"), count(fs.AMINO_ACIDS).alias("prot"))
    return sums.withColumn("molecule", F.when(F.col("dna") / F.col("prot") > 0.9, "dna").otherwise("protein"))


@query(f"""WITH {RECORDS}, l AS (SELECT name, max(length(seq)) AS n FROM rec GROUP BY name)
    SELECT seq_1, seq_2, round(sum(CASE WHEN length > 0 THEN length ELSE 0 END)::DOUBLE / (a.n::DOUBLE * b.n), 12) AS coverage, CAST(a.n AS BIGINT) * b.n * 64 * 3 + 50000000 AS bytes
    FROM anchor JOIN l a ON a.name = seq_1 JOIN l b ON b.name = seq_2 GROUP BY seq_1, seq_2, a.n, b.n""")
def g11_g12_coverage_and_memory(spark: SparkSession, d: str) -> DataFrame:
    """Share of the matrix that the anchors of a pair cover, and the bytes that the full matrix would take."""
    size = records(spark, d).groupBy("name").agg(F.max(F.length("seq")).alias("n"))
    a, b = (size.select(F.col("name").alias(f"seq_{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    covered = anchors(spark, d).groupBy("seq_1", "seq_2").agg(F.sum(F.when(F.col("length") > 0, F.col("length")).otherwise(0)).alias("c"))
    joined = covered.join(a, "seq_1").join(b, "seq_2")
    return joined.select("seq_1", "seq_2", F.round(F.col("c").cast("double") / (F.col("n1").cast("double") * F.col("n2")), 12).alias("coverage"), (F.col("n1").cast("long") * F.col("n2") * 192 + 50000000).alias("bytes"))


@query(f"WITH {HITS} SELECT count(DISTINCT query) AS placed, count(DISTINCT node) AS nodes, count(*) AS hits FROM h WHERE query IS NOT NULL AND node IS NOT NULL AND score >= 100")
def g17_placement_statistics(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where("query is not null and node is not null and score >= 100").agg(F.count_distinct("query").alias("placed"), F.count_distinct("node").alias("nodes"), F.count("*").alias("hits"))


@query(f"WITH {HITS} SELECT DISTINCT node FROM h WHERE node IS NOT NULL")
def u04_placement_nodes(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("node").where("node is not null").distinct()


@query("SELECT DISTINCT query AS name FROM hit WHERE query IS NOT NULL EXCEPT SELECT name FROM ref_entry")
def u03_name_difference(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select(F.col("query").alias("name")).where("name is not null").distinct().join(references(spark, d).select("name"), "name", "left_anti")


@query("SELECT name, 'reference' AS kind FROM ref_entry UNION ALL SELECT DISTINCT name, 'read' FROM fasta_entry WHERE name IS NOT NULL")
def u02_all_rows(spark: SparkSession, d: str) -> DataFrame:
    reads = spark.read.parquet(f"{d}/fasta_entry.parquet").select("name").where("name is not null").distinct().withColumn("kind", F.lit("read"))
    return references(spark, d).select("name", F.lit("reference").alias("kind")).unionByName(reads)


@query("SELECT node_id, t.name, sequence FROM tree_node t JOIN ref_entry r USING (name) WHERE node_id NOT IN (SELECT parent_id FROM tree_node WHERE parent_id IS NOT NULL)")
def j01_sequences_on_leaves(spark: SparkSession, d: str) -> DataFrame:
    return ot.leaves(tree(spark, d)).select("node_id", "name").join(references(spark, d).select("name", "sequence"), "name")


@query("""WITH l AS (SELECT name FROM tree_node WHERE node_id NOT IN (SELECT parent_id FROM tree_node WHERE parent_id IS NOT NULL))
    SELECT (SELECT count(*) FROM l JOIN ref_entry USING (name)) AS matched, (SELECT count(*) FROM l ANTI JOIN ref_entry USING (name)) AS leaves_without, (SELECT count(*) FROM ref_entry ANTI JOIN l USING (name)) AS sequences_without""")
def j02_name_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    l, r = ot.leaves(tree(spark, d)).select("name", F.lit(1).alias("l")), references(spark, d).select("name", F.lit(1).alias("r"))
    both = l.join(r, "name", "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("leaves_without"), F.count_if(F.col("l").isNull()).alias("sequences_without"))


@query("SELECT name, sequence FROM ref_entry SEMI JOIN tree_node USING (name)")
def j03_leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).select("name", "sequence").join(tree(spark, d).select("name"), "name", "left_semi")


@query("SELECT r.name, r.sequence FROM ref_entry r WHERE r.name IN (SELECT node FROM hit)")
def j04_pruned_leaves(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).select("name", "sequence").join(hits(spark, d).select(F.col("node").alias("name")), "name", "left_semi")


@query("SELECT c.node_id, c.parent_id, c.side, c.name, p.name AS parent_name FROM tree_node c JOIN tree_node p ON p.node_id = c.parent_id")
def j05_parent_child(spark: SparkSession, d: str) -> DataFrame:
    return ot.parent_child_pairs(tree(spark, d))


@query("SELECT r.name AS query, t.name AS target, CASE WHEN t.tid IS NULL THEN 'none' ELSE 'tid' END AS how FROM ref_entry r JOIN tree_node t ON r.tid = t.tid AND r.tid <> ''")
def j08_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each reference by taxon."""
    r = references(spark, d).select(F.col("name").alias("query"), "tid").where("tid <> ''")
    t = tree(spark, d).select(F.col("name").alias("target"), "tid")
    return r.join(t, "tid").select("query", "target", F.lit("tid").alias("how"))


@query("""WITH q AS (SELECT DISTINCT name AS query, tid FROM fasta_entry WHERE name IS NOT NULL)
    SELECT query, q.tid, t.name AS target, 'tid' AS how FROM q JOIN tree_node t ON t.tid = q.tid AND q.tid <> ''
    UNION ALL SELECT query, q.tid, t.name, 'all' FROM q CROSS JOIN tree_node t WHERE q.tid IS NULL OR q.tid NOT IN (SELECT tid FROM tree_node WHERE tid <> '')""")
def j08_read_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each read by taxon, all nodes where no node has it."""
    q = spark.read.parquet(f"{d}/fasta_entry.parquet").select(F.col("name").alias("query"), "tid").where("query is not null").distinct()
    return ot.target_candidates(q, tree(spark, d))


@query("""WITH q AS (SELECT DISTINCT name AS query, tid FROM fasta_entry WHERE name IS NOT NULL), tags AS (SELECT tid, count(*) AS n FROM tree_node WHERE tid IS NOT NULL GROUP BY tid)
    SELECT query, q.tid, coalesce(n, (SELECT count(*) FROM tree_node)) AS targets, n IS NULL AS all_nodes FROM q LEFT JOIN tags USING (tid)""")
def j09_taxon_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each query is held against: those of its taxon, or all where no node has it."""
    q = spark.read.parquet(f"{d}/fasta_entry.parquet").select(F.col("name").alias("query"), "tid").where("query is not null").distinct()
    t = tree(spark, d)
    tags = t.where("tid is not null").groupBy("tid").agg(F.count("*").alias("n"))
    every = F.broadcast(t.agg(F.count("*").alias("every")))  # one row
    return q.join(tags, "tid", "left").join(every, F.lit(True)).select("query", "tid", F.coalesce("n", "every").alias("targets"), F.col("n").isNull().alias("all_nodes"))


@query("SELECT t.name, p.name AS parent FROM tree_node t LEFT JOIN tree_node p ON p.node_id = t.parent_id")
def j14_parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    return t.select("name", "parent_id").join(t.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("name", "parent")


@query(f"WITH {RECORDS}, {REFERENCES} SELECT h.node, h.query, coalesce(r.seq, e.seq) AS dna FROM (SELECT DISTINCT node, query FROM hit WHERE node IS NOT NULL AND query IS NOT NULL) h LEFT JOIN (SELECT name, min(seq) AS seq FROM ref GROUP BY name) r ON r.name = h.query LEFT JOIN (SELECT name, min(seq) AS seq FROM rec GROUP BY name) e ON e.name = h.query")
def j12_dna_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The letters of each hit's query: of the reference of that name, or else of the record."""
    h = hits(spark, d).select("node", "query").where("node is not null and query is not null").distinct()
    r = references(spark, d).groupBy(F.col("name").alias("query")).agg(F.min("seq").alias("r"))
    e = records(spark, d).groupBy(F.col("name").alias("query")).agg(F.min("seq").alias("e"))
    return h.join(r, "query", "left").join(e, "query", "left").select("node", "query", F.coalesce("r", "e").alias("dna"))


_UP = """RECURSIVE up AS (
    SELECT node_id, node_id AS ancestor_id, 0 AS steps, 0.0::DOUBLE AS distance FROM tree_node
    UNION ALL
    SELECT u.node_id, t.parent_id, u.steps + 1, u.distance + greatest(coalesce(t.branch_length, 0), 0) FROM up u JOIN tree_node t ON t.node_id = u.ancestor_id WHERE t.parent_id IS NOT NULL),
    tips AS (SELECT * FROM tree_node WHERE node_id NOT IN (SELECT parent_id FROM tree_node WHERE parent_id IS NOT NULL))"""


@query(f"WITH {_UP} SELECT node_id, ancestor_id, CAST(steps AS INT) AS steps, round(distance, 9) AS distance FROM up")
def t13_ancestry(spark: SparkSession, d: str) -> DataFrame:
    return ot.ancestry(tree(spark, d)).select("node_id", "ancestor_id", "steps", F.round("distance", 9).alias("distance"))


@query(f"""WITH {_UP}, w AS (SELECT name, CAST(coalesce(num_duplicates, 1) AS BIGINT) AS weight FROM ref_entry),
    b AS (SELECT ancestor_id AS node_id, count(*) AS nodes, CAST(sum(CASE WHEN tips.node_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS leaves, CAST(sum(CASE WHEN tips.node_id IS NULL THEN 0 ELSE coalesce(w.weight, 1) END) AS BIGINT) AS weight
          FROM up LEFT JOIN tips USING (node_id) LEFT JOIN w ON w.name = tips.name GROUP BY ancestor_id),
    p AS (SELECT node_id, max(steps) AS depth FROM up GROUP BY node_id) SELECT * FROM b JOIN p USING (node_id)""")
def g13_tree_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    weights = references(spark, d).select("name", F.coalesce("num_duplicates", F.lit(1)).cast("long").alias("weight"))
    return ot.counts_below(t, ot.ancestry(t), weights)


@query(f"""WITH {_UP}, p AS (SELECT u.node_id, coalesce(string_agg(CASE t.side WHEN 'left' THEN '0' WHEN 'right' THEN '2' END, '' ORDER BY u.steps DESC), '') AS path FROM up u JOIN tree_node t ON t.node_id = u.ancestor_id GROUP BY u.node_id)
    SELECT node_id, row_number() OVER (ORDER BY path || '1') AS in_order, row_number() OVER (ORDER BY path || '3') AS post_order FROM p""")
def t13_traversal(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    return ot.traversal(t, ot.ancestry(t))


@query(f"""WITH {_UP}, p AS (SELECT u.node_id, coalesce(string_agg(CASE t.side WHEN 'left' THEN '0' WHEN 'right' THEN '2' END, '' ORDER BY u.steps DESC), '') AS path FROM up u JOIN tree_node t ON t.node_id = u.ancestor_id GROUP BY u.node_id)
    SELECT node_id, '#' || row_number() OVER (ORDER BY path || '3') || '#' AS label FROM p WHERE node_id NOT IN (SELECT node_id FROM tips)""")
def f21_node_labels(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes numbered in post-order."""
    t = tree(spark, d)
    inner = ot.traversal(t, ot.ancestry(t)).join(ot.leaves(t), "node_id", "left_anti")
    return numbered(inner.select("node_id", "post_order"), ["post_order"], "n").select("node_id", F.concat(F.lit("#"), "n", F.lit("#")).alias("label"))


@query(f"""WITH {_UP}, kept AS (SELECT node_id FROM tips WHERE name IN (SELECT name FROM ref_entry WHERE length(sequence) > 300)),
    live AS (SELECT DISTINCT ancestor_id AS node_id FROM up JOIN kept USING (node_id)),
    forks AS (SELECT parent_id AS node_id FROM tree_node JOIN live USING (node_id) WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 1),
    stay AS (SELECT node_id FROM forks UNION SELECT node_id FROM kept),
    nearest AS (SELECT u.node_id, ancestor_id, distance FROM up u JOIN stay s ON s.node_id = u.node_id JOIN stay a ON a.node_id = u.ancestor_id WHERE steps > 0 QUALIFY row_number() OVER (PARTITION BY u.node_id ORDER BY steps) = 1)
    SELECT node_id, ancestor_id AS parent_id, name, round(distance, 9) AS branch_length FROM stay LEFT JOIN nearest USING (node_id) JOIN tree_node USING (node_id)""")
def t05_pruned_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the longer references."""
    t = tree(spark, d)
    keep = references(spark, d).where("length(sequence) > 300").select("name")
    return ot.pruned(t, ot.ancestry(t), keep).withColumn("branch_length", F.round("branch_length", 9))


@query(f"""WITH {_UP}, q AS (SELECT node_id FROM tips WHERE tid IS NULL), r AS (SELECT node_id FROM tips WHERE tid IS NOT NULL),
    met AS (SELECT a.node_id AS query, b.node_id AS ref, a.ancestor_id, a.distance + b.distance AS distance, a.steps FROM up a JOIN q ON q.node_id = a.node_id JOIN up b ON b.ancestor_id = a.ancestor_id JOIN r ON r.node_id = b.node_id),
    low AS (SELECT query, ref, distance FROM met QUALIFY row_number() OVER (PARTITION BY query, ref ORDER BY steps) = 1)
    SELECT query, ref, round(distance, 9) AS distance FROM low QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), ref) = 1""")
def j13_nearest_reference(spark: SparkSession, d: str) -> DataFrame:
    """For each leaf without a taxon, the nearest along the tree that has one."""
    t = tree(spark, d)
    return ot.nearest_tagged(ot.leaves(t), ot.ancestry(t))


@query("""WITH c AS (SELECT p.node_id, l.branch_length AS a, r.branch_length AS b, p.branch_length AS u FROM tree_node p JOIN tree_node l ON l.parent_id = p.node_id AND l.side = 'left' JOIN tree_node r ON r.parent_id = p.node_id AND r.side = 'right'),
    e AS (SELECT node_id, abs(coalesce(a, 0)) AS d12, abs(coalesce(b, 0)) AS d13, abs(coalesce(a, 0)) + abs(coalesce(b, 0)) + abs(coalesce(u, 0)) AS d23 FROM c)
    SELECT node_id, round((d12 + d13 - d23) / 2, 9) AS l1, round((d23 + d12 - d13) / 2, 9) AS l2, round((d23 + d13 - d12) / 2, 9) AS l3 FROM e""")
def g08_three_point_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the three branches that meet in a node, from the distances of the three ends."""
    t = tree(spark, d)
    child = lambda side, name: t.where(F.col("side") == side).select(F.col("parent_id").alias("node_id"), F.abs(F.coalesce("branch_length", F.lit(0.0))).alias(name))
    e = t.select("node_id", F.abs(F.coalesce("branch_length", F.lit(0.0))).alias("u")).join(child("left", "d12"), "node_id").join(child("right", "d13"), "node_id").withColumn("d23", F.col("d12") + F.col("d13") + F.col("u"))
    half = lambda x, y, z: F.round((F.col(x) + F.col(y) - F.col(z)) / 2, 9)
    return e.select("node_id", half("d12", "d13", "d23").alias("l1"), half("d23", "d12", "d13").alias("l2"), half("d23", "d13", "d12").alias("l3"))


@query("SELECT p.node_id, round(sum(least(CASE WHEN c.branch_length > 0 THEN c.branch_length ELSE 0.001 END, 0.2)), 9) AS distance FROM tree_node p JOIN tree_node c ON c.parent_id = p.node_id GROUP BY p.node_id")
def m12_node_distances(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d).where("parent_id is not null").select(F.col("parent_id").alias("node_id"), fs.branch_length(F.col("branch_length")).alias("l"))
    return c.groupBy("node_id").agg(F.round(F.sum("l"), 9).alias("distance"))


_PAIRED = f"""WITH {RECORDS}, e AS (SELECT name, min(seq) AS seq FROM rec GROUP BY name),
    s AS (SELECT anchor_id, a.seq AS q, b.seq AS t, substr(a.seq, start_1 + 1, length) AS x, substr(b.seq, start_2 + 1, length) AS y
          FROM anchor JOIN e a ON a.name = seq_1 JOIN e b ON b.name = seq_2 WHERE plus_1 AND plus_2 AND length > 0 AND start_1 >= 0 AND start_2 >= 0),
    m AS (SELECT *, least(length(x), length(y)) AS aligned, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, CAST(i AS INT), 1) = substr(y, CAST(i AS INT), 1))) AS matched FROM s)"""


@query(_PAIRED + " SELECT anchor_id, aligned, CAST(matched AS INT) AS matched, round(aligned / length(q), 9) AS overlap, round(matched / aligned, 9) AS identity FROM m WHERE aligned > 0")
def g06_overlap_identity(spark: SparkSession, d: str) -> DataFrame:
    """Overlap and identity of the two records along each forward anchor."""
    e = records(spark, d).groupBy("name").agg(F.min("seq").alias("seq"))
    a, b = e.select(F.col("name").alias("seq_1"), F.col("seq").alias("q")), e.select(F.col("name").alias("seq_2"), F.col("seq").alias("t"))
    rows = anchors(spark, d).where("plus_1 and plus_2 and length > 0 and start_1 >= 0 and start_2 >= 0").join(a, "seq_1").join(b, "seq_2")
    cut = rows.select("anchor_id", "q", F.expr("substring(q, start_1 + 1, length)").alias("x"), F.expr("substring(t, start_2 + 1, length)").alias("y"))
    m = cut.withColumn("aligned", F.least(F.length("x"), F.length("y"))).where("aligned > 0")
    same = F.expr("size(filter(sequence(1, aligned), i -> substring(x, i, 1) = substring(y, i, 1)))")
    m = m.withColumn("matched", same)
    return m.select("anchor_id", "aligned", "matched", F.round(F.col("aligned") / F.length("q"), 9).alias("overlap"), F.round(F.col("matched") / F.col("aligned"), 9).alias("identity"))


@query(f"""WITH {_UP}, q AS (SELECT node_id FROM tips WHERE tid IS NULL), r AS (SELECT node_id FROM tips WHERE tid IS NOT NULL),
    met AS (SELECT a.node_id AS query, b.node_id AS ref, a.distance + b.distance AS distance, a.steps FROM up a JOIN q ON q.node_id = a.node_id JOIN up b ON b.ancestor_id = a.ancestor_id JOIN r ON r.node_id = b.node_id),
    low AS (SELECT query, ref, distance FROM met QUALIFY row_number() OVER (PARTITION BY query, ref ORDER BY steps) = 1),
    near AS (SELECT query, ref FROM low QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), ref) = 1),
    kept AS (SELECT query AS node_id FROM near UNION SELECT ref FROM near),
    live AS (SELECT DISTINCT ancestor_id AS node_id FROM up JOIN kept USING (node_id)),
    forks AS (SELECT parent_id AS node_id FROM tree_node JOIN live USING (node_id) WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 1),
    stay AS (SELECT node_id FROM forks UNION SELECT node_id FROM kept),
    above AS (SELECT u.node_id, ancestor_id, distance FROM up u JOIN stay s ON s.node_id = u.node_id JOIN stay a ON a.node_id = u.ancestor_id WHERE steps > 0 QUALIFY row_number() OVER (PARTITION BY u.node_id ORDER BY steps) = 1)
    SELECT node_id, ancestor_id AS parent_id, name, round(distance, 9) AS branch_length FROM stay LEFT JOIN above USING (node_id) JOIN tree_node USING (node_id)""")
def t10_nearest_kept(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the leaves without a taxon and of the nearest one with a taxon to each."""
    t = tree(spark, d)
    near = j13_nearest_reference(spark, d)
    ids = near.select(F.col("query").alias("node_id")).union(near.select("ref")).distinct()
    keep = t.select("node_id", "name").join(ids, "node_id", "left_semi").select("name")
    return ot.pruned(t, ot.ancestry(t), keep).withColumn("branch_length", F.round("branch_length", 9))
