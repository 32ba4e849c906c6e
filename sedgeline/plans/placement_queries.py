"""Placing reads: modes, candidates, ORFs as queries, piles, grafts into alignments and trees."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import grafting as og
from sedgeline.operators import hits as oh
from sedgeline.operators import placement as pl
from sedgeline.operators import trees as ot
from sedgeline.plans.alignment_queries import _FAMILIES, families
from sedgeline.plans.column_queries import _ROWS, _rows
from sedgeline.plans.relational_queries import _MERGED, _MORE
from sedgeline.plans.scalar_queries import orf_sql, orfs
from sedgeline.plans.tables import RECORDS, records, tree
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


@query("""WITH b AS (SELECT unnest([false, true]) AS v) SELECT p.v AS pileup, o.v AS find_orfs, f.v AS fragments, s.v AS one_by_one,
    CASE WHEN p.v THEN 'pileup' WHEN f.v THEN 'fragments' WHEN s.v THEN 'one-by-one' ELSE 'search' END || CASE WHEN o.v THEN '-orf' ELSE '' END AS mode FROM b p, b o, b f, b s""")
def r01_modes(spark: SparkSession, d: str) -> DataFrame:
    """How reads are placed under each combination of options."""
    rows = [(*flags, pl.placement_mode(*flags)) for flags in product((False, True), repeat=4)]
    return spark.createDataFrame(rows, "pileup boolean, find_orfs boolean, fragments boolean, one_by_one boolean, mode string")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """The families' members as reads (fam, k, node_id, seq)."""
    members, _ = families(spark, d)
    return members.select(F.floor(F.col("node_id") / 8).cast("int").alias("fam"), (F.col("node_id") % 8 - 4).cast("int").alias("k"), "node_id", "seq")


@query(f"{_FAMILIES} SELECT node_id, seq AS ungapped, true AS same_width FROM members WHERE seq <> ''")
def r02_pileup(spark: SparkSession, d: str) -> DataFrame:
    """Each family's members piled up in order; what must hold: all are near enough to be used, and rows without gaps are the members."""
    rows = stored(pl.pileup(_reads(spark, d), "fam", "k", "seq"), "pile")
    width = rows.groupBy("fam").agg(F.max(F.length("row")).alias("w"))
    return rows.join(width, "fam").select((F.col("fam") * 8 + 4 + F.col("k")).cast("int").alias("node_id"), F.replace("row", F.lit("-"), F.lit("")).alias("ungapped"), (F.length("row") == F.col("w")).alias("same_width"))


_BEST_ORF = f"""{_FAMILIES}, {orf_sql('members', 'node_id', 20)}, best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY "end" - start DESC, frame, start) = 1),
    cut AS (SELECT node_id, frame, substr(seq, CAST(start AS INT) + 1, CAST("end" - start + 1 AS INT)) AS s FROM best JOIN members USING (node_id))"""


@query(f"{_BEST_ORF} SELECT node_id, CASE WHEN frame > 0 THEN s ELSE reverse(translate(s, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) END AS orf FROM cut")
def r03_pileup_orfs(spark: SparkSession, d: str) -> DataFrame:
    """The longest ORF of each read, of which piles are made: its letters, restored from the pile where they were used."""
    reads = stored(_reads(spark, d).repartition(16), "reads")
    best = stored(pl.best_orfs(orfs(reads, "node_id", "seq", 20), reads, "node_id", "seq"), "orfs")
    piled = pl.pileup(best.join(reads.select("node_id", "fam", "k"), "node_id"), "fam", "k", "orf")
    used = piled.where("used").select((F.col("fam") * 8 + 4 + F.col("k")).cast("int").alias("node_id"), F.replace("row", F.lit("-"), F.lit("")).alias("used"))
    # A pile may have turned a read around.
    same = (F.col("used") == F.col("orf")) | (F.col("used") == pl.reverse_complement(F.col("orf")))
    return best.join(used, "node_id", "left").select("node_id", F.when(F.col("used").isNull() | same, F.col("orf")).otherwise(F.col("used")).alias("orf"))


@query(f"{_FAMILIES} SELECT CAST(fam AS INT) AS fam, CAST(node_id AS VARCHAR) AS name, true AS earlier FROM members WHERE node_id % 8 > 4 AND seq <> ''")
def r05_one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """Families' members placed one after another on the first and on those placed before: all find one that came earlier."""
    reads = _reads(spark, d).withColumn("name", F.col("node_id").cast("string"))
    found = og.one_by_one(reads.where("k > 0"), "fam", "k", "name", "seq", reads.where("k = 0"))
    return found.select("fam", "name", (F.col("node").cast("int") < F.col("name").cast("int")).alias("earlier"))


# Queries that are known to belong to a reference: its letters with some added and some left out.
_QUERY = "concat(substr(seq, 1, 20), 'ACGTTGCA', substr(seq, 21, 30), substr(seq, 57))"
_GRAFT = _ROWS + f""", queries AS (SELECT tid, name || '_q' AS query, name AS node, {_QUERY} AS seq FROM (SELECT tid, name, replace(row, '-', '') AS seq FROM rows) WHERE seq <> '')"""


def _grafts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(_rows(spark, d).withColumnRenamed("tid", "alignment"), "rows")
    plain = rows.select("alignment", "name", F.replace("row", F.lit("-"), F.lit("")).alias("seq")).where("seq <> ''")
    queries = plain.select(F.concat("name", F.lit("_q")).alias("query"), F.col("name").alias("node"), F.expr(_QUERY).alias("seq"))
    return rows, queries.select("query", "node"), queries.select(F.col("query").alias("name"), "seq")


@query(f"WITH {_GRAFT} SELECT query AS name, seq AS ungapped, true AS same_width FROM queries UNION ALL SELECT name, replace(row, '-', ''), true FROM rows WHERE row <> ''")
def r04_batch_grafts(spark: SparkSession, d: str) -> DataFrame:
    """All queries grafted at once into the alignments of their targets: rows without gaps are the sequences, and an alignment's rows are as wide."""
    rows, placed, queries = _grafts(spark, d)
    out = stored(og.grafted_rows(rows, og.grafted_cells(rows, placed, queries)), "grafted")
    width = out.groupBy("alignment").agg(F.max(F.length("row")).alias("w"))
    return out.join(width, "alignment").select("name", F.replace("row", F.lit("-"), F.lit("")).alias("ungapped"), (F.length("row") == F.col("w")).alias("same_width"))


@query(f"WITH {_GRAFT}, pairs AS (SELECT tid, a.name AS a, count(*) AS letters FROM cells a WHERE letter <> '-' GROUP BY ALL) SELECT tid AS alignment, a AS name, letters, 0::BIGINT AS moved FROM pairs")
def r07_j07_graft_columns(spark: SparkSession, d: str) -> DataFrame:
    """Grafting moves no reference letter against the others: letters that shared a column still do, and no new column holds one."""
    rows, placed, queries = _grafts(spark, d)
    out = stored(og.grafted_rows(rows, og.grafted_cells(rows, placed, queries)), "grafted").where("not added")
    of = lambda df: df.select("alignment", "name", F.posexplode(F.split("row", "")).alias("i", "c")).where("c <> '' and c <> '-'")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("alignment", "name").orderBy("i"))
    old, new = of(rows).withColumn("nth", nth), of(out).withColumn("nth", nth)
    both = old.withColumnRenamed("i", "old").join(new.withColumnRenamed("i", "new"), ["alignment", "name", "nth", "c"], "left")
    column = Window.partitionBy("alignment", "old")
    moved = both.withColumn("spread", F.min("new").over(column) < F.max("new").over(column))
    return moved.groupBy("alignment", "name").agg(F.count("*").alias("letters"), F.count_if(F.col("spread") | F.col("new").isNull()).alias("moved"))


@query("""WITH t AS (SELECT c.name, p.name AS parent, c.side, c.branch_length FROM tree_node c LEFT JOIN tree_node p ON p.node_id = c.parent_id), k AS (SELECT name AS node, '#' || name || '.1#' AS inner_1, '#' || name || '.2#' AS inner_2 FROM ref_entry WHERE name IN (SELECT name FROM tree_node))
    SELECT name, CASE WHEN node IS NULL THEN parent ELSE inner_1 END AS parent, CASE WHEN node IS NULL THEN side ELSE 'left' END AS side, CASE WHEN node IS NULL THEN branch_length ELSE 0.001 END AS branch_length FROM t LEFT JOIN k ON node = name
    UNION ALL SELECT inner_1, inner_2, 'left', 0.001 FROM k UNION ALL SELECT inner_2, parent, side, branch_length FROM k JOIN t ON name = node
    UNION ALL SELECT node || '_q1', inner_1, 'right', 0.1 FROM k UNION ALL SELECT node || '_q2', inner_2, 'right', 0.1 FROM k""")
def r07_graft_tree(spark: SparkSession, d: str) -> DataFrame:
    """The guide tree with two queries grafted above each leaf that has a reference."""
    t = tree(spark, d)
    named = t.select("name", "parent_id", "side", "branch_length").join(t.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("name", "parent", "side", "branch_length")
    refs = spark.read.parquet(f"{d}/ref_entry.parquet").select("name").join(t.select("name"), "name", "left_semi")
    placed = refs.select(F.col("name").alias("node"), F.explode(F.array(F.lit("_q1"), F.lit("_q2"))).alias("q")).select(F.concat("node", "q").alias("query"), "node")
    return og.grafted_tree(named, placed)


@query(f"""WITH RECURSIVE {_MERGED}, s AS MATERIALIZED (SELECT query, node_id, max(score) AS score FROM merged JOIN tree_node ON name = node GROUP BY query, node_id),
    best AS (SELECT query, node_id AS leaf FROM s WHERE node_id NOT IN (SELECT parent_id FROM tree_node WHERE parent_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) = 1),
    up AS (SELECT s.query, leaf, leaf AS node_id, 0 AS steps, s.score FROM best JOIN s ON s.query = best.query AND s.node_id = leaf
        UNION ALL SELECT u.query, u.leaf, t.parent_id, u.steps + 1, s.score FROM up u JOIN tree_node t ON t.node_id = u.node_id JOIN s ON s.query = u.query AND s.node_id = t.parent_id WHERE s.score >= u.score)
    SELECT query, leaf, max_by(node_id, steps) AS node FROM up GROUP BY query, leaf""")
def r08_upward_search(spark: SparkSession, d: str) -> DataFrame:
    """From each query's best leaf up the tree, as long as the hits on the node above score at least as high."""
    t = tree(spark, d)
    scores = _MORE(spark, d).join(t.select(F.col("name").alias("node"), "node_id"), "node").groupBy("query", "node_id").agg(F.max("score").alias("score"))
    return og.upward(stored(scores, "scores"), t, ot.ancestry(t).select("node_id", "ancestor_id", "steps"))


@query(f"""WITH {RECORDS}, {orf_sql('rec', 'entry_id', 50)}
    SELECT entry_id, name || '_orf' || row_number() OVER (PARTITION BY entry_id ORDER BY frame, start) AS name, '[' || frame || '.' || (start + 1) || '.' || ("end" + 1) || ']' AS comment, translation FROM found JOIN rec USING (entry_id)""")
def r09_orf_queries(spark: SparkSession, d: str) -> DataFrame:
    """ORFs of the records as queries of their own."""
    e = records(spark, d)
    return pl.orf_queries(orfs(e, "entry_id", "seq").join(e.select("entry_id", F.col("name").alias("read")), "entry_id"), "entry_id", "read")


@query(f"""WITH {_MERGED}, q AS (SELECT DISTINCT name AS query, CASE WHEN tid IN (SELECT tid FROM tree_node WHERE tid <> '') THEN tid END AS want FROM fasta_entry WHERE name IS NOT NULL),
    o AS (SELECT DISTINCT query, node, score FROM merged JOIN q USING (query) JOIN tree_node t ON t.name = node WHERE want IS NULL OR want = t.tid)
    SELECT query, node, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS place FROM o QUALIFY place <= 10""")
def r10_preselection(spark: SparkSession, d: str) -> DataFrame:
    """The ten best targets of each read by its hits, among the nodes of its taxon."""
    q = spark.read.parquet(f"{d}/fasta_entry.parquet").select(F.col("name").alias("query"), "tid").where("query is not null")
    return pl.preselected(_MORE(spark, d).select("query", "node", "score"), q, tree(spark, d))


@query(f"WITH {_MERGED}, w AS (SELECT query, node FROM merged QUALIFY rank() OVER (PARTITION BY query ORDER BY score DESC) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY node) - 1 AS k FROM w) SELECT query, node, CASE WHEN k > 0 THEN query || '.' || k ELSE query END AS label FROM n")
def r11_placement_names(spark: SparkSession, d: str) -> DataFrame:
    """Queries with several best nodes get numbered names."""
    best = oh.best_with_ties(_MORE(spark, d).select("query", "node", "score"), "query", "score", 1)
    return pl.numbered_placements(best.select("query", "node"))
