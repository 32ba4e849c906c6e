"""Outputs and further inputs: formats by name, trees, events, discarded reads, consensus, alignments as XML; domain tables, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.plans import column_queries as cq
from sedgeline.plans.column_queries import _CONSENSUS, _ROWS, _WHOLE, _run_sql
from sedgeline.plans.relational_queries import _MERGED, _MORE
from sedgeline.plans.tables import RECORDS, REFERENCES, anchors, hits, records, references, tree
from sedgeline.sources import formats as sf
from sedgeline.sources import writers as sw

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM (VALUES ('fasta', 'fasta', '.fas'), ('raxml', 'raxml', '.phy'), ('phylip', 'phylipi', '.phy'), ('phylipi', 'phylipi', '.phy'), ('phylips', 'phylips', '.phy'), ('nexus', 'nexus', '.nex'), ('paml', 'paml', '.phy'), ('clustal', 'fasta', '.fas')) f(name, format, suffix)")
def k01_formats(spark: SparkSession, d: str) -> DataFrame:
    """Which format each name stands for; an unknown one is fasta."""
    return spark.createDataFrame([(n, *sw.known_format(n)) for n in (*sw.FORMATS, "clustal")], "name string, format string, suffix string")


_WRAP = "rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10))"


@query(f"WITH {REFERENCES} SELECT 0 AS block, pos AS place, rpad(substr(name, 1, 10), 10, ' ') || chr(10) || {_WRAP} AS line FROM ref UNION ALL SELECT -1, 0, count(*) || ' ' || max(length(seq)) FROM ref")
def k01_k04_with_head(spark: SparkSession, d: str) -> DataFrame:
    """The references in a format chosen by its name, with its head of rows and columns."""
    return sw.formatted(references(spark, d), "name", "seq", "pos", "phylips")


@query(f"""WITH {REFERENCES}, c AS (SELECT name, seq, unnest(range(1, length(seq) + 1)) AS i FROM ref)
    SELECT name, '# ' || name || chr(10) || string_agg(i || ' ' || substr(seq, CAST(i AS INT), 1) || '; ' || (i - 1) || ' ' || i || ' 1.0;', chr(10) ORDER BY i) AS text FROM c GROUP BY name""")
def k09_graph_text(spark: SparkSession, d: str) -> DataFrame:
    """The references' chains as graph text."""
    chars = F.filter(F.split("seq", ""), lambda c: c != "")
    graphs = references(spark, d).where("seq <> ''").select("name", F.transform(chars, lambda c, i: F.struct((i + 1).alias("ix"), c.alias("ch"))).alias("sites"), F.transform(chars, lambda c, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.lit(1.0).alias("weight"))).alias("edges"))
    return sw.graph_text(graphs, "name", "sites", "edges")


@query("""SELECT p.name, nullif(p.tid, '') AS tid, count(*) AS children, bool_and(c.branch_length IS NOT NULL) AS with_lengths FROM tree_node c JOIN tree_node p ON p.node_id = c.parent_id GROUP BY ALL""")
def k12_k13_tree_files(spark: SparkSession, d: str) -> DataFrame:
    """The guide tree written as a file with tags, and read back: its inner nodes, and how many children they have."""
    from sedgeline.workspace import new_path

    rows = tree(spark, d).select("node_id", "parent_id", "side", "name", "branch_length", "tid").groupBy(F.lit(1).alias("tree")).agg(F.collect_list(F.struct("node_id", "parent_id", "side", "name", "branch_length", "tid")).alias("nodes"))
    path = new_path(spark, "nhx_tree")

    def texts(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"value": [sw.newick([n if isinstance(n, dict) else n.asDict() for n in nodes], tags=True) for nodes in frame["nodes"]]})

    rows.select("nodes").mapInPandas(texts, "value string").write.text(path)

    def parsed(frames):
        import pandas as pd

        for frame in frames:
            for value in frame["value"]:
                yield pd.DataFrame(sf.tree_rows(sf.binary(sf.parse_newick(value))), columns=["node_id", "parent_id", "side", "name", "branch_length", "tid"])

    back = spark.read.text(path).mapInPandas(parsed, "node_id int, parent_id int, side string, name string, branch_length double, tid string")
    parent = back.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent"), F.col("tid").alias("ptid"))
    per = back.join(parent, "parent_id").groupBy("parent", "ptid").agg(F.count("*").alias("children"), F.bool_and(F.col("branch_length").isNotNull()).alias("with_lengths"))
    return per.select(F.col("parent").alias("name"), F.col("ptid").alias("tid"), "children", "with_lengths")


_LINE = "CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '..' || last END || CASE kind WHEN 'sub' THEN ' ' || change WHEN 'ins' THEN ' insertion' ELSE ' deletion' END"


@query(f"""WITH {_WHOLE}, {_run_sql('del', 'p', 'c')}, {_run_sql('ins', 'c', 'p')}, ev AS (SELECT node_id, 'sub' AS kind, site AS first, site AS last, p || ' -> ' || c AS change FROM cells WHERE p <> '-' AND c <> '-' AND p <> c UNION ALL SELECT * FROM del UNION ALL SELECT * FROM ins)
    SELECT node_id AS branch, 'branch ' || node_id || chr(10) || string_agg({_LINE}, chr(10) ORDER BY first, last, kind) AS lines FROM ev GROUP BY node_id""")
def k14_event_report(spark: SparkSession, d: str) -> DataFrame:
    """The events of each branch as lines."""
    return sw.event_lines(cq.w14_g16_whole_events(spark, d), "node_id")


@query(f"""WITH {RECORDS}
    SELECT entry_id, '>' || name || chr(10) || rtrim(regexp_replace(seq, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10)) AS fasta FROM rec WHERE name IS NOT NULL AND name NOT IN (SELECT query FROM hit WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL)""")
def k15_discarded(spark: SparkSession, d: str) -> DataFrame:
    """Reads that no hit places anywhere, as FASTA."""
    placed = hits(spark, d).where("query is not null and node is not null and score is not null").select(F.col("query").alias("name"))
    left = records(spark, d).where("name is not null").join(placed, "name", "left_anti")
    return left.select("entry_id", sw.fasta(F.col("name"), F.lit(""), F.col("seq")).alias("fasta"))


@query(f"""WITH {_CONSENSUS}, s AS (SELECT tid, string_agg(replace(letter, '-', ''), '' ORDER BY site) AS seq FROM cons GROUP BY tid)
    SELECT tid, '>consensus_' || tid || chr(10) || rtrim(regexp_replace(seq, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10)) AS fasta FROM s""")
def k16_consensus_files(spark: SparkSession, d: str) -> DataFrame:
    """Each taxon's consensus without gaps, as FASTA."""
    s = cq._consensus(spark, d).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("site", "letter"))).alias("x"))
    seq = F.replace(F.array_join(F.transform("x", lambda x: x["letter"]), ""), F.lit("-"), F.lit(""))
    return s.select("tid", seq.alias("seq")).select("tid", sw.fasta(F.concat(F.lit("consensus_"), "tid"), F.lit(""), F.col("seq")).alias("fasta"))


@query(f"""WITH {_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY name) AS k FROM rows)
    SELECT tid, '<ms_alignment>' || chr(10) || '<newick>(' || tid || ');</newick>' || chr(10) || '<nodes>' || chr(10) || string_agg('<leaf id="seq' || k || '" name="' || name || '">' || row || '</leaf>', chr(10) ORDER BY name) || chr(10) || '</nodes>' || chr(10) || '</ms_alignment>' AS xml FROM n GROUP BY tid""")
def k11_xml_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Each taxon's rows as an XML alignment with a tree."""
    rows = cq._rows(spark, d).withColumn("leaf", F.lit(True))
    trees = rows.select("tid").distinct().withColumn("newick", F.concat(F.lit("("), "tid", F.lit(");")))
    return sw.xml_alignment(rows, "tid", "name", "row", "leaf", trees)


@query(f"""WITH {_ROWS}, keep AS (SELECT tid, name FROM rows SEMI JOIN (SELECT DISTINCT node AS name FROM hit) USING (name)), good AS (SELECT DISTINCT tid, site FROM cells SEMI JOIN keep USING (tid, name) WHERE letter <> '-')
    SELECT tid, name, string_agg(letter, '' ORDER BY site) AS row FROM cells SEMI JOIN keep USING (tid, name) JOIN good USING (tid, site) GROUP BY tid, name""")
def t12_pruned_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The rows of leaves that are hit, without the columns that only the others have."""
    from sedgeline.operators.alignments import without_gap_columns

    kept = cq._rows(spark, d).join(hits(spark, d).select(F.col("node").alias("name")).distinct(), "name", "left_semi")
    return without_gap_columns(kept, "tid", "name", "row").where("row <> ''")


@query("SELECT seq_1, seq_2, start_1, start_2, length, score, plus_1, plus_2 FROM anchor WHERE seq_1 IS NOT NULL AND seq_2 IS NOT NULL AND start_1 >= 0 AND start_2 >= 0 AND length > 1 AND score IS NOT NULL AND plus_1 IS NOT NULL AND plus_2 IS NOT NULL")
def s14_segments(spark: SparkSession, d: str) -> DataFrame:
    """Anchors as segment lines, among others, and parsed."""
    known = anchors(spark, d).where("seq_1 is not null and seq_2 is not null and start_1 >= 0 and start_2 >= 0 and length > 1 and score is not null and plus_1 is not null and plus_2 is not null")
    ends = lambda n: (F.when(F.col(f"plus_{n}"), F.col(f"start_{n}") + 1).otherwise(F.col(f"start_{n}") + F.col("length")), F.when(F.col(f"plus_{n}"), F.col(f"start_{n}") + F.col("length")).otherwise(F.col(f"start_{n}") + 1))
    line = F.concat_ws("\t", "seq_1", "seq_2", *ends(1), *ends(2), "score")
    return sf.parse_segments(known.select(F.explode(F.array(line, F.lit("# no segment"))).alias("line")), "line")


@query(f"""WITH {_MERGED}, m AS (SELECT query AS sequence, 1.0 / (1 + score) AS e, q_start + 1 AS a, q_end AS b FROM merged WHERE q_start >= 0 AND q_end > q_start AND score >= 0 AND query NOT LIKE '% %' AND query <> ''), best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY e, a, b) = 1)
    SELECT sequence, a - 1 AS start, 5 AS length FROM best UNION ALL SELECT sequence, greatest(b - 5, a - 1), 5 FROM best""")
def s15_domain_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as a domain table, and the anchors at the ends of each sequence's best domain."""
    m = _MORE(spark, d).where("q_start >= 0 and q_end > q_start and score >= 0 and query not like '% %' and query <> ''")
    blank = [F.lit("-")] * 8
    line = F.concat_ws(" ", "query", *blank[:2], "node", *blank, (1 / (1 + F.col("score"))).cast("string"), *blank[:4], F.col("q_start") + 1, "q_end", F.lit("."))
    return sf.domain_anchors(m.select(F.explode(F.array(line, F.lit("# comment"))).alias("line")), "line")


@query(f"WITH {REFERENCES} SELECT '#' || name || '#' AS name, seq AS sequence FROM ref WHERE seq <> ''")
def s12_relaxed_phylip(spark: SparkSession, d: str) -> DataFrame:
    """The references in the relaxed layout, an alignment of one row each, and parsed."""
    from sedgeline.functions.sequence import wrapped

    r = references(spark, d).where("seq <> ''")
    return sf.parse_relaxed_phylip(r.select(F.concat(F.lit("1 "), F.length("seq"), F.lit("\n"), "name", F.lit("  "), wrapped(F.col("seq"), 50), F.lit("\n\n")).alias("text")), "text")


@query("SELECT query, node, score, q_start, q_end, t_start, t_end, q_strand, t_strand, CAST(abs(q_end - q_start) AS INT) AS matched FROM hit WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL AND q_start >= 0 AND q_end >= 0 AND t_start >= 0 AND t_end >= 0 AND q_strand <> '' AND t_strand <> ''")
def s13_gapped_hit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hits as lines with operations, among others, and parsed."""
    known = spark.read.parquet(f"{d}/hit.parquet").where("query is not null and node is not null and score is not null and q_start >= 0 and q_end >= 0 and t_start >= 0 and t_end >= 0 and q_strand <> '' and t_strand <> ''")
    n = F.abs(F.col("q_end") - F.col("q_start"))
    line = F.concat_ws(" ", F.lit("vulgar:"), "query", "q_start", "q_end", "q_strand", "node", "t_start", "t_end", "t_strand", "score", F.lit("M"), n, n, F.lit("G 0 3"))
    parsed = sf.parse_gapped_hits(known.select(F.explode(F.array(line, F.lit("sugar: x"))).alias("line")), "line")
    return parsed.select(*[c for c in parsed.columns if c != "ops"], F.expr("aggregate(filter(ops, o -> o.op = 'M'), 0, (s, o) -> s + o.query)").alias("matched"))
