"""Formats: written to text, read back, and formatted by columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.plans.tables import RECORDS, REFERENCES, records, references, tree
from sedgeline.sources import formats as sf
from sedgeline.sources import writers as sw
from sedgeline.workspace import new_path

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {RECORDS} SELECT name, trim(regexp_replace(coalesce(comment, ''), '\\s+', ' ', 'g')) AS comment, seq AS sequence, coalesce(try_cast(nullif(regexp_extract(comment, '(^|\\s)NumDuplicates=(\\S*)', 2), '') AS INT), 1) AS num_duplicates FROM rec WHERE name IS NOT NULL")
def s02_k03_fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All records written as FASTA files and read back."""
    path = new_path(spark, "fasta")
    records(spark, d).where("name is not null").select(sw.fasta(F.col("name"), F.regexp_replace("comment", "\\s+", " "), F.col("seq")).alias("value")).write.text(path)
    return sf.read_fasta(spark, path).select("name", "comment", "sequence", "num_duplicates")


@query(f"WITH {RECORDS} SELECT name, seq AS sequence, quality FROM rec WHERE name IS NOT NULL AND length(seq) = length(quality)")
def s04_k08_fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records whose quality is as long as their letters, written as FASTQ and read back."""
    path = new_path(spark, "fastq")
    rows = records(spark, d).where("name is not null and length(seq) = length(quality)")
    rows.select(sw.fastq(F.col("name"), F.lit(""), F.col("seq"), F.col("quality")).alias("value")).write.text(path)
    return sf.read_fastq(spark, path).select("name", "sequence", "quality")


@query(f"WITH {REFERENCES} SELECT name, CAST(length(seq) AS INT) AS sites, CAST(2 * length(seq) - 1 AS INT) AS edges, true AS at_most_one FROM ref WHERE seq <> ''")
def s05_k09_graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """References as graph text, with a second edge into each site that asks for more weight than is left, and parsed."""
    chars = F.filter(F.split("seq", ""), lambda c: c != "")
    lines = F.transform(chars, lambda c, i: F.concat((i + 1).cast("string"), F.lit(" "), c, F.lit("; "), i.cast("string"), F.lit(" "), (i + 1).cast("string"), F.lit(" 0.8;"), F.when(i > 0, F.concat(F.lit(" "), (i - 1).cast("string"), F.lit(" "), (i + 1).cast("string"), F.lit(" 0.6;"))).otherwise("")))
    text = references(spark, d).where("seq <> ''").select(F.concat(F.lit("# "), "name", F.lit("\n"), F.array_join(lines, "\n")).alias("text"))
    graphs = sf.parse_graphs(text, "text")
    second = F.filter("edges", lambda e: e["start"] < e["end"] - 1)
    return graphs.select("name", F.size("sites").alias("sites"), F.size("edges").alias("edges"), F.forall(second, lambda e: e["weight"] < 0.2001).alias("at_most_one"))


@query("WITH n AS (SELECT run, pos, entry_id, name, row_number() OVER (PARTITION BY name ORDER BY run, pos, entry_id, loaded_at) - 1 AS k FROM fasta_entry WHERE name IS NOT NULL) SELECT run, pos, entry_id, CASE WHEN k > 0 THEN name || '.' || k ELSE name END AS name FROM n")
def s06_renamed_on_read(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/fasta_entry.parquet").where("name is not null").select("run", "pos", "entry_id", "name", "loaded_at")
    return sf.renamed_duplicates(rows, "name", ["run", "pos", "entry_id", "loaded_at"]).drop("loaded_at")


@query("WITH n AS (SELECT entry_id, name, row_number() OVER (PARTITION BY name ORDER BY entry_id, loaded_at) AS k, count(*) OVER (PARTITION BY name) AS c FROM fasta_entry WHERE name IS NOT NULL) SELECT entry_id, CASE WHEN c > 1 THEN name || '/' || k ELSE name END AS name FROM n")
def k02_numbered_on_write(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/fasta_entry.parquet").where("name is not null").select("entry_id", "name", "loaded_at")
    return sw.numbered_duplicates(rows, "name", ["entry_id", "loaded_at"]).drop("loaded_at")


@query("SELECT t.name, p.name AS parent, t.side, t.branch_length, nullif(t.tid, '') AS tid FROM tree_node t LEFT JOIN tree_node p ON p.node_id = t.parent_id")
def s08_k12_newick_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The guide tree printed with lengths and tags, and parsed. A guide tree is one text, which one task prints and parses."""
    schema = "node_id int, parent_id int, side string, name string, branch_length double, tid string"

    def trip(frames):
        import pandas as pd

        for frame in frames:
            rows = [{k: None if v is None or v != v else v for k, v in r.items()} for r in frame.to_dict("records")]
            if rows:
                parsed = sf.tree_rows(sf.binary(sf.parse_newick(sw.newick(rows, tags=True))))
                yield pd.DataFrame(parsed, columns=["node_id", "parent_id", "side", "name", "branch_length", "tid"])

    one = tree(spark, d).select("node_id", "parent_id", "side", "name", "branch_length", "tid").groupBy(F.lit(1).alias("tree")).agg(F.collect_list(F.struct("node_id", "parent_id", "side", "name", "branch_length", "tid")).alias("nodes"))
    back = one.select("nodes").mapInPandas(lambda frames: trip(_spread(frames)), schema)
    return back.select("name", "parent_id", "side", "branch_length", "tid").join(back.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("name", "parent", "side", "branch_length", "tid")


def _spread(frames):
    """Each tree's list of nodes as a frame of its own."""
    import pandas as pd

    for frame in frames:
        for nodes in frame["nodes"]:
            yield pd.DataFrame([n if isinstance(n, dict) else n.asDict() for n in nodes])


_WRAP = "rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10))"


@query(f"WITH {REFERENCES} SELECT pos, rpad(substr(name, 1, 10), 10, ' ') || chr(10) || {_WRAP} AS phylip, name || chr(10) || {_WRAP} AS paml, name || chr(10) || seq AS raxml FROM ref")
def k05_k06_sequential(spark: SparkSession, d: str) -> DataFrame:
    """References in the three sequential layouts."""
    n, s = F.col("name"), F.col("seq")
    return references(spark, d).select("pos", sw.sequential(n, s).alias("phylip"), sw.sequential(n, s, name_width=None).alias("paml"), sw.long_sequential(n, s).alias("raxml"))


_BLOCKS = "b AS (SELECT pos AS place, name, seq, unnest(range(0, CAST(greatest(ceil(length(seq) / 60.0), 1) AS INT))) AS block FROM ref)"


@query(f"WITH {REFERENCES}, {_BLOCKS} SELECT CAST(block AS INT) AS block, place, CASE WHEN block = 0 THEN rpad(substr(name, 1, 10), 10, ' ') ELSE repeat(' ', 10) END || ' ' || substr(seq, CAST(block AS INT) * 60 + 1, 60) AS line FROM b")
def k04_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return sw.interleaved(references(spark, d), "name", "seq", "pos")


@query(f"""WITH {REFERENCES}, {_BLOCKS}, h AS (SELECT count(*) AS n, max(length(seq)) AS w, sum(length(regexp_replace(seq, '[^ACGTUN]', '', 'g'))) / sum(length(seq)) AS share FROM ref)
    SELECT -1 AS block, 0::BIGINT AS place, '#nexus' || chr(10) || 'begin data;' || chr(10) || 'dimensions ntax=' || n || ' nchar=' || w || ';' || chr(10) || 'format datatype=' || CASE WHEN share > 0.9 THEN 'dna' ELSE 'protein' END || ' interleave=yes gap=-;' || chr(10) || 'matrix' AS line FROM h
    UNION ALL SELECT CAST(block AS INT), place, CASE WHEN block = 0 THEN rpad('''' || substr(name, 1, 20) || '''', 22, ' ') ELSE repeat(' ', 22) END || ' ' || substr(seq, CAST(block AS INT) * 60 + 1, 60) FROM b
    UNION ALL SELECT 1073741824, 0, ';' || chr(10) || 'end;' FROM h""")
def k07_nexus(spark: SparkSession, d: str) -> DataFrame:
    return sw.nexus(references(spark, d), "name", "seq", "pos")


@query("SELECT query, node, score, q_start, q_end, t_start, t_end, q_strand, t_strand FROM hit WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL AND q_start >= 0 AND q_end >= 0 AND t_start >= 0 AND t_end >= 0 AND q_strand <> '' AND t_strand <> ''")
def s13_hit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hits as lines, among others, and parsed."""
    known = spark.read.parquet(f"{d}/hit.parquet").where("query is not null and node is not null and score is not null and q_start >= 0 and q_end >= 0 and t_start >= 0 and t_end >= 0 and q_strand <> '' and t_strand <> ''")
    lines = known.select(F.explode(F.array(F.concat_ws(" ", F.lit("sugar:"), "query", "q_start", "q_end", "q_strand", "node", "t_start", "t_end", "t_strand", "score"), F.lit("-- comment"))).alias("line"))
    return sf.parse_hits(lines, "line")


@query(f"WITH {REFERENCES} SELECT name FROM ref ORDER BY coalesce(num_duplicates, 1) DESC, pos LIMIT 1")
def s11_single_reference(spark: SparkSession, d: str) -> DataFrame:
    """The reference that stands for most sequences, where a pile of reads has none: the first of equals."""
    return references(spark, d).agg(F.max_by("name", F.struct(F.coalesce("num_duplicates", F.lit(1)), -F.col("pos"))).alias("name"))
