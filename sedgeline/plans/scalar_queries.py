"""Scalar functions on whole tables: alphabets, translation, strands, quality, graphs of single sequences, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgeline.functions import sequence as fs
from sedgeline.plans.tables import RECORDS, REFERENCES, records, references, tree

QUERIES = {}
ORACLE_SQL = {}


def _each(name: str, columns, sql: str, source=records, cte: str = RECORDS, table: str = "rec", key: str = "entry_id"):
    """Registers a projection over a table: ``columns()`` gives its columns, ``sql`` the same select list."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select(key, *columns())

    query.__doc__ = f"{name}, a projection."
    QUERIES[name] = query
    ORACLE_SQL[name] = f"WITH {cte} SELECT {key}, {sql} FROM {table}"


def _seq() -> Column:
    return F.col("seq")


_PAIRS = [(a + b + d, r) for (a, b, d), r in zip(((a, b, d) for a in "TCAG" for b in "TCAG" for d in "TCAG"), fs.STANDARD_CODE, strict=True)]
_MITO = [(a + b + d, r) for (a, b, d), r in zip(((a, b, d) for a in "TCAG" for b in "TCAG" for d in "TCAG"), fs.MITO_CODE, strict=True)]


def _sniffed(text: Column) -> Column:
    """The format that the first character that isn't blank tells; null for none that is known."""
    first = F.substring(F.regexp_replace(text, "^\\s+", ""), 1, 1)
    return F.when(first == ">", "fasta").when(first == "@", "fastq").when(first == "#", "graph")


def _sql_map(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"


def _sql_codons(expr: str, per: str) -> str:
    return f"array_to_string(list_transform(range(0, CAST(ceil(length({expr}) / 3.0) AS INT)), lambda i: {per.replace('{c}', f'substr({expr}, CAST(i AS INT) * 3 + 1, 3)')}), '')"


_each("f01_dna_alphabet", lambda: [fs.dna_letters(_seq()).alias("dna"), (fs.dna_letters(_seq()) == _seq()).alias("clean")], "regexp_replace(seq, '[^ACGTRYMKWSBDHVN]', '', 'g') AS dna, regexp_replace(seq, '[^ACGTRYMKWSBDHVN]', '', 'g') = seq AS clean")
_each("f02_protein_alphabet", lambda: [fs.protein_letters(_seq()).alias("protein")], "regexp_replace(translate(seq, 'U', 'X'), '[^ARNDCQEGHILKMFPSTWYVX]', '', 'g') AS protein")
_each("f03_rna_to_dna", lambda: [fs.rna_to_dna(_seq()).alias("dna")], "replace(seq, 'U', 'T') AS dna")
_each("f04_degap", lambda: [fs.degap(F.col("sequence")).alias("ungapped")], "replace(sequence, '-', '') AS ungapped")
_each("f05_translate", lambda: [fs.translate_codons(_seq()).alias("protein"), fs.known_codons(_seq()).alias("codons")],
      _sql_codons("seq", "coalesce(" + _sql_map([p for p in _PAIRS if p[1] != "*"]) + "[{c}], 'X')") + " AS protein, " + _sql_codons("seq", "CASE WHEN regexp_full_match({c}, '[ACGT][ACGT][ACGT]') THEN {c} ELSE 'NNN' END") + " AS codons")
_each("f06_mito_translate", lambda: [fs.translate_codons(_seq(), fs.MITO_CODE).alias("protein")], _sql_codons("seq", "coalesce(" + _sql_map([p for p in _MITO if p[1] != "*"]) + "[{c}], 'X')") + " AS protein")
_each("f07_degenerate_translate", lambda: [fs.translate_degenerate(_seq()).alias("protein")], _sql_codons("seq", "coalesce(" + _sql_map(sorted(fs.degenerate_code().items())) + "[{c}], 'X')") + " AS protein")
_each("f08_back_translate", lambda: [fs.back_translate(fs.translate_codons(_seq()), _seq()).alias("codons")],
      "CASE WHEN length(seq) % 3 = 0 THEN seq ELSE substr(seq, 1, length(seq) - length(seq) % 3) || 'NNN' END AS codons")
_each("f09_mock_back_translate", lambda: [fs.mock_back_translate(F.regexp_replace(_seq(), "[B-F]", "-")).alias("codons")], "replace(regexp_replace(regexp_replace(seq, '[B-F]', '-', 'g'), '[^-]', 'NNN', 'g'), '-', '---') AS codons")
_each("f10_reverse_complement", lambda: [fs.reverse_complement(_seq()).alias("rc")], "reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) AS rc")
_each("f12_quality_mask", lambda: [fs.mask_low_quality(_seq(), F.col("quality")).alias("masked")],
      "CASE WHEN quality IS NULL THEN seq ELSE array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i <= length(quality) AND ascii(substr(quality, CAST(i AS INT), 1)) - 33 < 10 OR i > length(quality) THEN 'n' ELSE substr(seq, CAST(i AS INT), 1) END), '') END AS masked")
_each("f22_text_utilities", lambda: [F.trim(F.col("comment")).alias("trimmed"), F.lower(F.col("name")).alias("lower"), F.size(F.filter(F.split(F.col("comment"), " +"), lambda t: t != "")).alias("tokens"), F.lpad(F.col("name"), 12, ".").alias("padded"), F.regexp_count("comment", F.lit("=")).alias("signs")],
      "trim(comment, ' ') AS trimmed, lower(name) AS lower, coalesce(len(list_filter(regexp_split_to_array(comment, ' +'), lambda t: t <> '')), NULL) AS tokens, lpad(name, 12, '.') AS padded, len(regexp_extract_all(comment, '=')) AS signs")
_each("s03_header_tags", lambda: [fs.header_tag(F.col("comment"), "TID").alias("tag_tid"), F.coalesce(fs.header_tag(F.col("comment"), "NumDuplicates").cast("int"), F.lit(1)).alias("copies")],
      "substr(list_filter(regexp_split_to_array(comment, '\\s+'), lambda t: starts_with(t, 'TID='))[1], 5) AS tag_tid, coalesce(try_cast(substr(list_filter(regexp_split_to_array(comment, '\\s+'), lambda t: starts_with(t, 'NumDuplicates='))[1], 15) AS INT), 1) AS copies")
_each("s01_format", lambda: [F.when(F.col("quality").isNotNull(), "@").otherwise(">").alias("mark"), _sniffed(F.concat(F.when(F.col("quality").isNotNull(), F.lit("  @")).otherwise(F.lit("\n>")), F.col("name"))).alias("format")],
      "CASE WHEN quality IS NOT NULL THEN '@' ELSE '>' END AS mark, CASE WHEN name IS NULL THEN NULL WHEN quality IS NOT NULL THEN 'fastq' ELSE 'fasta' END AS format")
_each("f19_branch_length", lambda: [fs.branch_length(F.col("branch_length")).alias("used"), fs.branch_length(F.col("branch_length"), cap=None, scale=2.0).alias("scaled")],
      "least(CASE WHEN branch_length > 0 THEN branch_length ELSE 0.001 END, 0.2) AS used, CASE WHEN branch_length > 0 THEN branch_length ELSE 0.001 END * 2.0 AS scaled", tree, "one AS (SELECT 1)", "tree_node", "node_id")


def f13_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each state of the nucleotide alphabet occurs, with its number; -1 is no letter of it."""
    letter = records(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("letter"))
    counted = letter.where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    return counted.withColumn("state", F.expr(f"instr('{fs.DNA}', letter) - 1"))


def f14_linear_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of each reference: a site per letter, an edge of weight 1 from the site before; 0 is the start."""
    return references(spark, sf_dir).select("name", F.posexplode(F.split("seq", "")).alias("i", "letter")).where("letter <> ''").select("name", (F.col("i") + 1).alias("site"), "letter", F.col("i").alias("edge_from"), F.lit(1.0).alias("weight"))


_RUNS = RECORDS + """,
    chars AS (SELECT entry_id, i, substr(seq, CAST(i AS INT), 1) AS c FROM (SELECT entry_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM rec)),
    islands AS (SELECT entry_id, i, c, i - row_number() OVER (PARTITION BY entry_id, c ORDER BY i) AS g FROM chars),
    runs AS (SELECT entry_id, min(i) AS first, max(i) AS last, count(*) AS run FROM islands GROUP BY entry_id, c, g)
"""


def homopolymer_runs(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, first, last, run) of each run of equal letters, sites counted from 1: gaps and islands over the sites."""
    chars = df.select(key, F.posexplode(F.split(seq, "")).alias("i", "c")).where("c <> ''")
    island = F.col("i") - F.row_number().over(Window.partitionBy(key, "c").orderBy("i"))
    return chars.withColumn("g", island).groupBy(key, "c", "g").agg((F.min("i") + 1).alias("first"), (F.max("i") + 1).alias("last"), F.count("*").alias("run")).select(key, "first", "last", "run")


def w13_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many homopolymer runs of each length there are."""
    return homopolymer_runs(records(spark, sf_dir), "entry_id", "seq").groupBy("run").agg(F.count("*").alias("n"))


def f15_flow_skip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that skip sites at the ends of long runs: one site after runs over 2, also two after runs of 5 or more."""
    runs = homopolymer_runs(records(spark, sf_dir), "entry_id", "seq").where("run > 2")
    one = runs.select("entry_id", (F.col("last") - 1).alias("edge_from"), (F.col("last") + 1).alias("edge_to"), F.lit(0.9).alias("weight"))
    two = runs.where("run >= 5").select("entry_id", (F.col("last") - 2).alias("edge_from"), (F.col("last") + 1).alias("edge_to"), F.lit(0.9).alias("weight"))
    return one.unionByName(two)


def f16_homopolymer_skip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that skip 1 to run-1 sites of each run of 2 or more, of weight 0.25."""
    runs = homopolymer_runs(records(spark, sf_dir), "entry_id", "seq").where("run >= 2")
    skips = runs.select("entry_id", "last", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("run") - 1)).alias("skip"))
    return skips.select("entry_id", (F.col("last") - F.col("skip")).alias("edge_from"), (F.col("last") + 1).alias("edge_to"), F.lit(0.25).alias("weight"))


def f24_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge weights as the square root, the cube root and as they are."""
    w = tree(spark, sf_dir).where("branch_length >= 0").select("node_id", F.col("branch_length").alias("w"))
    return w.select("node_id", F.round(F.sqrt("w"), 9).alias("square"), F.round(F.cbrt("w"), 9).alias("cube"), F.col("w").alias("plain"))


_CODE = _sql_map([p for p in _PAIRS if p[1] != "*"])


def orf_sql(source: str, key: str, least: int) -> str:
    """CTEs that end in ``found`` (key, frame, start, end, translation): the ORFs of a table (key, seq), by counting codons."""
    return f"""strands AS (SELECT {key}, 1 AS sign, seq AS s FROM {source} UNION ALL SELECT {key}, -1, reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) FROM {source}),
        frames AS (SELECT {key}, sign, f, length(s) AS n, substr(s, f + 1) AS t FROM strands, (VALUES (0), (1), (2)) x(f)),
        codons AS (SELECT {key}, sign, f, n, j, coalesce({_CODE}[substr(t, CAST(j AS INT) * 3 + 1, 3)], 'X') AS aa FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / 3.0) AS INT))) AS j FROM frames)),
        good AS (SELECT *, j - row_number() OVER (PARTITION BY {key}, sign, f ORDER BY j) AS g FROM codons WHERE aa <> 'X'),
        runs AS (SELECT {key}, sign, f, n, min(j) * 3 + f AS a, max(j) * 3 + f + 2 AS b, string_agg(aa, '' ORDER BY j) AS translation FROM good GROUP BY {key}, sign, f, n, g HAVING count(*) >= {least}),
        found AS (SELECT {key}, sign * (f + 1) AS frame, CASE WHEN sign = 1 THEN a ELSE n - 1 - b END AS start, CASE WHEN sign = 1 THEN b ELSE n - 1 - a END AS "end", translation FROM runs)"""


def orfs(df: DataFrame, key: str, seq: str, least: int = 50) -> DataFrame:
    """Stop-free runs of at least ``least`` known codons in the six frames: (key, frame, start, end, translation).

    Positions count letters of the forward strand from 0, both inclusive; frames are 1 to 3 and -1 to -3.
    """
    both = df.select(F.col(key).alias("k"), F.col(seq).alias("fwd"), fs.reverse_complement(F.col(seq)).alias("rev"), F.length(seq).alias("n"))
    strands = both.select("k", "n", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("fwd").alias("s")), F.struct(F.lit(-1).alias("sign"), F.col("rev").alias("s")))).alias("x"))
    frames = strands.select("k", "n", "x.sign", "x.s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("f"))
    # Through a generator, so that the translation isn't written out, and done, wherever it is used.
    framed = frames.select("*", F.explode(F.array(fs.translate_codons(F.expr("substring(s, f + 1, n)")))).alias("aa"))
    # The runs, and what stands before each: only as many array elements as there are long runs.
    pattern = f"([^X]{{{least},}})"
    cut = framed.where(F.col("aa").rlike(pattern)).select("k", "n", "sign", "f", F.regexp_extract_all("aa", F.lit(pattern), 1).alias("orfs"), F.split("aa", pattern).alias("between"))
    before = F.expr("aggregate(slice(between, 1, part + 1), 0, (s, x) -> s + length(x)) + aggregate(slice(orfs, 1, part), 0, (s, x) -> s + length(x))")
    runs = cut.select("k", "n", "sign", "f", "orfs", "between", F.posexplode("orfs").alias("part", "orf"))
    placed = runs.withColumn("a", before * 3 + F.col("f")).withColumn("b", F.col("a") + F.length("orf") * 3 - 1)
    forward = F.col("sign") == 1
    return placed.select(F.col("k").alias(key), (F.col("sign") * (F.col("f") + 1)).alias("frame"), F.when(forward, F.col("a")).otherwise(F.col("n") - 1 - F.col("b")).alias("start"), F.when(forward, F.col("b")).otherwise(F.col("n") - 1 - F.col("a")).alias("end"), F.col("orf").alias("translation"))


def f11_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reading frames of at least 50 residues of all records."""
    return orfs(records(spark, sf_dir), "entry_id", "seq")


QUERIES |= {"f13_states": f13_states, "f14_linear_graph": f14_linear_graph, "w13_run_lengths": w13_run_lengths, "f15_flow_skip_edges": f15_flow_skip_edges, "f16_homopolymer_skip_edges": f16_homopolymer_skip_edges, "f24_edge_weights": f24_edge_weights, "f11_orfs": f11_orfs}
ORACLE_SQL |= {
    "f13_states": f"WITH {RECORDS}, l AS (SELECT unnest(string_split(seq, '')) AS letter FROM rec) SELECT letter, instr('{fs.DNA}', letter) - 1 AS state, count(*) AS n FROM l WHERE letter <> '' GROUP BY letter",
    "f14_linear_graph": f"WITH {REFERENCES}, c AS (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM ref) SELECT name, i + 1 AS site, substr(seq, CAST(i AS INT) + 1, 1) AS letter, i AS edge_from, 1.0::DOUBLE AS weight FROM c",
    "w13_run_lengths": f"WITH {_RUNS} SELECT run, count(*) AS n FROM runs GROUP BY run",
    "f15_flow_skip_edges": f"WITH {_RUNS} SELECT entry_id, last - 1 AS edge_from, last + 1 AS edge_to, 0.9::DOUBLE AS weight FROM runs WHERE run > 2 UNION ALL SELECT entry_id, last - 2, last + 1, 0.9::DOUBLE FROM runs WHERE run >= 5",
    "f16_homopolymer_skip_edges": f"WITH {_RUNS}, s AS (SELECT entry_id, last, unnest(range(1, run)) AS skip FROM runs WHERE run >= 2) SELECT entry_id, last - skip AS edge_from, last + 1 AS edge_to, 0.25::DOUBLE AS weight FROM s",
    "f24_edge_weights": "SELECT node_id, round(sqrt(branch_length), 9) AS square, round(cbrt(branch_length), 9) AS cube, branch_length AS plain FROM tree_node WHERE branch_length >= 0",
    "f11_orfs": f"WITH {RECORDS}, {orf_sql('rec', 'entry_id', 50)} SELECT * FROM found",
}



_each("s07_translate_on_read", lambda: [fs.rna_to_dna(_seq()).alias("dna_sequence"), fs.translate_codons(fs.rna_to_dna(_seq())).alias("sequence")],
      "replace(seq, 'U', 'T') AS dna_sequence, " + _sql_codons("replace(seq, 'U', 'T')", "coalesce(" + _sql_map([p for p in _PAIRS if p[1] != "*"]) + "[{c}], 'X')") + " AS sequence")
_each("k10_back_translated_rows", lambda: [fs.back_translate(F.regexp_replace(fs.translate_codons(_seq()), "(.{5})", "$1-"), _seq()).alias("row")],
      "regexp_replace(CASE WHEN length(seq) % 3 = 0 THEN seq ELSE substr(seq, 1, length(seq) - length(seq) % 3) || 'NNN' END, '(.{15})', '\\1---', 'g') AS row")
_each("k11_xml_leaves", lambda: [F.concat(F.lit('<leaf id="seq'), F.col("entry_id").cast("string"), F.lit('" name="'), fs.xml_escaped(F.coalesce("name", F.lit(""))), F.lit('">\n  <sequence>\n    '), _seq(), F.lit("\n  </sequence>\n</leaf>")).alias("element")],
      """'<leaf id="seq' || entry_id || '" name="' || replace(replace(replace(replace(coalesce(name, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || chr(10) || '  <sequence>' || chr(10) || '    ' || seq || chr(10) || '  </sequence>' || chr(10) || '</leaf>' AS element""")


def f17_quality_skip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at the ends of runs over 2 of records with a quality: one that skips the last site, of weight 0.9, or 0.6 where that site's quality
    is low; the step through it has the rest; runs of 5 or more may also skip two, of weight 0.02."""
    rows = records(spark, sf_dir).where("quality is not null")
    runs = homopolymer_runs(rows, "entry_id", "seq").where("run > 2").join(rows.select("entry_id", "quality"), "entry_id")
    low = F.expr("last <= length(quality) and ascii(substring(quality, cast(last as int), 1)) - 33 < 10")
    w = runs.withColumn("w", F.when(low, 0.6).otherwise(0.9))
    pick = lambda rows_, back, weight: rows_.select("entry_id", (F.col("last") - back).alias("edge_from"), (F.col("last") + 1).alias("edge_to"), F.round(weight, 9).alias("weight"))
    return pick(w, 1, F.col("w")).unionByName(pick(w, 0, 1 - F.col("w"))).unionByName(pick(w.where("run >= 5"), 2, F.lit(0.02)))


QUERIES["f17_quality_skip_edges"] = f17_quality_skip_edges
ORACLE_SQL["f17_quality_skip_edges"] = f"""
    WITH {_RUNS}, w AS (SELECT entry_id, last, runs.run AS run, CASE WHEN last <= length(quality) AND ascii(substr(quality, CAST(last AS INT), 1)) - 33 < 10 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS w FROM runs JOIN rec USING (entry_id) WHERE runs.run > 2 AND quality IS NOT NULL)
    SELECT entry_id, last - 1 AS edge_from, last + 1 AS edge_to, round(w, 9) AS weight FROM w UNION ALL SELECT entry_id, last, last + 1, round(1 - w, 9) FROM w UNION ALL SELECT entry_id, last - 2, last + 1, 0.02::DOUBLE FROM w WHERE run >= 5
"""
