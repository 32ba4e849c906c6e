"""What is read off aligned rows: columns, consensus, contigs, events, trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions.sequence import BASE_BITS, bits_letter, translate_codons


def columns_of(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """(keys, site, letter) of every column of every row, counted from 1."""
    return rows.select(*keys, F.posexplode(F.split(row, "")).alias("i", "letter")).where("letter <> ''").select(*keys, (F.col("i") + 1).alias("site"), "letter")


def gaps_per_column(rows: DataFrame, group: str, key: str, row: str) -> DataFrame:
    """(group, site, gaps, rows): how many of a group's rows lack each column."""
    return columns_of(rows, [group, key], row).groupBy(group, "site").agg(F.count_if(F.col("letter") == "-").alias("gaps"), F.count("*").alias("rows"))


def without_gap_columns(rows: DataFrame, group: str, key: str, row: str) -> DataFrame:
    """(group, key, row) without the columns in which all of a group's rows have a gap. A group's rows must be equally wide."""
    full = gaps_per_column(rows, group, key, row).where("gaps < rows").groupBy(group).agg(F.array_sort(F.collect_list("site")).alias("sites"))
    return rows.select(group, key, F.col(row).alias("row")).join(full, group, "left").select(group, key, F.coalesce(F.array_join(F.expr("transform(sites, s -> substring(row, s, 1))"), ""), F.lit("")).alias("row"))


def base_counts(rows: DataFrame, group: str, key: str, row: str) -> DataFrame:
    """(group, site, a, c, g, t): bases in each column; an ambiguous letter counts for each base it stands for."""
    bits = columns_of(rows, [group, key], row)
    members = {b: [letter for letter, v in BASE_BITS.items() if v & bit] for b, bit in (("a", 1), ("c", 2), ("g", 4), ("t", 8))}
    return bits.groupBy(group, "site").agg(*[F.count_if(F.col("letter").isin(m)).alias(b) for b, m in members.items()])


def consensus_letter(counts: list[Column], rows: Column, least: int = 5, proportion: float = 0.5) -> Column:
    """The most frequent base, or the letter of the tied ones; a gap where fewer than max(least, proportion of rows) support the column."""
    top = F.greatest(*counts)
    tied = sum((F.when(c == top, bit).otherwise(0) for c, bit in zip(counts, (1, 2, 4, 8), strict=True)), F.lit(0))
    weight = sum(counts[1:], counts[0])
    return F.when(weight < F.greatest(F.lit(least), F.floor(rows * proportion).cast("int")), "-").otherwise(bits_letter(tied))


def contig_letter(consensus: Column, reference: Column, covered: Column, show_reference: bool = False) -> Column:
    """The consensus where reads cover the column; elsewhere n, or the reference's letter in lower case."""
    return F.when(covered & (consensus != "-"), consensus).when(covered, "").otherwise(F.lower(reference) if show_reference else F.lit("n"))


def branch_events(branches: DataFrame, key: str, parent: str, child: str, unit: int = 1) -> DataFrame:
    """(key, kind, first, last, change) of the events from a parent's to its child's row, columns counted from 1.

    With a ``unit`` of 3 the columns are codons, and a change names the residues as well.

    'sub': both have letters, which differ. 'del': a run in which the parent has letters and the child none; it ends before the
    child's next letter. 'ins': the converse. Columns in which neither has a letter don't end a run; one that reaches the end of the rows
    ends there.
    """
    parts = lambda row: F.split(row, "") if unit == 1 else F.expr(f"transform(sequence(0, int(ceil(length({row}) / {unit})) - 1), i -> substring({row}, i * {unit} + 1, {unit}))")
    c = branches.select(key, F.posexplode(F.arrays_zip(parts(parent).alias("p"), parts(child).alias("c"))).alias("i", "x")).select(key, (F.col("i") + 1).alias("site"), F.col("x.p").alias("p"), F.col("x.c").alias("c")).where("p <> '' and c <> ''")
    gap = "-" * unit
    width = F.max("site").over(Window.partitionBy(key))
    c = c.withColumn("width", width)
    subs = c.where((F.col("p") != gap) & (F.col("c") != gap) & (F.col("p") != F.col("c"))).select(key, F.lit("sub").alias("kind"), F.col("site").alias("first"), F.col("site").alias("last"), _named_change(unit).alias("change"))
    out = subs
    for kind, here, gone in (("del", "p", "c"), ("ins", "c", "p")):
        # Letters of the side that lost them close a run; the closing sites before a column number its run.
        along = Window.partitionBy(key).orderBy("site")
        run = F.sum(F.when(F.col(gone) != gap, 1).otherwise(0)).over(along)
        ends = F.min(F.when(F.col(gone) != gap, F.col("site"))).over(along.rowsBetween(1, Window.unboundedFollowing))
        marked = c.withColumn("run", run).withColumn("next", ends).where((F.col(here) != gap) & (F.col(gone) == gap))
        rows = marked.groupBy(key, "run").agg(F.min("site").alias("first"), F.max(F.coalesce(F.col("next") - 1, F.col("width"))).alias("last"))
        out = out.unionByName(rows.select(key, F.lit(kind).alias("kind"), "first", "last", F.lit(None).cast("string").alias("change")))
    return out


def _named_change(unit: int) -> Column:
    change = F.concat("p", F.lit(" -> "), "c")
    if unit == 1:
        return change
    x, y = translate_codons(F.col("p")), translate_codons(F.col("c"))
    return F.concat(change, F.lit(" ("), F.when(x == y, x).otherwise(F.concat(x, F.lit(" -> "), y)), F.lit(")"))


def query_span(rows: DataFrame, group: str, row: str, is_query: Column, pad: int = 15) -> DataFrame:
    """(group, first, last): the columns from the first to the last letter of a group's queries, and ``pad`` more on either side."""
    first = F.length(F.regexp_extract(row, "^(-*)", 1)) + 1
    last = F.length(F.regexp_replace(row, "-+$", ""))
    spans = rows.where(is_query).groupBy(group).agg(F.min(first).alias("f"), F.max(last).alias("l"), F.max(F.length(row)).alias("n"))
    return spans.select(group, F.greatest(F.col("f") - pad, F.lit(1)).alias("first"), F.least(F.col("l") + pad, F.col("n")).alias("last"))
