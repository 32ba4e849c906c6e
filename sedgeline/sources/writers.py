"""Aligned and plain sequences as text, by column expressions; each formatter gives (part, line) rows or a column of text."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions.sequence import wrapped, xml_escaped

log = logging.getLogger("sedgeline")


def numbered_duplicates(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names that occur more than once become name/1, name/2, in the given order."""
    per = Window.partitionBy(name)
    k = F.row_number().over(per.orderBy(*order))
    return df.withColumn(name, F.when(F.count("*").over(per) > 1, F.concat(F.col(name), F.lit("/"), k)).otherwise(F.col(name)))


def fasta(name: Column, comment: Column, seq: Column, width: int = 70) -> Column:
    return F.concat(F.lit(">"), name, F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit(" "), comment)).otherwise(""), F.lit("\n"), wrapped(seq, width))


def fastq(name: Column, comment: Column, seq: Column, quality: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+"), F.coalesce(comment, F.lit("")), F.lit("\n"), quality)


def long_sequential(name: Column, seq: Column) -> Column:
    """A line of the name, a line of the sequence."""
    return F.concat(name, F.lit("\n"), seq)


def sequential(name: Column, seq: Column, width: int = 60, name_width: int | None = 10) -> Column:
    """A line of the name, cut and padded unless ``name_width`` is None, then the sequence in lines."""
    label = F.rpad(F.substring(name, 1, name_width), name_width, " ") if name_width else name
    return F.concat(label, F.lit("\n"), wrapped(seq, width))


def interleaved(df: DataFrame, name: str, seq: str, order: str, width: int = 60, name_width: int = 10) -> DataFrame:
    """(block, place, line): blocks of ``width`` columns of all rows; names only in the first."""
    blocks = F.greatest(F.ceil(F.length(seq) / width), F.lit(1)).cast("int")
    rows = df.select(F.col(order).alias("place"), F.col(name).alias("n"), F.col(seq).alias("s"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    piece = F.expr(f"substring(s, block * {width} + 1, {width})")
    label = F.when(F.col("block") == 0, F.rpad(F.substring("n", 1, name_width), name_width, " ")).otherwise(F.lit(" " * name_width))
    return rows.select("block", "place", F.concat(label, F.lit(" "), piece).alias("line"))


def nexus(df: DataFrame, name: str, seq: str, order: str, width: int = 60) -> DataFrame:
    """(block, place, line) of an interleaved NEXUS file: a head of block -1, the quoted rows, and an end."""
    letters = F.regexp_replace(F.upper(seq), "[^A-Z]", "")
    head = df.agg(F.count("*").alias("n"), F.max(F.length(seq)).alias("w"), F.sum(F.length(F.regexp_replace(letters, "[^ACGTUN]", ""))).alias("dna"), F.sum(F.length(letters)).alias("all"))
    kind = F.when(F.col("dna") / F.col("all") > 0.9, "dna").otherwise("protein")
    first = head.select(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("#nexus\nbegin data;\ndimensions ntax="), "n", F.lit(" nchar="), "w", F.lit(";\nformat datatype="), kind, F.lit(" interleave=yes gap=-;\nmatrix")).alias("line"))
    body = interleaved(df.withColumn("_q", F.concat(F.lit("'"), F.substring(name, 1, 20), F.lit("'"))), "_q", seq, order, width, 22)
    end = head.select(F.lit(1 << 30).alias("block"), F.lit(0).cast("long").alias("place"), F.lit(";\nend;").alias("line"))
    return first.unionByName(body.withColumn("place", F.col("place").cast("long"))).unionByName(end)


def newick(rows: list, lengths: bool = True, tags: bool = False) -> str:
    """The tree of (node_id, parent_id, side, name, branch_length, tid) rows as text; iterative, for any depth."""
    children: dict = {}
    root = None
    for r in rows:
        if r["parent_id"] is None:
            root = r
        else:
            children.setdefault(r["parent_id"], []).append(r)
    text: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        r, done = stack.pop()
        below = sorted(children.get(r["node_id"], []), key=lambda c: (c["side"] != "left", c["node_id"]))
        if not done and below:
            stack.append((r, True))
            stack += [(c, False) for c in below]
            continue
        out = "(" + ",".join(text.pop(c["node_id"]) for c in below) + ")" if below else ""
        out += r["name"] or ""
        if lengths and r["branch_length"] is not None:
            out += f":{r['branch_length']!r}"
        if tags and r["tid"]:
            out += f"[&&NHX:TID={r['tid']}]"
        text[r["node_id"]] = out
    return text[root["node_id"]] + ";"


# The formats by name, and their files' suffixes.
FORMATS = {"fasta": ".fas", "phylip": ".phy", "phylipi": ".phy", "phylips": ".phy", "paml": ".phy", "raxml": ".phy", "nexus": ".nex"}


def known_format(name: str) -> tuple[str, str]:
    """The format that a name stands for and its suffix; fasta, with a warning, for an unknown one."""
    if name not in FORMATS:
        log.warning("no format %r: writing fasta", name)
        name = "fasta"
    return ("phylipi" if name == "phylip" else name), FORMATS[name]


def formatted(df: DataFrame, name: str, seq: str, order: str, kind: str) -> DataFrame:
    """(block, place, line) of rows in the format of that name, the head of block -1."""
    kind, _ = known_format(kind)
    if kind == "nexus":
        return nexus(df, name, seq, order)
    head = df.agg(F.concat(F.count("*"), F.lit(" "), F.max(F.length(seq))).alias("line")).select(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("place"), "line")
    if kind == "phylipi":
        return head.unionByName(interleaved(df, name, seq, order).withColumn("place", F.col("place").cast("long")))
    n, s = F.col(name), F.col(seq)
    line = {"fasta": fasta(n, F.lit(""), s), "phylips": sequential(n, s), "paml": sequential(n, s, name_width=None), "raxml": long_sequential(n, s)}[kind]
    body = df.select(F.lit(0).alias("block"), F.col(order).cast("long").alias("place"), line.alias("line"))
    return body if kind == "fasta" else head.unionByName(body)


def graph_text(df: DataFrame, name: str, sites: str, edges: str) -> DataFrame:
    """(name, text): a graph's sites (ix, ch), each with the edges (start, end, weight) that end in it. Sites and edges meet in a join."""
    edge = df.select(name, F.explode(edges).alias("e")).groupBy(name, F.col("e.end").alias("ix")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e.start", "e.weight"))), lambda e: F.concat(F.lit(" "), e["start"], F.lit(" "), F.col("ix"), F.lit(" "), e["weight"], F.lit(";"))), "").alias("into"))
    site = df.select(name, F.explode(sites).alias("s")).select(name, F.col("s.ix").alias("ix"), F.col("s.ch").alias("ch")).join(edge, [name, "ix"], "left")
    line = F.concat("ix", F.lit(" "), "ch", F.lit(";"), F.coalesce("into", F.lit("")))
    lines = site.select(name, F.struct("ix", line.alias("l")).alias("x")).groupBy(name).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(F.col(name).alias("name"), F.concat(F.lit("# "), name, F.lit("\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("text"))


def event_lines(events: DataFrame, branch: str) -> DataFrame:
    """(branch, lines): each branch's events as text: its name, then substitutions, insertions and deletions by place."""
    what = F.concat(F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat("first", F.lit(".."), "last")), F.when(F.col("kind") == "sub", F.concat(F.lit(" "), "change")).when(F.col("kind") == "ins", " insertion").otherwise(" deletion"))
    each = events.select(F.col(branch).alias("branch"), F.struct(F.col("first").alias("a"), F.col("last").alias("b"), "kind", what.alias("t")).alias("x"))
    lines = each.groupBy("branch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select("branch", F.concat(F.lit("branch "), "branch", F.lit("\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n")).alias("lines"))


def xml_alignment(rows: DataFrame, group: str, name: str, seq: str, leaf: str, tree: DataFrame) -> DataFrame:
    """(group, xml): alignments with their trees (group, newick), leaves numbered in order of their names, inner nodes by name."""
    k = F.row_number().over(Window.partitionBy(group, leaf).orderBy(name))
    label = F.when(F.col(leaf), F.concat(F.lit("seq"), k)).otherwise(xml_escaped(F.col(name)))
    tag = F.when(F.col(leaf), "leaf").otherwise("node")
    line = F.concat(F.lit("<"), tag, F.lit(' id="'), label, F.lit('" name="'), xml_escaped(F.col(name)), F.lit('">'), xml_escaped(F.col(seq)), F.lit("</"), tag, F.lit(">"))
    nodes = rows.select(group, F.struct(F.when(F.col(leaf), 0).otherwise(1).alias("o"), F.col(name).alias("n"), line.alias("l")).alias("x")).groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return nodes.join(tree, group).select(group, F.concat(F.lit("<ms_alignment>\n<newick>"), xml_escaped(F.col("newick")), F.lit("</newick>\n<nodes>\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n"), F.lit("\n</nodes>\n</ms_alignment>")).alias("xml"))
