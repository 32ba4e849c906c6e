"""Text formats as DataFrames. Files are split and read in parallel wherever the format allows it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgeline.functions.sequence import degap, header_tag


def sniffed(text: Column) -> Column:
    """fasta, fastq or graph by the first character that isn't blank; null for none of these."""
    first = F.substring(F.regexp_replace(text, "^\\s+", ""), 1, 1)
    return F.when(first == ">", "fasta").when(first == "@", "fastq").when(first == "#", "graph")


def _with_tags(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tid", header_tag(F.col("comment"), "TID")).withColumn("num_duplicates", F.coalesce(header_tag(F.col("comment"), "NumDuplicates").try_cast("int"), F.lit(1)))


def read_fasta(spark: SparkSession, path: str, without_gaps: bool = False) -> DataFrame:
    """(file, pos, name, comment, sequence, tid, num_duplicates): one row per record with a name and a sequence.

    The name is the header's first token. Sequences are upper-case and without white space; ``pos`` orders a file's records.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("v"))
    header = F.split("v", "\n", 2)[0]
    body = F.upper(F.regexp_replace(F.coalesce(F.get(F.split("v", "\n", 2), F.lit(1)), F.lit("")), "\\s", ""))
    rows = raw.select("file", "block", "pos", F.regexp_extract(header, "^\\s*(\\S*)", 1).alias("name"), F.trim(F.regexp_replace(header, "^\\s*\\S*", "")).alias("comment"), (degap(body) if without_gaps else body).alias("sequence"))
    return _with_tags(rows.where("name <> '' and sequence <> ''")).drop("block")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number in their file from 0, whichever splits they were read in."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, name, comment, sequence, quality, tid, num_duplicates) of four-line records; text after the + joins the comment.

    A record whose third line has no + or whose quality is of another length raises an error.
    """
    lines = numbered_lines(spark, path).withColumn("pos", F.floor(F.col("line") / 4).cast("long")).withColumn("part", (F.col("line") % 4).cast("int"))
    value = lambda k: F.max(F.when(F.col("part") == k, F.regexp_replace("value", "\r$", "")))
    rows = lines.groupBy("file", "pos").agg(*[value(k).alias(f"l{k}") for k in range(4)]).where("l1 is not null")
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    rows = rows.withColumn("l0", F.when(good, F.col("l0")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("l0", F.lit(""))))))
    extra = F.trim(F.substring("l2", 2, 1 << 30))
    comment = F.concat(F.trim(F.regexp_replace("l0", "^@\\S*", "")), F.when(extra != "", F.concat(F.lit(" ; "), extra)).otherwise(""))
    return _with_tags(rows.select("file", "pos", F.regexp_extract("l0", "^@(\\S*)", 1).alias("name"), comment.alias("comment"), F.upper("l1").alias("sequence"), F.col("l3").alias("quality")))


def parse_graphs(df: DataFrame, text: str) -> DataFrame:
    """Sequence graphs as (name, sites, edges) from texts: a line '# name', then for each site 'number letter; start end weight; ...'.

    Weights are clipped so that those of a site's edges sum to at most 1.
    """
    entry = df.select(F.explode(F.split(F.concat(F.lit("\n"), text), "\n# ?")).alias("v")).where("trim(v) <> ''")
    lines = F.filter(F.split("v", "\n"), lambda x: F.trim(x) != "")
    site = lambda line: F.split(F.trim(F.split(line, ";")[0]), "\\s+")
    split = entry.select(F.trim(lines[0]).alias("name"), F.slice(lines, 2, F.size(lines)).alias("body"))
    sites = F.transform("body", lambda x: F.struct(site(x)[0].cast("int").alias("ix"), site(x)[1].alias("ch")))
    parts = lambda x: F.filter(F.slice(F.split(x, ";"), 2, F.size(F.split(x, ";"))), lambda e: F.trim(e) != "")
    number = lambda e, k: F.split(F.trim(e), "\\s+")[k]
    edge = lambda e: F.struct(number(e, 0).cast("int").alias("start"), number(e, 1).cast("int").alias("end"), number(e, 2).cast("double").alias("weight"))
    none = F.struct(F.lit(0.0).alias("sum"), F.expr("cast(array() as array<struct<start:int,end:int,weight:double>>)").alias("edges"))

    def clipped(s: Column, e: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(e["weight"], 1 - s["sum"]))
        return F.struct((s["sum"] + w).alias("sum"), F.array_append(s["edges"], F.struct(e["start"].alias("start"), e["end"].alias("end"), w.alias("weight"))).alias("edges"))

    edges = F.flatten(F.transform("body", lambda x: F.aggregate(F.transform(parts(x), edge), none, clipped, lambda s: s["edges"])))
    return split.select("name", sites.alias("sites"), edges.alias("edges"))


# The line formats of search hits: query, its range and strand, target, its range and strand, score.
SUGAR = r"sugar:\s+(\S+)\s+(\d+)\s+(\d+)\s+(\S)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\S)\s+(-?\d+)"


def parse_hits(df: DataFrame, line: str) -> DataFrame:
    """Search hits from 'sugar:' lines; other lines are skipped."""
    g = lambda k, t="int": F.regexp_extract(line, SUGAR, k).cast(t)
    return df.where(F.col(line).rlike(SUGAR)).select(g(1, "string").alias("query"), g(2).alias("q_start"), g(3).alias("q_end"), g(4, "string").alias("q_strand"), g(5, "string").alias("node"), g(6).alias("t_start"), g(7).alias("t_end"), g(8, "string").alias("t_strand"), g(9).alias("score"))


def renamed_duplicates(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The second and later rows of a name become name.1, name.2, in the given order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn(name, F.when(k > 0, F.concat(F.col(name), F.lit("."), k)).otherwise(F.col(name)))


@dataclass
class TreeNode:
    """A node of a parsed tree."""

    name: str = ""
    length: float | None = None
    tags: dict[str, str] = field(default_factory=dict)
    children: list[TreeNode] = field(default_factory=list)


_NEWICK = re.compile(r"\s*(?:([(),;])|\[&&NHX([^\]]*)\]|:\s*([-+0-9.eE]+)|'((?:[^']|'')*)'|([^\s()\[\],:;]+))")


def parse_newick(text: str) -> TreeNode:
    """A tree with names, branch lengths and NHX tags. Iterative, so trees of any depth are read."""
    root = node = TreeNode()
    open_nodes: list[TreeNode] = []
    at = 0
    while at < len(text.rstrip()):
        m = _NEWICK.match(text, at)
        if not m:
            raise ValueError(f"not a Newick tree at {at}: {text[at : at + 20]!r}")
        at = m.end()
        mark, tags, length, quoted, plain = m.groups()
        if mark == "(":
            open_nodes.append(node)
            child = TreeNode()
            node.children.append(child)
            node = child
        elif mark == ",":
            node = TreeNode()
            open_nodes[-1].children.append(node)
        elif mark == ")":
            node = open_nodes.pop()
        elif mark == ";":
            break
        elif tags is not None:
            node.tags |= dict(t.split("=", 1) for t in tags.split(":") if "=" in t)
        elif length is not None:
            node.length = float(length)
        else:
            node.name = quoted.replace("''", "'") if quoted is not None else plain
    if open_nodes:
        raise ValueError("a Newick tree that isn't closed")
    return root


def binary(root: TreeNode) -> TreeNode:
    """Nodes of more than two children become left-nested pairs on branches of length 0; the root must have two."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n is root and len(n.children) > 2:
            raise ValueError("the root must have two children; root the tree first")
        while len(n.children) > 2:
            n.children[:2] = [TreeNode(length=0.0, children=n.children[:2])]
        stack += n.children
    return root


def tree_rows(root: TreeNode) -> list[tuple]:
    """(node_id, parent_id, side, name, branch_length, tid), children before parents; inner nodes without a name are #n#."""
    order, stack = [], [(root, None)]
    while stack:
        n, parent = stack.pop()
        order.append((n, parent))
        stack += [(c, n) for c in n.children]
    order.reverse()
    ids = {id(n): k + 1 for k, (n, _) in enumerate(order)}
    inner, out = 0, []
    for n, parent in order:
        name = n.name
        if n.children and not name:
            inner += 1
            name = f"#{inner}#"
        side = None if parent is None else "left" if parent.children[0] is n else "right"
        out.append((ids[id(n)], None if parent is None else ids[id(parent)], side, name, n.length, n.tags.get("TID")))
    return out


def midpoint_rooted(root: TreeNode) -> TreeNode:
    """The tree rooted in the middle of its longest path between leaves; missing lengths count 0."""
    near: dict[int, list[tuple[TreeNode, float]]] = {}
    keep: dict[int, TreeNode] = {}
    stack = [root]
    while stack:
        n = stack.pop()
        keep[id(n)] = n
        for c in n.children:
            near.setdefault(id(n), []).append((c, c.length or 0.0))
            near.setdefault(id(c), []).append((n, c.length or 0.0))
            stack.append(c)

    def farthest(start: TreeNode) -> list[tuple[TreeNode, float]]:
        seen, todo = {id(start): (None, 0.0)}, [start]
        while todo:
            n = todo.pop()
            for m, d in near.get(id(n), []):
                if id(m) not in seen:
                    seen[id(m)] = (n, seen[id(n)][1] + d)
                    todo.append(m)
        leaf = max((n for n in seen if len(near.get(n, [])) <= 1), key=lambda n: seen[n][1])
        path, n = [], keep[leaf]
        while n is not None:
            path.append((n, seen[id(n)][1]))
            n = seen[id(n)][0]
        return path

    if not root.children:
        return root
    path = farthest(farthest(next(n for n in keep.values() if len(near[id(n)]) <= 1))[0][0])
    half = path[0][1] / 2
    k = next(i for i in range(len(path) - 1) if path[i + 1][1] <= half)
    upper, lower = path[k], path[k + 1]
    top = TreeNode()
    todo = [(upper[0], lower[0], upper[1] - half, top), (lower[0], upper[0], half - lower[1], top)]
    while todo:
        n, came, length, parent = todo.pop()
        others = [(m, d) for m, d in near[id(n)] if m is not came]
        if len(others) == 1 and len(near[id(n)]) == 2 and not n.name:  # the old root, which is no node any more
            todo.append((others[0][0], n, length + others[0][1], parent))
            continue
        made = TreeNode(n.name, length, n.tags)
        parent.children.append(made)
        todo += [(m, n, d, made) for m, d in others]
    return top


# The line format of gapped search hits: as for ungapped ones, and the operations after the score.
VULGAR = SUGAR.replace("sugar", "vulgar") + r"\s*(.*)"


def parse_gapped_hits(df: DataFrame, line: str) -> DataFrame:
    """Search hits from 'vulgar:' lines, with their operations as an array of (op, query, target); other lines are skipped."""
    g = lambda k, t="int": F.regexp_extract(line, VULGAR, k).cast(t)
    triples = F.transform(F.regexp_extract_all(F.regexp_extract(line, VULGAR, 10), F.lit(r"(\S+\s+\d+\s+\d+)"), 1), lambda x: F.split(x, r"\s+"))
    ops = F.transform(triples, lambda x: F.struct(x[0].alias("op"), x[1].cast("int").alias("query"), x[2].cast("int").alias("target")))
    return df.where(F.col(line).rlike(VULGAR)).select(g(1, "string").alias("query"), g(2).alias("q_start"), g(3).alias("q_end"), g(4, "string").alias("q_strand"), g(5, "string").alias("node"), g(6).alias("t_start"), g(7).alias("t_end"), g(8, "string").alias("t_strand"), g(9).alias("score"), ops.alias("ops"))


def parse_segments(df: DataFrame, line: str) -> DataFrame:
    """Anchors from tab-separated ungapped segments: query, target, first and last letter on either (from 1; a target that runs backwards is
    on the minus strand), score. Lines of another form are skipped."""
    pattern = r"^([^\t]+)\t([^\t]+)\t(\d+)\t(\d+)\t(\d+)\t(\d+)\t(-?\d+)$"
    g = lambda k, t="int": F.regexp_extract(line, pattern, k).cast(t)
    return df.where(F.col(line).rlike(pattern)).select(
        g(1, "string").alias("seq_1"), g(2, "string").alias("seq_2"), (F.least(g(3), g(4)) - 1).alias("start_1"), (F.least(g(5), g(6)) - 1).alias("start_2"), (F.abs(g(4) - g(3)) + 1).alias("length"), g(7).alias("score"), (g(3) <= g(4)).alias("plus_1"), (g(5) <= g(6)).alias("plus_2")
    )


def domain_anchors(df: DataFrame, line: str, length: int = 5) -> DataFrame:
    """(sequence, start, length): an anchor at either end of each sequence's best domain, from the lines of a domain table.

    Of a line's fields the first is the sequence, the fourth the domain, the 13th its E-value and the 18th and 19th where it lies,
    from 1. The lowest E-value counts, of equals the first place. Lines that begin with # are comments.
    """
    field = F.split(F.trim(F.col(line)), r"\s+")
    rows = df.where(~F.col(line).startswith("#")).select(field.alias("f")).where(F.size("f") >= 19)
    rows = rows.select(F.col("f")[0].alias("sequence"), F.col("f")[12].cast("double").alias("e"), F.col("f")[17].cast("int").alias("a"), F.col("f")[18].cast("int").alias("b"))
    best = rows.groupBy("sequence").agg(F.min_by(F.struct("a", "b"), F.struct("e", "a", "b")).alias("d")).select("sequence", "d.*")
    return best.select("sequence", F.explode(F.array(F.col("a") - 1, F.greatest(F.col("b") - length, F.col("a") - 1))).alias("start"), F.lit(length).alias("length"))


def parse_relaxed_phylip(df: DataFrame, text: str) -> DataFrame:
    """(name, sequence) of files (one text each) with a head of two numbers, and for each sequence its name and letters, over several lines up
    to an empty one. Names are wrapped as #name#. A name that comes again replaces none: the first counts."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r", ""), r"^\s*\d+\s+\d+[^\n]*\n", "")
    parts = df.where(F.col(text).rlike(r"^\s*\d+\s+\d+")).select(F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("place", "part")).where("trim(part) <> ''")
    name = F.regexp_extract("part", r"^\s*(\S+)", 1)
    letters = F.regexp_replace(F.regexp_replace("part", r"^\s*\S+", ""), r"\s+", "")
    return parts.groupBy(F.concat(F.lit("#"), name, F.lit("#")).alias("name")).agg(F.min_by(letters, "place").alias("sequence"))
