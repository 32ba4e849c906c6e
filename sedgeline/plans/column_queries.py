"""Columns of rows laid side by side: counts, consensus, contigs, gaps, events; anchors by substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.functions.sequence import BASE_BITS, STANDARD_CODE, wrapped
from sedgeline.operators import alignments as oa
from sedgeline.operators import anchors as an
from sedgeline.plans.tables import RECORDS, REFERENCES, anchors, records, references, tree

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _members(bit: int) -> str:
    return "(" + ", ".join(f"'{k}'" for k, v in BASE_BITS.items() if v & bit) + ")"


# The records of a taxon, one below the other from their first letters on; those without a taxon are one more group.
_COUNTS = RECORDS + f""", chars AS (SELECT coalesce(tid, '') AS tid, entry_id, i AS site, substr(seq, CAST(i AS INT), 1) AS letter FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM rec)),
    counts AS (SELECT tid, site, {', '.join(f"count(*) FILTER (letter IN {_members(bit)}) AS {b}" for b, bit in (('a', 1), ('c', 2), ('g', 4), ('t', 8)))} FROM chars GROUP BY tid, site),
    sizes AS (SELECT coalesce(tid, '') AS tid, count(*) AS n FROM rec GROUP BY ALL)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return oa.base_counts(records(spark, d).withColumn("tid", F.coalesce("tid", F.lit(""))), "tid", "entry_id", "seq")


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def g03_base_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bases in each column of each taxon's records."""
    return _counts(spark, d)


_LETTER = "CASE (CASE WHEN a = top THEN 1 ELSE 0 END + CASE WHEN c = top THEN 2 ELSE 0 END + CASE WHEN g = top THEN 4 ELSE 0 END + CASE WHEN t = top THEN 8 ELSE 0 END) " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in BASE_BITS.items()) + " END"
_CONSENSUS = _COUNTS + f""", tops AS (SELECT counts.*, n, greatest(a, c, g, t) AS top FROM counts JOIN sizes USING (tid)),
    cons AS (SELECT tid, site, CASE WHEN a + c + g + t < greatest(5, CAST(floor(n * 0.5) AS INT)) THEN '-' ELSE {_LETTER} END AS letter FROM tops)"""


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    sizes = records(spark, d).groupBy(F.coalesce("tid", F.lit("")).alias("tid")).agg(F.count("*").alias("n"))
    letter = oa.consensus_letter([F.col(b) for b in "acgt"], F.col("n"))
    return _counts(spark, d).join(sizes, "tid").select("tid", "site", letter.alias("letter"))


@query(f"WITH {_CONSENSUS} SELECT * FROM cons")
def g04_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The consensus of each column."""
    return _consensus(spark, d)


@query(f"""WITH {_CONSENSUS}, {REFERENCES}, r AS (SELECT coalesce(tid, '') AS tid, min(seq) AS seq FROM ref GROUP BY ALL),
    rc AS (SELECT tid, i AS site, substr(seq, CAST(i AS INT), 1) AS reference FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM r))
    SELECT tid, site, CASE WHEN letter <> '-' THEN letter WHEN letter IS NOT NULL THEN '' ELSE lower(reference) END AS contig FROM rc LEFT JOIN cons USING (tid, site)""")
def g05_contig(spark: SparkSession, d: str) -> DataFrame:
    """The consensus where records cover a taxon's reference, and the reference in lower case elsewhere."""
    r = references(spark, d).groupBy(F.coalesce("tid", F.lit("")).alias("tid")).agg(F.min("seq").alias("seq"))
    joined = oa.columns_of(r, ["tid"], "seq").withColumnRenamed("letter", "reference").join(_consensus(spark, d), ["tid", "site"], "left")
    return joined.select("tid", "site", oa.contig_letter(F.col("letter"), F.col("reference"), F.col("letter").isNotNull(), show_reference=True).alias("contig"))


# Rows with gaps: the references of a taxon, padded to one width, with every seventh column turned into gaps.
_ROWS = REFERENCES + """, leafs AS (SELECT coalesce(r.tid, '') AS tid, r.name, r.seq FROM ref r JOIN tree_node t ON t.name = r.name),
    rows AS (SELECT tid, name, regexp_replace(rpad(seq, CAST(max(length(seq)) OVER (PARTITION BY tid) AS INT), '-'), '(.{6}).', '\\1-', 'g') AS row FROM leafs),
    cells AS (SELECT tid, name, i AS site, substr(row, CAST(i AS INT), 1) AS letter FROM (SELECT *, unnest(range(1, length(row) + 1)) AS i FROM rows))"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    leafs = references(spark, d).join(tree(spark, d).select("name"), "name", "left_semi").select(F.coalesce("tid", F.lit("")).alias("tid"), "name", "seq")
    width = F.max(F.length("seq")).over(Window.partitionBy("tid"))
    return leafs.withColumn("w", width).select("tid", "name", F.regexp_replace(F.expr("rpad(seq, w, '-')"), "(.{6}).", "$1-").alias("row"))


@query(f"WITH {_ROWS} SELECT tid, site, count(*) FILTER (letter = '-') AS gaps, count(*) AS rows FROM cells GROUP BY tid, site")
def g14_gaps_per_column(spark: SparkSession, d: str) -> DataFrame:
    return oa.gaps_per_column(_rows(spark, d), "tid", "name", "row")


@query(f"""WITH {_ROWS}, good AS (SELECT tid, site FROM cells GROUP BY tid, site HAVING count(*) FILTER (letter <> '-') > 0)
    SELECT tid, name, string_agg(letter, '' ORDER BY site) AS row FROM cells JOIN good USING (tid, site) GROUP BY tid, name""")
def g15_without_gap_columns(spark: SparkSession, d: str) -> DataFrame:
    return oa.without_gap_columns(_rows(spark, d), "tid", "name", "row")


@query(f"WITH {_ROWS}, g AS (SELECT tid, site, count(*) FILTER (letter = '-') / count(*) AS share FROM cells GROUP BY tid, site) SELECT tid, count(*) FILTER (share < 0.1) AS scored FROM g GROUP BY tid")
def f23_scored_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that enough rows have a letter in to be scored."""
    return oa.gaps_per_column(_rows(spark, d), "tid", "name", "row").groupBy("tid").agg(F.count_if(F.col("gaps") / F.col("rows") < 0.1).alias("scored"))


@query(f"""WITH {_ROWS}, q AS (SELECT tid, max(length(row)) AS n, min(length(regexp_extract(row, '^(-*)', 1))) + 1 AS f, max(length(regexp_replace(row, '-+$', ''))) AS l FROM rows GROUP BY tid)
    SELECT tid, CAST(greatest(f - 15, 1) AS INT) AS first, CAST(least(l + 15, n) AS INT) AS last FROM q""")
def f20_query_span(spark: SparkSession, d: str) -> DataFrame:
    return oa.query_span(_rows(spark, d), "tid", "row", F.lit(True))


_BRANCHES = REFERENCES + """, pairs AS (SELECT p.node_id, l.seq AS a, r.seq AS b FROM tree_node p JOIN tree_node x ON x.parent_id = p.node_id AND x.side = 'left' JOIN tree_node y ON y.parent_id = p.node_id AND y.side = 'right' JOIN ref l ON l.name = x.name JOIN ref r ON r.name = y.name),
    cut AS (SELECT node_id, regexp_replace(substr(a, 1, least(length(a), length(b))), '(.{5})..', '\\1--', 'g') AS p, regexp_replace(substr(b, 1, least(length(a), length(b))), '(.{8})...', '\\1---', 'g') AS c FROM pairs),
    cells AS (SELECT node_id, i AS site, length(p) AS width, substr(p, CAST(i AS INT), 1) AS p, substr(c, CAST(i AS INT), 1) AS c FROM (SELECT *, unnest(range(1, length(p) + 1)) AS i FROM cut))"""


def _run_sql(kind: str, here: str, gone: str) -> str:
    return f"""{kind}_m AS (SELECT *, sum(CASE WHEN {gone} <> '-' THEN 1 ELSE 0 END) OVER w AS run, min(CASE WHEN {gone} <> '-' THEN site END) OVER (PARTITION BY node_id ORDER BY site ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM cells WINDOW w AS (PARTITION BY node_id ORDER BY site)),
    {kind} AS (SELECT node_id, '{kind}' AS kind, min(site) AS first, max(coalesce(next - 1, width)) AS last, CAST(NULL AS VARCHAR) AS change FROM {kind}_m WHERE {here} <> '-' AND {gone} = '-' GROUP BY node_id, run)"""


@query(f"WITH {_BRANCHES}, {_run_sql('del', 'p', 'c')}, {_run_sql('ins', 'c', 'p')} SELECT node_id, 'sub' AS kind, site AS first, site AS last, p || ' -> ' || c AS change FROM cells WHERE p <> '-' AND c <> '-' AND p <> c UNION ALL SELECT * FROM del UNION ALL SELECT * FROM ins")
def w14_g16_events(spark: SparkSession, d: str) -> DataFrame:
    """Events between the rows of sibling leaves, with gaps put into both."""
    t, r = tree(spark, d), references(spark, d).select("name", "seq")
    side = lambda s, c: t.where(F.col("side") == s).select(F.col("parent_id").alias("node_id"), "name").join(r, "name").select("node_id", F.col("seq").alias(c))
    both = side("left", "a").join(side("right", "b"), "node_id").withColumn("n", F.least(F.length("a"), F.length("b")))
    rows = both.select("node_id", F.regexp_replace(F.expr("substring(a, 1, n)"), "(.{5})..", "$1--").alias("p"), F.regexp_replace(F.expr("substring(b, 1, n)"), "(.{8})...", "$1---").alias("c"))
    return oa.branch_events(rows, "node_id", "p", "c")


# The same with the shorter row padded to the longer one's width.
_WHOLE = _BRANCHES.replace("substr(a, 1, least(length(a), length(b)))", "rpad(a, CAST(greatest(length(a), length(b)) AS INT), '-')").replace("substr(b, 1, least(length(a), length(b)))", "rpad(b, CAST(greatest(length(a), length(b)) AS INT), '-')")


@query(f"WITH {_WHOLE}, {_run_sql('del', 'p', 'c')}, {_run_sql('ins', 'c', 'p')} SELECT node_id, 'sub' AS kind, site AS first, site AS last, p || ' -> ' || c AS change FROM cells WHERE p <> '-' AND c <> '-' AND p <> c UNION ALL SELECT * FROM del UNION ALL SELECT * FROM ins")
def w14_g16_whole_events(spark: SparkSession, d: str) -> DataFrame:
    """Events between the whole rows of sibling leaves, the letters that one has beyond the other's end among them."""
    t, r = tree(spark, d), references(spark, d).select("name", "seq")
    side = lambda s, c: t.where(F.col("side") == s).select(F.col("parent_id").alias("node_id"), "name").join(r, "name").select("node_id", F.col("seq").alias(c))
    both = side("left", "a").join(side("right", "b"), "node_id").withColumn("n", F.greatest(F.length("a"), F.length("b")))
    rows = both.select("node_id", F.regexp_replace(F.expr("rpad(a, n, '-')"), "(.{5})..", "$1--").alias("p"), F.regexp_replace(F.expr("rpad(b, n, '-')"), "(.{8})...", "$1---").alias("c"))
    return oa.branch_events(rows, "node_id", "p", "c")


_CODONS = ", ".join(f"('{a + b + c}', '{STANDARD_CODE[16 * i + 4 * j + k].replace('*', 'X')}')" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG"))
_CODON_CELLS = REFERENCES + f""", code AS (SELECT * FROM (VALUES {_CODONS}) c(codon, residue)),
    pairs AS (SELECT p.node_id, l.seq AS a, r.seq AS b, CAST(3 * ceil(greatest(length(l.seq), length(r.seq)) / 3.0) AS INT) AS n FROM tree_node p JOIN tree_node x ON x.parent_id = p.node_id AND x.side = 'left' JOIN tree_node y ON y.parent_id = p.node_id AND y.side = 'right' JOIN ref l ON l.name = x.name JOIN ref r ON r.name = y.name),
    rows AS (SELECT node_id, regexp_replace(rpad(a, n, '-'), '(.{{6}})...', '\\1---', 'g') AS p, regexp_replace(rpad(b, n, '-'), '(.{{9}})......', '\\1------', 'g') AS c FROM pairs),
    units AS (SELECT node_id, unnest(range(1, length(p) // 3 + 1)) AS site, length(p) // 3 AS width, p AS p0, c AS c0 FROM rows),
    whole AS (SELECT node_id, site, width, substr(p0, CAST(3 * site - 2 AS INT), 3) AS p, substr(c0, CAST(3 * site - 2 AS INT), 3) AS c FROM units),
    cells AS (SELECT node_id, site, width, CASE WHEN p = '---' THEN '-' ELSE p END AS p, CASE WHEN c = '---' THEN '-' ELSE c END AS c FROM whole)"""


@query(f"""WITH {_CODON_CELLS}, {_run_sql('del', 'p', 'c')}, {_run_sql('ins', 'c', 'p')}, subs AS (SELECT cells.*, coalesce(x.residue, 'X') AS rp, coalesce(y.residue, 'X') AS rc FROM cells LEFT JOIN code x ON x.codon = p LEFT JOIN code y ON y.codon = c WHERE p <> '-' AND c <> '-' AND p <> c)
    SELECT node_id, 'sub' AS kind, site AS first, site AS last, p || ' -> ' || c || ' (' || CASE WHEN rp = rc THEN rp ELSE rp || ' -> ' || rc END || ')' AS change FROM subs UNION ALL SELECT * FROM del UNION ALL SELECT * FROM ins""")
def e02_codon_events(spark: SparkSession, d: str) -> DataFrame:
    """Events between the rows of sibling leaves, codon by codon."""
    t, r = tree(spark, d), references(spark, d).select("name", "seq")
    side = lambda s, c: t.where(F.col("side") == s).select(F.col("parent_id").alias("node_id"), "name").join(r, "name").select("node_id", F.col("seq").alias(c))
    both = side("left", "a").join(side("right", "b"), "node_id").withColumn("n", (3 * F.ceil(F.greatest(F.length("a"), F.length("b")) / 3)).cast("int"))
    rows = both.select("node_id", F.regexp_replace(F.expr("rpad(a, n, '-')"), "(.{6})...", "$1---").alias("p"), F.regexp_replace(F.expr("rpad(b, n, '-')"), "(.{9})......", "$1------").alias("c"))
    return oa.branch_events(rows, "node_id", "p", "c", 3)


_SHARED = f"""WITH {RECORDS}, e AS (SELECT name, min(seq) AS seq FROM rec GROUP BY name), prs AS (SELECT anchor_id, a.seq AS a, b.seq AS b FROM anchor JOIN e a ON a.name = seq_1 JOIN e b ON b.name = seq_2),
    x AS (SELECT anchor_id, p1, substr(a, CAST(p1 AS INT), 12) AS run FROM (SELECT *, unnest(range(1, length(a) - 10)) AS p1 FROM prs)), y AS (SELECT anchor_id, p2, substr(b, CAST(p2 AS INT), 12) AS run FROM (SELECT *, unnest(range(1, length(b) - 10)) AS p2 FROM prs)),
    m AS (SELECT anchor_id, p1, p2, p1 - row_number() OVER (PARTITION BY anchor_id, p1 - p2 ORDER BY p1) AS g FROM x JOIN y USING (anchor_id, run)),
    found AS (SELECT anchor_id, min(p1) - 1 AS start_1, min(p2) - 1 AS start_2, max(p1) - min(p1) + 12 AS length FROM m GROUP BY anchor_id, p1 - p2, g)"""


def _substrings(spark: SparkSession, d: str, choose=None) -> DataFrame:
    e = records(spark, d).groupBy("name").agg(F.min("seq").alias("seq"))
    a, b = e.select(F.col("name").alias("seq_1"), F.col("seq").alias("a")), e.select(F.col("name").alias("seq_2"), F.col("seq").alias("b"))
    return an.shared_substrings(anchors(spark, d).select("anchor_id", "seq_1", "seq_2").join(a, "seq_1").join(b, "seq_2"), "anchor_id", "a", "b", 12, choose)


@query(f"{_SHARED} SELECT * FROM found")
def j10_shared_substrings(spark: SparkSession, d: str) -> DataFrame:
    """Maximal common substrings of 12 letters or more of each anchor's two records."""
    return _substrings(spark, d)


# Choices that are sequential, as recursion over the anchors' ranks with a list of what was kept so far.
_GREEDY = _SHARED.replace("WITH ", "WITH RECURSIVE ", 1) + """, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY length DESC, start_1, start_2) AS r FROM found),
    step AS (SELECT anchor_id, r, start_1, start_2, length, true AS keep, [{'x': start_1, 'y': start_2, 'n': length}] AS kept FROM ranked WHERE r = 1
        UNION ALL SELECT anchor_id, r, start_1, start_2, length, ok, CASE WHEN ok THEN list_append(kept, {'x': start_1, 'y': start_2, 'n': length}) ELSE kept END
        FROM (SELECT a.*, s.kept, len(list_filter(s.kept, lambda k: a.start_1 < k.x + k.n AND k.x < a.start_1 + a.length OR a.start_2 < k.y + k.n AND k.y < a.start_2 + a.length)) = 0 AS ok
            FROM step s JOIN ranked a ON a.anchor_id = s.anchor_id AND a.r = s.r + 1))
    SELECT anchor_id, start_1, start_2, length FROM step WHERE keep"""

# A stack of anchors: the next one takes those off whose start_2 is higher, as long as their scores are lower.
_CHAIN = """WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_1, seq_2 ORDER BY start_1, start_2, anchor_id) AS r FROM anchor WHERE score IS NOT NULL),
    step AS (SELECT seq_1, seq_2, r, [{'id': anchor_id, 'y': start_2, 's': score}] AS stack FROM ranked WHERE r = 1
        UNION ALL SELECT a.seq_1, a.seq_2, a.r, CASE WHEN len(list_filter(s.stack, lambda k: k.y > a.start_2 AND k.s >= a.score)) = 0
            THEN list_append(list_filter(s.stack, lambda k: k.y <= a.start_2), {'id': a.anchor_id, 'y': a.start_2, 's': a.score})
            ELSE list_filter(s.stack, lambda k, i: i <= list_max(list_transform(s.stack, lambda q, p: CASE WHEN q.y > a.start_2 AND q.s >= a.score THEN p ELSE 0 END))) END
        FROM step s JOIN ranked a ON a.seq_1 = s.seq_1 AND a.seq_2 = s.seq_2 AND a.r = s.r + 1),
    chain AS (SELECT unnest(stack).id AS anchor_id FROM step QUALIFY row_number() OVER (PARTITION BY seq_1, seq_2 ORDER BY r DESC) = 1),
    kept AS (SELECT anchor.* FROM anchor SEMI JOIN chain USING (anchor_id))"""

_CONSISTENT = """WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_1, seq_2 ORDER BY score DESC, start_1, start_2, anchor_id) AS r FROM anchor WHERE score IS NOT NULL),
    step AS (SELECT seq_1, seq_2, r, anchor_id, score, true AS keep, [{'x': start_1, 'y': start_2, 'n': length}] AS judges FROM ranked WHERE r = 1
        UNION ALL SELECT seq_1, seq_2, r, anchor_id, score, bad = 0, CASE WHEN bad = 0 AND near = 0 THEN list_append(judges, {'x': start_1, 'y': start_2, 'n': length}) ELSE judges END
        FROM (SELECT a.*, s.judges,
            len(list_filter(s.judges, lambda k: ((CAST(a.start_1 - k.x AS BIGINT) * (a.start_2 - k.y) < 0 OR a.start_1 >= k.x AND a.start_1 + a.length <= k.x + k.n OR a.start_2 >= k.y AND a.start_2 + a.length <= k.y + k.n) AND abs(a.start_1 - a.start_2 - k.x + k.y) > 50)
                OR ((a.start_1 < k.x + k.n AND k.x < a.start_1 + a.length OR a.start_2 < k.y + k.n AND k.y < a.start_2 + a.length) AND abs(a.start_1 - a.start_2 - k.x + k.y) > 400))) AS bad,
            len(list_filter(s.judges, lambda k: CAST(a.start_1 - k.x AS BIGINT) * (a.start_2 - k.y) < 0 OR a.start_1 >= k.x AND a.start_1 + a.length <= k.x + k.n OR a.start_2 >= k.y AND a.start_2 + a.length <= k.y + k.n)) AS near
            FROM step s JOIN ranked a ON a.seq_1 = s.seq_1 AND a.seq_2 = s.seq_2 AND a.r = s.r + 1))
    SELECT anchor_id, seq_1, seq_2, score FROM step WHERE keep"""

_BLOCKS = _CHAIN + """, ends AS (SELECT seq_1, seq_2, start_1 AS x1, start_2 AS y1, coalesce(lag(start_1 + length) OVER w, 0) AS x0, coalesce(lag(start_2 + length) OVER w, 0) AS y0 FROM kept WINDOW w AS (PARTITION BY seq_1, seq_2 ORDER BY start_1, start_2, length)),
    blocks AS (SELECT seq_1, seq_2, x0, x1, y0, y1, CAST(x1 - x0 AS BIGINT) * (y1 - y0) AS area FROM ends WHERE x1 > x0 AND y1 > y0)"""


@query(_GREEDY)
def w10_a04_prefix_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The substrings that each pair keeps after the greedy choice of non-overlapping ones."""
    return _substrings(spark, d, an.longest_apart)


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return an.colinear(anchors(spark, d).select("seq_1", "seq_2", "anchor_id", "start_1", "start_2", "length", "score"), ["seq_1", "seq_2"])


@query(f"{_CHAIN} SELECT anchor_id, seq_1, seq_2, start_1, start_2, length, score FROM kept")
def w11_colinear_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The anchors that each pair keeps after crossing ones are dropped."""
    return _chain(spark, d).select("anchor_id", "seq_1", "seq_2", "start_1", "start_2", "length", "score")


@query(_CONSISTENT)
def a05_consistent_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's anchors that don't contradict better ones."""
    rows = anchors(spark, d).select("seq_1", "seq_2", "anchor_id", "start_1", "start_2", "length", "score")
    return an.without_bad_hits(rows, ["seq_1", "seq_2"]).select("anchor_id", "seq_1", "seq_2", "score")


@query(f"{_BLOCKS} SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY seq_1, seq_2 ORDER BY area DESC, x0, y0) = 1")
def w16_largest_block(spark: SparkSession, d: str) -> DataFrame:
    """The largest empty block between the neighbouring anchors of each pair, the first of equals."""
    blocks = an.empty_blocks(_chain(spark, d).where("start_1 is not null and start_2 is not null"), ["seq_1", "seq_2"])
    best = F.max_by(F.struct("x0", "x1", "y0", "y1", "area"), F.struct("area", -F.col("x0"), -F.col("y0"))).alias("b")
    return blocks.groupBy("seq_1", "seq_2").agg(best).select("seq_1", "seq_2", "b.*")


@query(f"{_BLOCKS} SELECT *, sum(area) OVER (PARTITION BY seq_1, seq_2) - coalesce(sum(area) OVER (PARTITION BY seq_1, seq_2 ORDER BY area DESC, x0, y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 2000 AS gap FROM blocks")
def a20_relieved_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Which empty blocks are led around by gaps so that a pair's cells fit a limit."""
    return an.relieved_blocks(an.empty_blocks(_chain(spark, d), ["seq_1", "seq_2"]), ["seq_1", "seq_2"], 2000)


@query(f"""WITH {RECORDS}, e AS (SELECT name, max(length(seq)) AS size FROM rec GROUP BY name), p AS (SELECT DISTINCT seq_1, seq_2, size, unnest(range(start_1, start_1 + length)) AS i FROM anchor JOIN e ON name = seq_1 WHERE length > 0 AND start_1 >= 0)
    SELECT seq_1, seq_2, round(count(*) / max(size), 9) AS share, count(*) / max(size) > 0.6 AS skipped FROM p GROUP BY seq_1, seq_2""")
def a21_coverage_skip(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose anchors cover so much of the first record that no alignment is needed."""
    e = records(spark, d).groupBy(F.col("name").alias("seq_1")).agg(F.max(F.length("seq")).alias("size"))
    share = an.covered_share(anchors(spark, d).join(e, "seq_1"), ["seq_1", "seq_2"], "size")
    return share.select("seq_1", "seq_2", F.round("share", 9).alias("share"), (F.col("share") > 0.6).alias("skipped"))


def _by_record(sql: str) -> str:
    return sql.replace("PARTITION BY seq_1, seq_2", "PARTITION BY seq_1").replace(" AND a.seq_2 = s.seq_2", "")


# Pairs hardly ever have two anchors in the test data, so the choices are also made among all anchors of each first record.
@query(_by_record(f"{_CHAIN} SELECT anchor_id, start_1, start_2, score FROM kept"))
def w11_chains_of_records(spark: SparkSession, d: str) -> DataFrame:
    """The anchors that each first record keeps after crossing ones are dropped."""
    return an.colinear(anchors(spark, d).select("seq_1", "anchor_id", "start_1", "start_2", "length", "score"), ["seq_1"]).select("anchor_id", "start_1", "start_2", "score")


@query(_by_record(_CONSISTENT.replace("SELECT anchor_id, seq_1, seq_2, score FROM step", "SELECT anchor_id, seq_1, score FROM step")))
def a05_anchors_of_records(spark: SparkSession, d: str) -> DataFrame:
    """Each first record's anchors that don't contradict better ones."""
    rows = anchors(spark, d).select("seq_1", "anchor_id", "start_1", "start_2", "length", "score")
    return an.without_bad_hits(rows, ["seq_1"]).select("anchor_id", "seq_1", "score")


@query(_by_record(f"{_BLOCKS} SELECT seq_1, x0, x1, y0, y1, area, sum(area) OVER (PARTITION BY seq_1, seq_2) - coalesce(sum(area) OVER (PARTITION BY seq_1, seq_2 ORDER BY area DESC, x0, y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 2000 AS gap FROM blocks"))
def w16_a20_blocks_of_records(spark: SparkSession, d: str) -> DataFrame:
    """The empty blocks along each first record's chain, and which are led around by gaps."""
    chain = an.colinear(anchors(spark, d).select("seq_1", "anchor_id", "start_1", "start_2", "length", "score"), ["seq_1"])
    return an.relieved_blocks(an.empty_blocks(chain, ["seq_1"]), ["seq_1"], 2000)


@query(f"WITH {REFERENCES} SELECT name, rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM ref")
def w15_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Sequences in lines of 60."""
    return references(spark, d).select("name", wrapped(F.col("seq"), 60).alias("lines"))
