"""The substitution and gap models at the distances of the guide tree's nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.functions import models as fm
from sedgeline.functions import sequence as fs
from sedgeline.plans.relational_queries import m12_node_distances

QUERIES = {}
ORACLE_SQL = {}
# Frequencies of the test model; any others may be passed.
_PI = (0.3, 0.2, 0.2, 0.3)
_BETA, _AR, _AY, _R, _Y = fm.dna_rates(_PI)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_DISTANCES = "dist AS (SELECT DISTINCT distance AS t FROM (SELECT p.node_id, round(sum(least(CASE WHEN c.branch_length > 0 THEN c.branch_length ELSE 0.001 END, 0.2)), 9) AS distance FROM tree_node p JOIN tree_node c ON c.parent_id = p.node_id GROUP BY p.node_id))"
_BASES = "base AS (SELECT * FROM (VALUES ('A', 0.3, true), ('C', 0.2, false), ('G', 0.2, true), ('T', 0.3, false)) b(letter, pi, purine))"
_P = f"""{_DISTANCES}, {_BASES}, p AS (SELECT t, i.letter AS a, j.letter AS b, i.pi AS pa, j.pi AS pb,
    CASE WHEN i.letter = j.letter THEN exp(-(CASE WHEN i.purine THEN {_AR} ELSE {_AY} END + {_BETA}) * t) ELSE 0 END
    + CASE WHEN i.purine = j.purine THEN exp(-{_BETA} * t) * (1 - exp(-CASE WHEN i.purine THEN {_AR} ELSE {_AY} END * t)) * j.pi / CASE WHEN i.purine THEN {_R} ELSE {_Y} END ELSE 0 END
    + (1 - exp(-{_BETA} * t)) * j.pi AS p FROM dist, base i, base j)"""


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct distance and pair of bases: the 16 pairs are a constant, so this is a projection."""
    t = m12_node_distances(spark, d).select(F.col("distance").alias("t")).distinct()
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(pa).alias("pa"), F.lit(pb).alias("pb")) for a, pa in zip("ACGT", _PI, strict=True) for b, pb in zip("ACGT", _PI, strict=True)])
    rows = t.select("t", F.explode(pairs).alias("x")).select("t", "x.*")
    purine = F.col("a").isin("A", "G")
    p = fm.dna_probability(F.col("a") == F.col("b"), purine == F.col("b").isin("A", "G"), purine, F.col("pb"), F.col("t"), _PI)
    return rows.withColumn("p", p)


@query(f"WITH {_P} SELECT t, a, b, round(p, 9) AS p FROM p")
def m02_transition_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return _probabilities(spark, d).select("t", "a", "b", F.round("p", 9).alias("p"))


@query(f"WITH {_P} SELECT t, a, b, round(ln(0.5 * (pa + pb) * p / (pa * pb)), 7) AS score FROM p")
def m05_log_odds(spark: SparkSession, d: str) -> DataFrame:
    return _probabilities(spark, d).select("t", "a", "b", F.round(F.log(0.5 * (F.col("pa") + F.col("pb")) * F.col("p") / (F.col("pa") * F.col("pb"))), 7).alias("score"))


_BITS = "bits AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in fs.BASE_BITS.items()) + ") b(letter, bits))"


@query(f"WITH {_P}, {_BITS}, m AS (SELECT letter, b FROM bits, (VALUES ('A', 1), ('C', 2), ('G', 4), ('T', 8)) x(b, bit) WHERE bits & bit > 0) SELECT t, x.letter AS a, y.letter AS b, round(max(ln(0.5 * (pa + pb) * p / (pa * pb))), 7) AS score FROM p JOIN m x ON x.b = p.a JOIN m y ON y.b = p.b GROUP BY t, x.letter, y.letter")
def m07_ambiguity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of ambiguous letters: the best over what they may stand for."""
    p = m05_log_odds(spark, d)
    readings = F.array(*[F.struct(F.lit(letter).alias("letter"), F.lit(b).alias("base")) for letter, bits in fs.BASE_BITS.items() for b, bit in zip("ACGT", (1, 2, 4, 8), strict=True) if bits & bit])
    of = lambda c: F.explode(F.transform(F.filter(readings, lambda r: r["base"] == F.col(c)), lambda r: r["letter"]))
    return p.select("t", of("a").alias("x"), "b", "score").select("t", "x", of("b").alias("y"), "score").groupBy("t", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max("score").alias("score"))


@query(f"WITH {_DISTANCES} SELECT t, round(1 - exp(-0.5 * 0.02 * t), 12) AS opening, round(1 - 2 * (1 - exp(-0.5 * 0.02 * t)), 12) AS none FROM dist")
def m06_gap_probabilities(spark: SparkSession, d: str) -> DataFrame:
    t = m12_node_distances(spark, d).select(F.col("distance").alias("t")).distinct()
    opening = fm.gap_open(F.col("t"))
    return t.select("t", F.round(opening, 12).alias("opening"), F.round(1 - 2 * opening, 12).alias("none"))


_SIBLINGS = """{refs}, s AS (SELECT p.node_id, l.seq AS a, r.seq AS b, p.name FROM tree_node p JOIN tree_node x ON x.parent_id = p.node_id AND x.side = 'left' JOIN tree_node y ON y.parent_id = p.node_id AND y.side = 'right' JOIN ref l ON l.name = x.name JOIN ref r ON r.name = y.name)"""


def _sibling_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of sibling leaves' sequences, laid side by side from the start: (node_id, i, a, b) as base sets."""
    from sedgeline.plans.tables import references, tree

    t, r = tree(spark, d), references(spark, d).select("name", "seq")
    side = lambda s, c: t.where(F.col("side") == s).select(F.col("parent_id").alias("node_id"), "name").join(r, "name").select("node_id", F.col("seq").alias(c))
    both = side("left", "a").join(side("right", "b"), "node_id")
    cut = both.withColumn("n", F.least(F.length("a"), F.length("b"))).where("n > 0")
    each = cut.select("node_id", F.posexplode(F.arrays_zip(F.split("a", "").alias("a"), F.split("b", "").alias("b"))).alias("i", "x"), "n").where("i < n")
    return each.select("node_id", "i", fs.base_bits(F.col("x.a")).alias("a"), fs.base_bits(F.col("x.b")).alias("b"))


def _sibling_sql() -> str:
    from sedgeline.plans.tables import REFERENCES

    chars = "c AS (SELECT node_id, i, substr(a, CAST(i AS INT) + 1, 1) AS ca, substr(b, CAST(i AS INT) + 1, 1) AS cb FROM (SELECT *, unnest(range(0, least(length(a), length(b)))) AS i FROM s)), z AS (SELECT node_id, i, coalesce(x.bits, 0) AS a, coalesce(y.bits, 0) AS b FROM c LEFT JOIN bits x ON x.letter = ca LEFT JOIN bits y ON y.letter = cb)"
    return f"WITH {_SIBLINGS.format(refs=REFERENCES)}, {_BITS}, {chars}"


@query(_sibling_sql() + ", p AS (SELECT *, CASE WHEN a & b > 0 THEN a & b ELSE a | b END AS parent FROM z) SELECT node_id, i, parent, CASE WHEN parent & a > 0 THEN parent & a ELSE a END AS child FROM p")
def m08_m09_parsimony(spark: SparkSession, d: str) -> DataFrame:
    """Parents' base sets from their two children's, and the left child's set in the light of its parent's."""
    z = _sibling_columns(spark, d).withColumn("parent", fs.parsimony(F.col("a"), F.col("b")))
    return z.select("node_id", "i", "parent", fs.child_parsimony(F.col("parent"), F.col("a")).alias("child"))


@query(_sibling_sql() + ", n AS (SELECT node_id, count(*) AS share, CAST(sum(CASE WHEN a & b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ident FROM z GROUP BY node_id) SELECT node_id, share, ident, round(1 - ident / share, 9) AS p_distance FROM n")
def g18_pairwise_identity(spark: SparkSession, d: str) -> DataFrame:
    """Shared and identical columns of sibling leaves, and their p-distance."""
    n = _sibling_columns(spark, d).groupBy("node_id").agg(F.count("*").alias("share"), F.count_if(F.col("a").bitwiseAND(F.col("b")) > 0).alias("ident"))
    return n.withColumn("p_distance", F.round(1 - F.col("ident") / F.col("share"), 9))


@query(_sibling_sql() + ", u AS (SELECT node_id, i, len(list_filter([1, 2, 4, 8], lambda k: a & b & k > 0)) AS common, len(list_filter([1, 2, 4, 8], lambda k: (a | b) & k > 0)) AS either FROM z) SELECT common, either, count(*) AS n FROM u GROUP BY common, either")
def u01_t08_state_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the common and the joint candidate sets of sibling columns."""
    sets = lambda c: F.expr(f"filter(array(1, 2, 4, 8), k -> {c} & k > 0)")
    u = _sibling_columns(spark, d).select(F.size(F.array_intersect(sets("a"), sets("b"))).alias("common"), F.size(F.array_union(sets("a"), sets("b"))).alias("either"))
    return u.groupBy("common", "either").agg(F.count("*").alias("n"))


def _values(names: str, rows: list[tuple]) -> str:
    quoted = ["(" + ", ".join(repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"{v:.17g}::DOUBLE" for v in r) + ")" for r in rows]
    return f"(SELECT * FROM (VALUES {', '.join(quoted)}) v({names}))"


@query(f"""WITH {_BASES}, q AS (SELECT i.letter AS a, j.letter AS b, j.pi * ({_BETA} + CASE WHEN i.purine <> j.purine THEN 0 WHEN i.purine THEN {_AR} / {_R} ELSE {_AY} / {_Y} END) AS rate FROM base i, base j WHERE i.letter <> j.letter)
    SELECT a, b, round(rate, 9) AS rate FROM q UNION ALL SELECT a, a, round(-sum(rate), 9) FROM q GROUP BY a""")
def m01_rate_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the nucleotide model."""
    q = fm.dna_rate_matrix(_PI)
    return spark.createDataFrame([(a, b, round(float(q[i, j]), 9)) for i, a in enumerate("ACGT") for j, b in enumerate("ACGT")], "a string, b string, rate double")


#: Distances at which protein and codon probabilities are given.
_TIMES = (0.05, 0.2, 1.0)


def _series_sql(exchange, pi, tokens: list[str]) -> str:
    """P(t) in SQL as the sum of a Poisson number of jumps (uniformisation), not through eigenvectors."""
    n = len(tokens)
    rows = [(i, j, float(exchange[i, j])) for i in range(n) for j in range(n) if exchange[i, j] > 0]
    freq = [(i, tokens[i], float(pi[i])) for i in range(n)]
    return f"""WITH RECURSIVE s AS {_values('i, j, s', rows)}, f AS {_values('i, token, pi', freq)},
        raw AS (SELECT s.i, s.j, s * g.pi AS q FROM s JOIN f g ON g.i = s.j), mean AS (SELECT sum(f.pi * q) AS m FROM raw JOIN f USING (i)),
        rate AS (SELECT i, j, q / m AS q FROM raw, mean), total AS (SELECT i, sum(q) AS q FROM rate GROUP BY i), mu AS (SELECT max(q) AS mu FROM total),
        jump AS MATERIALIZED (SELECT i, j, q / mu AS r FROM rate, mu UNION ALL SELECT i, i, 1 - q / mu FROM total, mu),
        power AS (SELECT 0 AS k, i, i AS j, 1.0::DOUBLE AS v FROM f UNION ALL SELECT k, i, j, v FROM (SELECT p.k + 1 AS k, p.i, jump.j, sum(p.v * jump.r) AS v FROM power p JOIN jump ON jump.i = p.j WHERE p.k < 40 GROUP BY p.k, p.i, jump.j)),
        times AS (SELECT unnest({list(_TIMES)})::DOUBLE AS t), w AS (SELECT t, k, exp(-mu * t + k * ln(mu * t) - lgamma(k + 1)) AS w FROM times, mu, (SELECT DISTINCT k FROM power))
        SELECT t, a.token AS a, b.token AS b, round(sum(w * v), 7) AS p FROM power JOIN w USING (k) JOIN f a ON a.i = power.i JOIN f b ON b.i = power.j GROUP BY t, a.token, b.token"""


def _matrices(spark: SparkSession, exchange, pi, tokens: list[str]) -> DataFrame:
    def rows(frames):
        import pandas as pd

        for frame in frames:
            for t in frame["t"]:
                p = fm.reversible_matrix(exchange, pi, t)
                yield pd.DataFrame([(t, a, b, p[i, j]) for i, a in enumerate(tokens) for j, b in enumerate(tokens)], columns=["t", "a", "b", "p"])

    times = spark.createDataFrame([(t,) for t in _TIMES], "t double")
    return times.mapInPandas(rows, "t double, a string, b string, p double").withColumn("p", F.round("p", 7))


@query(_series_sql(*fm.protein_model(), list(fs.AMINO_ACIDS)))
def m03_protein_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of the empirical protein model."""
    return _matrices(spark, *fm.protein_model(), list(fs.AMINO_ACIDS))


@query(_series_sql(*fm.codon_model(), fm.CODONS))
def m04_codon_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of the codon model with one rate for transitions and one for changes of the residue."""
    return _matrices(spark, *fm.codon_model(), fm.CODONS)


_FREQUENCIES = list(zip(fs.AMINO_ACIDS, map(float, fm.protein_model()[1]), strict=True))


@query(f"WITH f AS {_values('token, pi', _FREQUENCIES)} SELECT x.token AS a, y.token AS b, CASE WHEN x.pi >= y.pi THEN x.token ELSE y.token END AS likely FROM f x, f y")
def m10_most_common(spark: SparkSession, d: str) -> DataFrame:
    """Which of two residues a parent of both most probably was."""
    import numpy as np

    p = fm.PROTEIN
    n = len(p.tokens)
    pairs = [(i, j) for i in range(n) for j in range(n)]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    return spark.createDataFrame([(p.tokens[a], p.tokens[b], p.tokens[k]) for (a, b), k in zip(pairs, p.likely(p.common(i, j)), strict=True)], "a string, b string, likely string")


@query(f"SELECT * FROM {_values('molecule, insertion, deletion, extension, end_extension', [('dna', 0.01, 0.01, 0.8, 0.95), ('pacbio', 1.0, 1.0, 0.1, 0.95), ('protein', 0.05, 0.05, 0.5, 0.75), ('codon', 0.01, 0.01, 0.5, 0.75)])}")
def m11_presets(spark: SparkSession, d: str) -> DataFrame:
    """The gap models by molecule."""
    return spark.createDataFrame([(k, g.insertion, g.deletion, g.extension, g.end_extension) for k, g in fm.GAPS.items()], "molecule string, insertion double, deletion double, extension double, end_extension double")
