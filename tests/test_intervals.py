import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedgeline.operators import intervals
from sedgeline.operators.intervals import covered_periods, period_lists

SCHEMA = "key string, s int, e int, kind string, seg_start int"


def brute(rows):
    by = {}
    for key, s, e in rows:
        if key is not None and s is not None and e is not None and s < e:
            by.setdefault(key, []).append((s, e))
    out = []
    for key, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(k, s, e, "x", 1) for k, s, e in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in covered_periods(df, "key", "s", "e", **options).collect())


def test_defined_cases(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 2, 3), ("a", 12, 14), ("a", 12, 14), ("b", 3, 3), ("c", 4, 2), (None, 1, 2), ("d", None, 3), ("d", 1, None), ("e", -5, -2)]
    assert run(spark, rows) == [("a", "gap", 9, 12), ("a", "period", 0, 9), ("a", "period", 12, 14), ("e", "period", -5, -2)]
    assert run(spark, []) == []


def test_reduction_tree_and_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), s := rng.randrange(40_000), s + rng.randrange(6)) for _ in range(30_000)]
    assert run(spark, rows, parts=9, fan_in=2) == brute(rows)


def test_struct_keys(spark):
    df = spark.createDataFrame([(("a", 1), 0, 2), (("a", None), 1, 3), (("a", 1), 2, 5), (("a", None), 7, 8)], "k struct<x:string,y:int>, s int, e int")
    found = sorted((r["k"]["x"], r["k"]["y"] or 0, r["kind"], r["seg_start"], r["seg_end"]) for r in covered_periods(df, "k", "s", "e").collect())
    assert found == [("a", 0, "gap", 3, 7), ("a", 0, "period", 1, 3), ("a", 0, "period", 7, 8), ("a", 1, "period", 0, 5)]


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_CHUNK_ROWS", 50)
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", "z", None]), s := rng.randrange(300), s + rng.randrange(9)) for _ in range(2000)]
    assert run(spark, rows) == brute(rows)


def test_split_keys(spark, monkeypatch):
    """Hot keys are split into cells: intervals within, across and over many cells, and touching at borders."""
    monkeypatch.setattr(intervals, "_HOT_ROWS", 200)
    monkeypatch.setattr(intervals, "_CELLS", 8)
    rng = random.Random(3)
    for spread, length in ((40_000, 9), (3_000, 9), (40_000, 4_000)):
        rows = [(rng.choice("hhhhhhi" + "xyz"[i % 3]), s := rng.randrange(spread), s + rng.randrange(rng.choice([2, 9, length]))) for i in range(3000)]
        rows += [("h", i, i + 1) for i in range(50_000, 50_300)]
        assert run(spark, rows, parts=9, fan_in=2) == brute(rows)
    assert run(spark, [("k", 5, 9)] * 500) == [("k", "period", 5, 9)]


def test_a_key_of_very_many_periods(spark):
    df = spark.range(1_200_000).selectExpr("'k' as key", "id * 3 as s", "id * 3 + 2 as e")
    found = covered_periods(df, "key", "s", "e")
    rows = found.groupBy("kind").agg({"*": "count", "seg_start": "sum", "seg_end": "sum"}).collect()
    n = 1_200_000
    sums = {r["kind"]: (r["count(1)"], r["sum(seg_start)"], r["sum(seg_end)"]) for r in rows}
    assert sums == {"period": (n, 3 * n * (n - 1) // 2, 3 * n * (n - 1) // 2 + 2 * n), "gap": (n - 1, 3 * (n - 1) * (n - 2) // 2 + 2 * (n - 1), 3 * n * (n - 1) // 2)}
    # No task merges more than some cells of the key.
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < n


def test_lists(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 4, 6)], "k int, s int, e int")
    row = period_lists(covered_periods(df, "k", "s", "e"), "k").collect()[0]
    assert [tuple(x) for x in row["periods"]] == [(0, 2), (4, 6)] and [tuple(x) for x in row["gaps"]] == [(2, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-2**62, 2**62), st.integers(0, 2**40)), max_size=30))
def test_partial_state(rows):
    import pyarrow as pa

    rows = [(k, s, s + d + 1) for k, s, d in rows]
    table = pa.table({"k": pa.array([r[0] for r in rows], pa.string()), "s": pa.array([r[1] for r in rows], pa.int64()), "e": pa.array([r[2] for r in rows], pa.int64())})
    merged = intervals._compact(table).to_pydict()
    assert sorted(zip(merged["k"], ["period"] * len(merged["k"]), merged["s"], merged["e"])) == [r for r in brute(rows) if r[1] == "period"]
