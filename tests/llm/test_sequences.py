import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm import nearpairs, spans
from sedgeline.llm.copies import canonical_classes, formatting_duplicates
from sedgeline.llm.nearpairs import near_duplicates
from sedgeline.llm.spans import shared_share, shared_spans
from sedgeline.llm.tokens import minimizers
from sedgeline.llm.topn import cluster_by_group, skipping, top_n_of_clustered, top_n_per_group

# Further columns whose names the operators use inside.
SCHEMA = "id long, seq string, n int, text string, letters string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None)[:3] + ("x", "y", "z") for r in rows], SCHEMA)


def letters(s):
    return "".join(c for c in s or "" if c.isascii() and c.isalpha()).upper()


def texts_of(rows):
    return {r[0]: letters(r[1]) for r in rows if r[0] is not None and letters(r[1])}


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def noisy(rng, count=60):
    """Records with copies in other layouts, near copies, shared stretches, and awkward ones."""
    base = [dna(rng, rng.randrange(60, 200)) for _ in range(12)]
    common = dna(rng, 70)
    rows, i = [], 0
    for _ in range(count):
        i += 1
        s = rng.choice(base)
        kind = rng.randrange(5)
        if kind == 0:
            s = "\n".join(s[k : k + 20] for k in range(0, len(s), 20)).lower()
        elif kind == 1:
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice("ACGT") + s[at + 1 :]
        elif kind == 2:
            s = dna(rng, 50) + common[: rng.randrange(40, 70)] + dna(rng, 40)
        elif kind == 3:
            at = rng.randrange(len(s))
            s = s[:at] + dna(rng, 9) + s[at:]
        rows += [(i, s, rng.choice([None, 0, 1, 3]))] * rng.choice([1, 1, 2])
    return rows + [(None, "ACGT" * 20, 1), (i + 1, None, 1), (i + 2, "", 1), (i + 3, " -|12é ", 1), (i + 4, "ACGTACG", 1), (i + 5, "A" * 60, 1), (i + 6, "a" * 80, 1), (i + 7, dna(rng, 30_000), 1)]


def brute_spans(texts, k):
    owners = {}
    for i, s in texts.items():
        for j in range(len(s) - k + 1):
            owners.setdefault(s[j : j + k], set()).add(i)
    out = []
    for i, s in texts.items():
        on = [False] * (len(s) + 1)
        for j in range(len(s) - k + 1):
            if len(owners[s[j : j + k]]) > 1:
                on[j : j + k] = [True] * k
        begin = None
        for j, v in enumerate(on):
            if v and begin is None:
                begin = j
            if not v and begin is not None:
                out.append((i, begin, j))
                begin = None
    return sorted(out)


def brute_pairs(texts, k, t):
    grams = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for i, s in texts.items() if len(s) >= k}
    return sorted((a, b) for a in grams for b in grams if a < b and texts[a] != texts[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= t)


def test_copies(spark):
    rows = noisy(random.Random(1))
    texts = texts_of(rows)
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    expected = sorted((first[s], i) for i, s in texts.items() if first[s] != i)
    assert sorted(map(tuple, formatting_duplicates(frame(spark, rows), "id", "seq").collect())) == expected
    classes, members = canonical_classes(frame(spark, rows), "id", "seq", "n")
    copies = {i: 1 if n is None else n for i, s, n in rows if i in texts}
    sums = {}
    for i, s in texts.items():
        sums[s] = sums.get(s, 0) + copies[i]
    assert {r["text"]: r["n_copies"] for r in classes.collect()} == sums
    assert {r["record_id"]: r["keep_id"] for r in members.collect()} == {i: first[s] for i, s in texts.items()}


def test_copies_of_nothing(spark):
    assert formatting_duplicates(frame(spark, []), "id", "seq").count() == 0
    assert formatting_duplicates(frame(spark, [(1, "AC"), (1, "AC"), (1, "GG")]), "id", "seq").count() == 0


@pytest.mark.parametrize("hot,block", [(1 << 23, 1 << 16), (500, 1 << 16), (1 << 23, 37), (500, 37)])
def test_spans(spark, monkeypatch, hot, block):
    monkeypatch.setattr(spans, "_HOT_LETTERS", hot)
    monkeypatch.setattr(spans, "_BLOCK", block)
    rows = noisy(random.Random(2))
    found = shared_spans(frame(spark, rows), "id", "seq", 48)
    assert sorted(map(tuple, found.collect())) == brute_spans(texts_of(rows), 48)


def test_spans_of_a_long_path_with_many_occurrences(spark):
    """Many near copies of 30,000 letters, compared block by block."""
    s = dna(random.Random(10), 30_000)
    df = spark.range(240).select("id", F.concat(F.lit(s), F.translate(F.conv(F.col("id").cast("string"), 10, 4), "0123", "ACGT")).alias("seq"))
    found = shared_spans(df, "id", "seq", 48).collect()
    assert len(found) == 240 and all(r["span_start"] == 0 and r["span_end"] >= 30_000 for r in found)


def test_spans_of_repeats_and_short_lengths(spark):
    rows = [(1, "AC" * 60), (2, "CA" * 40), (3, "GT" * 50), (4, "GTT" * 3), (5, "TTGTT")]
    for k in (48, 5):
        found = shared_spans(frame(spark, rows), "id", "seq", k)
        assert sorted(map(tuple, found.collect())) == brute_spans(texts_of(rows), k)
    assert shared_spans(frame(spark, []), "id", "seq", 48).count() == 0
    share = shared_share(shared_spans(frame(spark, rows), "id", "seq", 48), frame(spark, rows), "id", "seq")
    assert {r["record_id"]: r["share"] for r in share.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    with pytest.raises(ValueError):
        shared_spans(frame(spark, rows), "id", "seq", 1)


@pytest.mark.parametrize("hot,group", [(2000, 64), (3, 2)])
def test_near_pairs(spark, monkeypatch, hot, group):
    monkeypatch.setattr(nearpairs, "_HOT", hot)
    monkeypatch.setattr(nearpairs, "_GROUP", group)
    monkeypatch.setattr(nearpairs, "_QUERIES", 3 if group == 2 else 5000)
    rows = noisy(random.Random(3))
    found = near_duplicates(frame(spark, rows), "id", "seq")
    assert sorted((r["record_a"], r["record_b"]) for r in found.collect()) == brute_pairs(texts_of(rows), 8, 0.6)


def test_near_pairs_whose_common_tokens_are_all_hot(spark, monkeypatch):
    monkeypatch.setattr(nearpairs, "_HOT", 20)
    rng = random.Random(5)
    common, rows = dna(rng, 64), []
    tokens = lambda s: set(minimizers(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s)]), 14, 15)[1].tolist())
    for i in range(4):
        x, y, tries = "", "", 0
        while len(x) < 208:  # one edit in every 26 letters, and no token in common but those of the common stretch
            tries += 1
            part = dna(rng, 26)
            other = {"A": "C", "C": "G", "G": "T", "T": "A"}[part[0]] + part[1:]
            if tokens(common + x + part) & tokens(common + y + other) <= tokens(common):
                x, y = x + part, y + other
            elif tries % 100 == 0:
                x, y = x[:-26], y[:-26]
            assert tries < 5_000
        # Their own letters stand in other, longer records, so that their tokens repeat.
        rows += [(10 * i, common + x), (10 * i + 1, common + y), (10 * i + 2, dna(rng, 400) + common[-26:] + x), (10 * i + 3, dna(rng, 400) + common[-26:] + y)]
    rows += [(200 + i, dna(rng, 300) + common) for i in range(30)]
    found = near_duplicates(frame(spark, rows), "id", "seq")
    expected = brute_pairs(texts_of(rows), 8, 0.6)
    assert [(10 * i, 10 * i + 1) for i in range(4)] == [p for p in expected if p[1] == p[0] + 1 and p[0] % 10 == 0]
    assert sorted((r["record_a"], r["record_b"]) for r in found.collect()) == expected


def edited(rng, s, n):
    """``s`` with n substitutions, deletions or insertions, as evenly spread as can be: the shortest common runs."""
    out, step = list(s), len(s) / n
    for k in range(n):
        at = int((k + 0.5) * step)
        out[at] = rng.choice([rng.choice("ACGT".replace(out[at] or "A", "")), "", out[at] + rng.choice("ACGT")])
    return "".join(out)


@pytest.mark.parametrize("hot", [2000, 3])
@pytest.mark.parametrize("kind", ["edits", "blocks"])
def test_recall_of_near_pairs(spark, monkeypatch, hot, kind):
    """At least nine tenths of the pairs at the threshold, whatever made them; no pair that isn't one."""
    monkeypatch.setattr(nearpairs, "_HOT", hot)
    rng, rows = random.Random(6), []
    common = dna(rng, 60)
    for i in range(120):
        s = common + dna(rng, rng.randrange(200, 400))
        if kind == "edits":
            t = edited(rng, s, rng.randrange(len(s) // 40, len(s) // 30))
        else:
            blocks = [s[k : k + 27] for k in range(0, len(s), 27)]
            t = "".join(rng.sample(blocks, len(blocks)))
        rows += [(2 * i, s), (2 * i + 1, t)]
    expected = set(brute_pairs(texts_of(rows), 8, 0.6))
    assert len(expected) > 60
    found = {(r["record_a"], r["record_b"]) for r in near_duplicates(frame(spark, rows), "id", "seq").collect()}
    print(kind, hot, len(found), len(expected))
    assert found <= expected and len(found) >= 0.9 * len(expected)


def test_unions_rule_out_groups_but_no_pair(spark):
    """Texts that share a token and little else are met, but not opened."""
    rng = random.Random(7)
    common = dna(rng, 40)
    rows = [(i, dna(rng, 150) + common + dna(rng, 150)) for i in range(80)]
    rows += [(100, rows[0][1][:-3] + "AAA"), (101, rows[1][1][3:])]
    found = near_duplicates(frame(spark, rows), "id", "seq")
    assert sorted((r["record_a"], r["record_b"]) for r in found.collect()) == brute_pairs(texts_of(rows), 8, 0.6)
    texts = spark.createDataFrame([(i, s, i % 3) for i, s in rows], "text_id long, letters string, group long")
    b = nearpairs._bitmaps(texts, 8)
    words = range(nearpairs._WORDS)
    u = b.groupBy(b["group"].alias("g")).agg(F.min("grams").alias("least"), F.max("grams").alias("most"), *[F.bit_or(f"b{i}").alias(f"u{i}") for i in words])
    assert b.join(u, b["group"] == u["g"]).where(nearpairs._may_hold(1.0)).count() > 0
    single = b.select(F.col("text_id").alias("other"), F.col("grams").alias("least"), F.col("grams").alias("most"), *[F.col(f"b{i}").alias(f"u{i}") for i in words])
    kept = {(r["text_id"], r["other"]) for r in b.join(single).where("text_id < other").where(nearpairs._may_hold(0.6)).collect()}
    assert set(brute_pairs(texts_of(rows), 8, 0.6)) <= kept and len(kept) < len(rows)


def test_near_pairs_of_other_alphabets_and_grams(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh0123") for _ in range(5)) for _ in range(50)]
    rows = []
    for i in range(20):
        w = [rng.choice(words) for _ in range(40)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:20] + ["x"] + w[21:]))]
    lower = lambda c: F.lower(c)
    for gram in (3, 8, 11):
        found = near_duplicates(frame(spark, rows), "id", "seq", gram, 0.6, lower)
        assert sorted((r["record_a"], r["record_b"]) for r in found.collect()) == brute_pairs(dict(rows), gram, 0.6)


def test_near_pairs_of_tiny_and_repetitive_texts(spark):
    rows = [(1, "ACGTACGTAC"), (2, "ACGTACGTACG"), (3, "A" * 9), (4, "A" * 200), (5, "ACGTTGCA"), (6, "ACGTTGCAA"), (7, "ACGTTGCAAC"), (8, None)]
    found = near_duplicates(frame(spark, rows), "id", "seq")
    assert sorted((r["record_a"], r["record_b"]) for r in found.collect()) == brute_pairs(texts_of(rows), 8, 0.6)
    assert near_duplicates(frame(spark, []), "id", "seq").count() == 0


def test_top_n(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *map(str, range(300))]), rng.choice([None, *range(40)])) for _ in range(5000)]
    rows += rows[:50] + [("lone", "x", 1)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "query string, node string, score int, g int, i string")
    best = {}
    for q, node, s in rows:
        if None not in (q, node, s):
            best[q, node] = max(best.get((q, node), s), s)
    expected = []
    for q in {q for q, _ in best}:
        ranked = sorted((-s, node) for (p, node), s in best.items() if p == q)[:5]
        expected += [(q, node, -s, r + 1) for r, (s, node) in enumerate(ranked)]
    found = top_n_per_group(df, "query", "node", "score", 5)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert top_n_per_group(df.limit(0), "query", "node", "score", 5).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "query", "node", "score", 0)


def test_top_n_skips(spark):
    df = spark.range(200_000).selectExpr("'one' as g", "cast(id as string) as i", "cast(id as int) as s")
    clustered = cluster_by_group(df, "g", "i", "s", row_group_bytes=1 << 14, files=2)
    stats = skipping(clustered, 3).collect()
    assert sum(r["row_groups"] for r in stats) > 4 * sum(r["read"] for r in stats)
    assert [r["s"] for r in top_n_of_clustered(clustered, 3).orderBy("rank").collect()] == [199_999, 199_998, 199_997]


def test_top_n_scan_is_linear(spark, tmp_path):
    """Ten rows in each of very many groups, and one group of many row groups among them."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    from sedgeline.llm.topn import scan_file

    seconds = []
    for groups in (25_000, 100_000):
        g = np.repeat(np.arange(groups), 10)
        g = np.concatenate([g[: len(g) // 2], np.full(200_000, groups // 2 - 1), g[len(g) // 2 :]])
        rng = np.random.default_rng(1)
        t = pa.table({"g": g, "i": rng.integers(0, 1 << 40, len(g)).astype(str), "s": rng.integers(0, 1000, len(g))})
        pq.write_table(t.sort_by([("g", "ascending"), ("s", "descending"), ("i", "ascending")]), tmp_path / "t", row_group_size=20_000)
        begun, seen = time.process_time(), []
        found = pa.concat_tables(scan_file(pq.ParquetFile(tmp_path / "t"), 5, seen))
        seconds.append(time.process_time() - begun)
        frame = t.to_pandas().groupby(["g", "i"], as_index=False).s.max().sort_values(["g", "s", "i"], ascending=[True, False, True])
        assert sorted(zip(*found.to_pydict().values(), strict=True)) == sorted(frame.groupby("g").head(5).itertuples(index=False, name=None))
        assert pq.ParquetFile(tmp_path / "t").num_row_groups - len(seen) >= 7
    # 2.7 times the rows, 4 times the small groups.
    assert seconds[1] < 4.5 * seconds[0]
