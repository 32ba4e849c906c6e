import pytest

from sedgeline.config import Options, from_lines, parsed
from sedgeline.streaming.placing import hit_counts, place_stream

HITS = "hit_id long, query string, node string, score int, q_start int, q_end int, t_start int, t_end int, q_strand string, t_strand string, found_at timestamp"


def test_streams(spark, tmp_path):
    rows = "(1L, 'q', 'a', 50, 0, 9, 0, 9, '+', '+', timestamp'2025-01-01 10:00:00'), (1L, 'q', 'a', 50, 0, 9, 0, 9, '+', '+', timestamp'2025-01-01 10:00:00'), (2L, 'q', 'b', 9, 0, 9, 0, 9, '+', '+', timestamp'2025-01-02 10:00:00')"
    names = ", ".join(c.split()[0] for c in HITS.split(", "))
    spark.sql(f"select * from values {rows} as t({names})").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(HITS).parquet(str(tmp_path / "in"))
    q = hit_counts(stream()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["node"], r["hits"], r["best"]) for r in spark.table("counts").collect()) == [("a", 1, 50), ("b", 1, 9)]
    seqs = spark.createDataFrame([("q", "ACGGTTACGA"), ("a", "ACGGTTACGA"), ("b", "ACCCTTACGA")], "name string, seq string")
    q = place_stream(stream(), seqs, seqs, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    placed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["query"], r["node"], r["batch"]) for r in placed] == [("q", "a", 0)]


def test_options(tmp_path):
    assert Options().truncate_branches == 0.2 and from_lines(["# x", "", "min-orf-length = 9", "real-branches = yes"]) == {"min_orf_length": 9, "real_branches": True}
    (tmp_path / "c").write_text("block = 8\nanchors-offset = 3\n")
    got = parsed(["--config-file", str(tmp_path / "c"), "--block", "9"])
    assert got.block == 9 and got.anchors_offset == 3
    with pytest.raises(ValueError):
        from_lines(["nothing = 1"])
    with pytest.raises(ValueError):
        from_lines(["real-branches = maybe"])


def test_log(tmp_path):
    import logging

    from sedgeline.config import log_to
    from sedgeline.sources.writers import known_format

    log_to(str(tmp_path / "log"), "WARNING")
    assert known_format("clustal") == ("fasta", ".fas")
    logging.getLogger("sedgeline").info("not told")
    log_to()
    assert (tmp_path / "log").read_text() == "WARNING no format 'clustal': writing fasta\n"
