"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedgeline.plans import alignment_queries, column_queries, format_queries, intervals_queries, kernel_queries, model_queries, output_queries, placement_queries, relational_queries, scalar_queries

_MODULES = [intervals_queries, scalar_queries, relational_queries, model_queries, alignment_queries, column_queries, format_queries, placement_queries, output_queries, kernel_queries]

#: Columns that are 32-bit integers in the queries, where SQL counts in 64 bits.
_INTEGERS = {
    "f22_text_utilities": ["tokens", "signs"],
    "f13_states": ["state"],
    "f14_linear_graph": ["site", "edge_from"],
    "f15_flow_skip_edges": ["edge_from", "edge_to"],
    "f16_homopolymer_skip_edges": ["edge_to"],
    "f11_orfs": ["start", "end"],
    "f17_quality_skip_edges": ["edge_from", "edge_to"],
    "w01_top_with_ties": ["place"],
    "w02_top_without_ties": ["place"],
    "w07_reads_in_node": ["place"],
    "w08_by_length": ["place"],
    "w09_node_names": ["place"],
    "t13_traversal": ["in_order", "post_order"],
    "g06_overlap_identity": ["aligned"],
    "m08_m09_parsimony": ["i"],
    "t07_one_sided_parsimony": ["i"],
    "t08_resolved_sets": ["i"],
    "u01_t08_state_intersections": ["common", "either"],
    "g03_base_counts": ["site"],
    "g04_consensus": ["site"],
    "g05_contig": ["site"],
    "g14_gaps_per_column": ["site"],
    "w14_g16_events": ["first", "last"],
    "w14_g16_whole_events": ["first", "last"],
    "r10_preselection": ["place"],
    "e02_codon_events": ["first", "last"],
    "j10_shared_substrings": ["start_1", "start_2", "length"],
    "w10_a04_prefix_anchors": ["start_1", "start_2", "length"],
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["p2_found"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _cast(sql, _INTEGERS.get(name, [])) for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def _cast(sql: str, columns: list[str]) -> str:
    casts = ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
