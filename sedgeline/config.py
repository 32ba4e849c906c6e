"""Options with their effective defaults, from keyword arguments, a file of 'key = value' lines, or a command line."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, fields

from sedgeline.operators.placement import PlacementOptions


@dataclass(frozen=True)
class Options:
    """What governs an analysis. Lengths and distances are in expected changes, scores and shares without a unit."""

    min_branch_length: float = 0.001
    truncate_branches: float = 0.2
    scale_branches: float = 1.0
    real_branches: bool = False
    query_distance: float = 0.1
    min_query_overlap: float = 0.5
    min_query_identity: float = 0.5
    score_ungapped_limit: float = 0.1
    consensus_minimum: int = 5
    consensus_minimum_proportion: float = 0.5
    min_orf_length: int = 50
    qscore_minimum: int = 10
    prefix_hit_length: int = 30
    anchors_offset: int = 15
    trim_keep_sites: int = 15
    memory_for_single_alignment: int = 4000
    any_skips_confirm_insertion: int = 10
    branch_length_confirm_insertion: float = 0.5
    branch_skip_weight: float = 0.9
    block: int = 64

    @staticmethod
    def from_text(text: str) -> Options:
        """The defaults with the values of 'key = value' lines laid over them."""
        return Options(**from_lines(text.splitlines()))

    def placement(self) -> PlacementOptions:
        """What of these governs placements."""
        return PlacementOptions(least_overlap=self.min_query_overlap, least_identity=self.min_query_identity, least_score=self.score_ungapped_limit / 2, distance=self.query_distance, offset=self.anchors_offset)


def _value(kind: str, text: str):
    if kind == "bool":
        if text.lower() not in ("1", "true", "yes", "0", "false", "no", ""):
            raise ValueError(f"not a yes or no: {text!r}")
        return text.lower() in ("1", "true", "yes", "")
    return {"int": int, "float": float}[kind](text)


def from_lines(lines: list[str]) -> dict:
    """Values of 'key = value' lines; blank lines and those that begin with # are skipped, unknown keys are an error."""
    kinds, out = {f.name: f.type for f in fields(Options)}, {}
    for line in lines:
        if line.strip() and not line.lstrip().startswith("#"):
            key, _, text = line.partition("=")
            name = key.strip().replace("-", "_")
            if name not in kinds:
                raise ValueError(f"no such option: {key.strip()}")
            out[name] = _value(kinds[name], text.strip())
    return out


def parsed(arguments: list[str]) -> Options:
    """Options of a command line; --config-file gives a file whose values the command line's override."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--config-file")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            parser.add_argument(flag, action="store_const", const=True)
        else:
            parser.add_argument(flag, type={"int": int, "float": float}[f.type])
    given = vars(parser.parse_args(arguments))
    path = given.pop("config_file")
    base = from_lines(open(path).read().splitlines()) if path else {}
    return Options(**(base | {k: v for k, v in given.items() if v is not None}))


def log_to(path: str | None = None, level: str = "WARNING", overwrite: bool = True) -> None:
    """Messages of at least ``level`` to the console, or to a file that is written anew unless told otherwise."""
    handler = logging.FileHandler(path, "w" if overwrite else "a") if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    log = logging.getLogger("sedgeline")
    for old in log.handlers[:]:
        log.removeHandler(old)
        old.close()
    log.addHandler(handler)
    log.setLevel(level)
