"""Settings passed to operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    """Search and ingest settings; the defaults are fixed values."""

    dropout_rate: float = 0.3
    min_edge_weight: float = 0.2
    max_depth: int = 5
    strengthen_boost: float = 0.1
    similarity_threshold: float = 0.75
    auto_link: bool = True
    # Seed of the repeatable dropout draw (see functions.scoring.dropout_draw).
    dropout_seed: int = 42


# Fixed values of the data model.
REUSE_SIMILARITY = 0.9
ENTRY_POINTS = 3
EDGE_FANOUT = 8
MIN_SCORE = 0.25
TOP_TOPICS = 5
TOP_INSTANCES = 10
EDGE_REINFORCEMENT = 0.02
MERGE_SIMILARITY = 0.85
MAINTENANCE_MERGE_SIMILARITY = 0.92
MERGE_PAIRS = 10


@dataclass(frozen=True)
class SimilarityLimits:
    """Size bounds of the similarity operators.

    A side is broadcast only when it was counted and holds at most
    ``broadcast_rows`` rows and ``broadcast_bytes`` bytes of vectors; beyond
    that the operators partition both sides by vector cells.  ``block_rows`` is
    the number of rows of one side that a task compares at a time, and
    ``max_cells`` bounds the cell table that every task holds.
    """

    broadcast_rows: int = 20_000
    broadcast_bytes: int = 128 << 20
    block_rows: int = 2_048
    max_cells: int = 1_024
