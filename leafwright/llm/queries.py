"""All queries of the subpackage."""

from leafwright.llm import (  # noqa: F401
    bpe, cover_tree, jaccard, line_spread, mixing, piece_table, quality, sharding, style_tree, suffix_array, suffix_tree, toxicity, whitening,
)
from leafwright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
