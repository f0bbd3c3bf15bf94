"""All queries of this subpackage; importing their modules registers them."""

from meguri.llm import alignment, decontaminate, fingerprints, line_dedup, ngram_join, packing, pii, quality, quotations, repair, secrets, sharding, toxicity  # noqa: F401
from meguri.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
