"""Training-corpus pipeline over ``documents``: quality, exact dedup, near dedup, decontamination, packing.

The stages are in ``siltstone.llm.pipeline``.
"""

from __future__ import annotations

from siltstone.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, exact_dedup, near_dedup, packing, quality, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "exact_dedup", "near_dedup", "packing", "quality", "run"]
