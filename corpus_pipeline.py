"""The corpus pipeline: five stages from raw documents to packed training sequences (see trailforge/llm/pipeline.py)."""

from __future__ import annotations

from trailforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
