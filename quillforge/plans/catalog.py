"""Named queries over the provided tables, each with an independent SQL statement of the same result."""

from __future__ import annotations

from quillforge.plans import assembly, audits, corpus, evaluation, extras, layout, pages, rasters, rollups, service, values
from quillforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assembly", "audits", "corpus", "evaluation", "extras", "layout", "pages", "rasters", "rollups", "service", "values"]
