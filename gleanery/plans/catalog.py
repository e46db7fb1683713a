"""The registered queries and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from gleanery.plans import describing, evaluation, grading, knowing, lifecycle, mining, retrieval, states, tagging, timeline, working
from gleanery.plans.register import ORACLE_SQL, QUERIES

MODULES = (retrieval, tagging, evaluation, lifecycle, mining, timeline, states, knowing, working, describing, grading)
__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
