"""All registered queries of the evaluation and curation operators, with the SQL they are checked against."""

from __future__ import annotations

from evalframe.plans import answers, curation, evaluation, extraction, judgements, labelling, parsing, prepare, regions, rollups, shaping  # noqa: F401
from evalframe.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "a23_accuracy_by_category"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
