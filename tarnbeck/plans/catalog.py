"""Every query by name, with the SQL that it is held against."""

from __future__ import annotations

from tarnbeck.plans import answers, artifacts, company, composites, corpus, evidence, flows, gates, invalidations, pages, payloads, reports, series, sources, validations  # noqa: F401
from tarnbeck.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "G01_grep_ranking"
