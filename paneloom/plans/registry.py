"""All queries of the core and their SQL."""

from paneloom.plans import base, choices, cross_section, estimates, events, problems, reports, time_series  # noqa: F401  (importing registers the queries)

QUERIES = {**problems.QUERIES, **base.QUERIES}
ORACLE = {**problems.ORACLE, **base.ORACLE}
