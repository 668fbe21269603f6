"""All queries of the subpackage and their SQL."""

from paneloom.llm import corpus, panel

QUERIES = {**panel.QUERIES, **corpus.QUERIES}
ORACLE = {**panel.ORACLE, **corpus.ORACLE}
