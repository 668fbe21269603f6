"""Sources and sinks."""

from paneloom.sources.tables import TABLES, table, tables

__all__ = ["TABLES", "table", "tables"]
