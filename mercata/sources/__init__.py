"""Sources (raw parquet tables, canonical views, CSV input) and sinks."""

from mercata.sources.tables import Tables

__all__ = ["Tables"]
