"""Sources and sinks: driver tables, fixture views, CSV/JSON/parquet I/O."""
