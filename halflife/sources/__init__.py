"""Sources and sinks: lifecycle CSV/parquet, report CSV, alias maps, patch logs, test-data views."""
