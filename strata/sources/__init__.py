"""Sources and sinks: parquet scans, cohort views over the given tables, CSV and xlsx."""
