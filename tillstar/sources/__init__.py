"""Sources and sinks: CSV exports (batch and landing folders) and the Parquet warehouse."""
