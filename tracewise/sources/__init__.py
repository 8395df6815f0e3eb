"""Sources and sinks: base tables, fixture views, chain JSONL/parquet IO."""
