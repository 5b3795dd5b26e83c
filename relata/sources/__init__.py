"""Sources and sinks: schemas, parquet directories, snapshots."""
