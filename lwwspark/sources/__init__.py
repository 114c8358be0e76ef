"""Where replicas live: versioned parquet snapshots, and SQLite files for interchange."""
