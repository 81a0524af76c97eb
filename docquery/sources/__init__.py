"""Where documents come from and go to: Parquet collections with versions, JSON documents."""
