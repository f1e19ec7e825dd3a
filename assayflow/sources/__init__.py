"""Sources and sinks: typed CSV, Parquet, record files, line files, JSON recipes, system folders."""
