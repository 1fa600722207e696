"""Readers and sinks: Parquet by partitions, CSV, JSON lines, ORC, and streams of files."""
