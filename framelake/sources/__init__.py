"""Readers and writers: line-oriented formats as numbered lines, Parquet collections, format registry."""
