"""Readers and writers: delimited ratings, users and items; graphs as Parquet directories; text edges; metrics."""
