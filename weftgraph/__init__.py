"""Typed sparse graphs as DataFrames: operators are lazily composed Spark plans."""
