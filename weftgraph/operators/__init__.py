"""Relational operators over node, edge and segment tables; each takes and returns DataFrames."""
