"""Graphs that grow: degrees kept live over a stream of edges."""
