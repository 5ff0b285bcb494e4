"""Readers: load files of triples and hyperedges, and the mapping of relational tables to facts."""
