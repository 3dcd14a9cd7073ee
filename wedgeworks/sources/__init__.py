"""Graph sources: binary CSR files, geometric generators, projections of relational tables."""
