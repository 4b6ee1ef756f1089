"""Compositions of operators: scene graphs, hierarchical queries and evaluations."""
