"""Column expressions of the engine: vectors, geometry, ids and phrases."""
