"""Column expressions: metric states, distinct sketches, hashing and word splitting."""
