"""Column functions and their per-row Python twins."""
