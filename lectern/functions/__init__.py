"""Column expressions shared by the operators (no actions, no shuffles)."""
