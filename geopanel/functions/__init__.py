"""Column-level helpers: every function takes Columns and returns a Column."""
