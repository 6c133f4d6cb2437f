"""Column builders: each takes Columns and returns a Column."""
