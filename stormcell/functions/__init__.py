"""Column-level helpers: each returns a built-in Spark ``Column`` expression."""
