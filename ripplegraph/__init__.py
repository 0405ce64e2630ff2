"""Change-impact and lineage analytics over a typed fact base, on PySpark."""
