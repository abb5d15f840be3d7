"""corpusloom: text-provenance analytics on Spark (see README.md)."""
