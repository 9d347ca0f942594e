"""Record discovery, linkage and ranking as Spark DataFrame transforms."""
