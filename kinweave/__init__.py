"""kinweave: record linkage and corpus preparation expressed as Spark plans."""
