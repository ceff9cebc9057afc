"""citeweave: citation resolution and corpus preparation expressed as PySpark plans."""
