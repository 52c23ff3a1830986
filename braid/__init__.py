"""braid: feature-graph analytics expressed as PySpark DataFrame plans."""
