"""tessera: retrieval, text and knowledge-graph analytics as PySpark DataFrame plans."""
