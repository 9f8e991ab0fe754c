"""lectern: scholarly-literature analytics as lazily evaluated Spark plans."""
