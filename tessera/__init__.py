"""tessera: document analytics and retrieval evaluation as lazy Spark plans."""
