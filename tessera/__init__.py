"""tessera: relational analytics expressed as Spark plans."""
