"""netsets: network-derived entity and set embeddings as Spark DataFrame plans."""
