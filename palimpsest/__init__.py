"""Memory analytics on Spark: DataFrame operators over facts, events, conversations and documents."""
