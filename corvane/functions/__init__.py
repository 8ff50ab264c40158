"""functions of the retrieval analytics engine."""
