"""operators of the retrieval analytics engine."""
