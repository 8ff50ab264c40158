"""sources of the retrieval analytics engine."""
