"""plans of the retrieval analytics engine."""
