"""Relational operators of the retrieval engine: chunks, indexes, joins, graph, review queue."""
