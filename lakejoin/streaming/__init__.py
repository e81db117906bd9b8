"""Structured Streaming front end: new query tables arriving as JSON table
documents are searched against a materialised lake embedding table."""

from lakejoin.streaming.search import search_stream, write_lake_embeddings

__all__ = ["search_stream", "write_lake_embeddings"]
