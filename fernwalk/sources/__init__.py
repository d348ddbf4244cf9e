"""Search sources and page fetchers."""
