"""Streaming view of crawl progress."""
