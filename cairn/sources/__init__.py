"""Where search hits, pages and model answers come from."""
