"""Named queries over the benchmark tables and their SQL counterparts."""
