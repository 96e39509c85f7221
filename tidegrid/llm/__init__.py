"""Training-data operators: tokens, licences, lines, leaks, near copies, urls, quality, shards, media."""
