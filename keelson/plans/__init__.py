"""Jobs a user runs: transfer, fleet sync, load order, post-migration check."""
