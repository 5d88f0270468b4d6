"""DataFrame operators: filters, diffs, checks, scripts, ingest, dictionary, log."""
