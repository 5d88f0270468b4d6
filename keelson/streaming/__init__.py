"""No streaming operators: the work is full refreshes and diffs.

The conversions in ``keelson.functions`` are stateless expressions, so
``canonicalise`` and ``split_rows`` take a ``readStream`` DataFrame unchanged.
"""
