"""Column functions: type mapping, value conversion, sink encoding, text rules."""
