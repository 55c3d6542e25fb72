"""Training-data operators: dedup, filters, tokenising, scoring, search and packing.

Nothing else in the library imports this subpackage."""
