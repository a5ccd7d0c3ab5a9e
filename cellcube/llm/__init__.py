"""Training-data operators: packing, ordering, mixing, deduplication, scoring, filtering, sharding, search.

Nothing else in the library imports this subpackage."""
