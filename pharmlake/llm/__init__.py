"""Training-data pipeline operators (language ID, dedup, mixing, packing, archives,
fingerprints, vector search, sharding, chat formatting). Nothing else in the library
imports this subpackage."""
