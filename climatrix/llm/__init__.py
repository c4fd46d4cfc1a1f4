"""Training-data operators: license scan, substring dedup, quality rules,
packing, quality classifier, near-dup, decontamination, PII, LM scoring and
sharding. Nothing else in the library imports this subpackage."""
