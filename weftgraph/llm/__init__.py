"""Training-data operators: fingerprints, classifiers, dedup, mixing, packing, sharding, token files and LM scoring."""
