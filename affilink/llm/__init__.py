"""Training-data operators: near-duplicate joins, token files, media, scans, packing, classifiers."""
