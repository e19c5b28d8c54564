"""Training-data operators: packing, scoring, filters and near-duplicate removal."""
