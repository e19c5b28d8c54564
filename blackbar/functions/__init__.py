"""Column-level building blocks: dictionary regexes, UTF-8 rules, array helpers."""
